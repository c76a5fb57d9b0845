"""Availability and booking requests, resolved first come, first served."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import beyond_money, money, month_nights
from innsight.plans._common import (
    arrival_order,
    dedupe_requests,
    first_reason,
    held_months,
    known,
    new_id,
    split,
    valid_range,
)
from innsight.plans.vip import count_bookings
from innsight.schemas import FACTOR_CON_IVA, HABITACION_INACTIVA, METODOS_RESERVA, RESERVA_POR_LLEGAR
from innsight.session import checkpoint
from innsight.tables import Delta, Hotel

SPAN = ["id_habitacion", "fecha_inicio", "fecha_salida"]


def validate_booking_dates(bookings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bookings that end after they begin, and the refused others."""
    return split(
        bookings.withColumn(
            "motivo_rechazo", first_reason(("invalid_range", ~valid_range()))
        )
    )


def check_availability(hotel: Hotel, requests: DataFrame) -> DataFrame:
    """Requests (request_id, id_habitacion, fecha_inicio, fecha_salida, ...) with ``disponible``.

    1 or 0 as the room is free, NULL with a ``motivo_rechazo`` when the request
    makes no sense.
    """
    return _judge_availability(hotel, requests).drop("_tarifa")


def _judge_availability(hotel: Hotel, requests: DataFrame) -> DataFrame:
    """Availability and the room's price.

    Equal requests are tested once, month by month: wanted nights and the room's
    held nights are bitmaps, and a common bit means that the room is taken. No
    pair of intervals is ever formed, and no booking is spread over its nights.
    """
    spans = checkpoint(requests.filter(valid_range()).select(*SPAN).distinct())
    taken = (
        spans.select(*SPAN, month_nights("fecha_inicio", "fecha_salida").alias("m"))
        .join(held_months(hotel, spans).withColumnRenamed("mes", "m_mes").withColumnRenamed("id_habitacion", "m_cuarto"),
              (F.col("id_habitacion") == F.col("m_cuarto")) & (F.col("m.mes") == F.col("m_mes")))
        .filter(F.col("m.mascara").bitwiseAND(F.col("ocupadas")) != 0)
        .select(*SPAN)
        .distinct()
        .withColumn("_tomada", F.lit(True))
    )
    rooms = hotel.habitacion.select("id_habitacion", F.col("estado").alias("_estado"), F.col("precio").alias("_tarifa"))
    free = ~F.col("_estado").isin(*HABITACION_INACTIVA) & F.col("_tomada").isNull()
    return (
        requests.join(taken, SPAN, "left")
        .join(rooms, "id_habitacion", "left")
        .withColumn(
            "motivo_rechazo",
            first_reason(
                ("invalid_range", ~valid_range()),
                ("unknown_room", F.col("_estado").isNull()),
            ),
        )
        .withColumn("disponible", F.when(F.col("motivo_rechazo").isNull(), free.cast("int")))
        .drop("_tomada", "_estado")
    )


def _granting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids granted among requests sorted by room and arrival; a task holds the granted nights of one room at a time."""
    room, starts, ends = object(), [], []
    for batch in batches:
        granted = []
        columns = [batch.column(n).to_pylist() for n in ("id_habitacion", "ini", "fin")]
        for i, (here, ini, fin) in enumerate(zip(*columns, strict=True)):
            if here != room:
                room, starts, ends = here, [], []
            at = bisect_left(ends, ini + 1)  # the first granted stay that ends after this one begins
            if at == len(starts) or starts[at] >= fin:
                starts.insert(at, ini)
                ends.insert(at, fin)
                granted.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("request_id").take(pa.array(granted, pa.int64()))], ["request_id"])


def first_come(requests: DataFrame) -> DataFrame:
    """Requests (request_id, arrival, room and dates) granted in order of arrival.

    A request is granted when no earlier granted request shares one of its
    room-nights; a request without nights is never granted. Of requests for the
    same room and dates only the earliest can be, so each task reduces them
    first: what is left of a room is bounded by the calendar, however many ask
    for it. The requests of a room are then settled in one pass in order of
    arrival, whatever the depth of their conflicts.
    """
    order = arrival_order()
    first = (
        requests.filter(valid_range()).groupBy(*SPAN).agg(F.min(order).alias("o"))
        .select("id_habitacion", F.unix_date("fecha_inicio").alias("ini"), F.unix_date("fecha_salida").alias("fin"), "o")
    )
    sorted_rooms = first.repartition("id_habitacion").sortWithinPartitions("id_habitacion", "o")
    kind = requests.schema["request_id"].dataType.simpleString()
    rows = sorted_rooms.select("id_habitacion", "ini", "fin", F.col("o.request_id").alias("request_id"))
    return rows.mapInArrow(_granting, f"request_id {kind}")


def book(hotel: Hotel, requests: DataFrame) -> Delta:
    """Booking requests (request_id, arrival, id_huesped, id_huesped_facturador, id_usuario,
    fecha_inicio, fecha_salida, metodo, id_habitacion).

    Granted requests become a confirmed booking with one room at today's price
    and move the payer's counters. A request whose total is too wide to be stored
    is refused alone and holds no room.
    """
    requests, repeats = dedupe_requests(requests)
    stay = F.datediff("fecha_salida", "fecha_inicio")
    cost = F.col("_tarifa") * stay
    with_tax = F.lit(FACTOR_CON_IVA).cast("decimal(3,2)")
    judged = (
        _judge_availability(hotel, requests)
        .withColumnRenamed("motivo_rechazo", "_previo")
        .join(known(hotel.huesped, "id_huesped", "_huesped"), "id_huesped", "left")
        .join(known(hotel.huesped_facturador, "id_huesped_facturador", "_pagador"), "id_huesped_facturador", "left")
        .join(known(hotel.usuario, "id_usuario", "_usuario"), "id_usuario", "left")
        .withColumn(
            "motivo_rechazo",
            F.coalesce(
                "_previo",
                first_reason(
                    ("room_unavailable", F.col("disponible") == 0),
                    ("unknown_guest", F.col("_huesped").isNull()),
                    ("unknown_payer", F.col("_pagador").isNull()),
                    ("unknown_user", F.col("_usuario").isNull()),
                    ("invalid_method", ~F.coalesce(F.col("metodo").isin(*METODOS_RESERVA), F.lit(False))),
                    ("amount_too_large", beyond_money(cost * with_tax)),
                ),
            ),
        )
    )
    judged = checkpoint(judged)
    candidates, refused = split(judged)
    granted = checkpoint(first_come(candidates))
    accepted = candidates.join(granted, "request_id", "left_semi")
    late = candidates.join(granted, "request_id", "left_anti").select(
        "request_id", F.lit("taken_in_batch").alias("motivo_rechazo")
    )
    priced = (
        accepted.withColumn("noches", stay)
        .withColumn("subtotal", money(cost))
        .withColumn("total", money(F.col("subtotal") * with_tax))
        .withColumn("id_reservacion", new_id("reservacion", "request_id"))
    )
    bookings = priced.select(
        "id_reservacion", "id_huesped", "id_huesped_facturador", "id_usuario", "fecha_inicio", "fecha_salida",
        F.lit("confirmada").alias("estado"), "metodo", "subtotal", "total",
    )
    rooms = priced.select(
        new_id("reservacion_habitacion", "request_id").alias("id_reservacion_habitacion"),
        "id_reservacion",
        "id_habitacion",
        F.col("_tarifa").alias("tarifa_por_noche"),
        "noches",
        F.lit(1).alias("cantidad_habitaciones"),
        "subtotal",
    )
    counters = count_bookings(hotel, bookings)
    rejected = refused.unionByName(late).unionByName(repeats)
    return Delta({"reservacion": bookings, "reservacion_habitacion": rooms}, counters.updates, rejected)


def expire_bookings(hotel: Hotel, today: dt.date) -> Delta:
    """Expected bookings whose arrival date passed without a stay become expirada."""
    missed = (
        hotel.reservacion.filter(
            F.col("estado").isin(*RESERVA_POR_LLEGAR) & (F.col("fecha_inicio") < F.lit(today))
        )
        .join(hotel.estancia.select("id_reservacion"), "id_reservacion", "left_anti")
        .withColumn("estado", F.lit("expirada"))
    )
    return Delta(updates={"reservacion": missed.select(*hotel.reservacion.columns)})
