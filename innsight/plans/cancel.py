"""Cancellation requests with penalty and room release."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import ntz
from innsight.functions.expressions import SUM_MONEY
from innsight.plans._common import dedupe_requests, first_reason, known, mark_first, new_id, split
from innsight.plans.rooms import move_rooms
from innsight.schemas import DIAS_SIN_PENALIZACION, RESERVA_FINAL, TASA_PENALIZACION
from innsight.session import checkpoint
from innsight.tables import Delta, Hotel


def cancel(hotel: Hotel, requests: DataFrame, now: dt.datetime, strict_release: bool = False) -> Delta:
    """Requests (request_id, arrival, id_reservacion, id_usuario, motivo).

    Of several requests for one booking the earliest counts; the booking is in a
    final state for the others.
    """
    requests, repeats = dedupe_requests(requests)
    bookings = hotel.reservacion.select("id_reservacion", "fecha_inicio", F.col("estado").alias("_estado"))
    judged = (
        requests.select("request_id", "arrival", "id_reservacion", "id_usuario", "motivo")
        .join(bookings, "id_reservacion", "left")
        .join(known(hotel.usuario, "id_usuario", "_usuario"), "id_usuario", "left")
        .join(known(hotel.cancelacion, "id_reservacion", "_cancelada"), "id_reservacion", "left")
        .withColumn(
            "motivo_rechazo",
            first_reason(
                ("unknown_booking", F.col("_estado").isNull()),
                ("final_state", F.col("_estado").isin(*RESERVA_FINAL)),
                ("already_cancelled", F.col("_cancelada").isNotNull()),
                ("unknown_user", F.col("_usuario").isNull()),
                ("missing_reason", F.col("motivo").isNull()),
            ),
        )
    )
    candidates, refused = split(checkpoint(judged))
    ranked = mark_first(candidates, "id_reservacion")
    late = ranked.filter(~F.col("es_primera")).select("request_id", F.lit("final_state").alias("motivo_rechazo"))
    accepted = ranked.filter("es_primera").withColumn("fecha_cancelacion", ntz(now))
    effects = cancellation_effects(hotel, accepted, now, strict_release)
    return Delta(effects.inserts, effects.updates, refused.unionByName(late).unionByName(repeats))


def cancellation_effects(
    hotel: Hotel, cancellations: DataFrame, now: dt.datetime, strict_release: bool = False
) -> Delta:
    """Penalty, booking state and room release of accepted cancellations.

    ``cancellations`` holds one row per booking: (request_id, id_reservacion,
    id_usuario, motivo, fecha_inicio, fecha_cancelacion). Less than seven days
    of notice costs a share of the booked rooms. Booked rooms that are ocupada
    become disponible, by ``strict_release`` only those without another open stay.
    """
    booked = hotel.reservacion_habitacion.join(
        cancellations.select("id_reservacion"), "id_reservacion", "left_semi"
    ).select("id_reservacion", "id_habitacion", "subtotal")
    amounts = booked.groupBy("id_reservacion").agg(F.sum("subtotal").alias("_suma"))
    notice = F.datediff("fecha_inicio", F.col("fecha_cancelacion").cast("date"))
    nothing = F.lit(0).cast(SUM_MONEY)
    share = F.coalesce(F.col("_suma").cast(SUM_MONEY), nothing) * F.lit(TASA_PENALIZACION).cast("decimal(3,2)")
    penalty = F.round(share, 2).cast(SUM_MONEY)
    rows = cancellations.join(amounts, "id_reservacion", "left").select(
        new_id("cancelacion", "id_reservacion").alias("id_cancelacion"),
        "id_reservacion",
        "id_usuario",
        "motivo",
        F.when(notice < DIAS_SIN_PENALIZACION, penalty).otherwise(nothing).alias("penalizacion"),
        "fecha_cancelacion",
    )
    bookings = (
        hotel.reservacion.filter(F.col("estado") != "cancelada")
        .join(cancellations.select("id_reservacion"), "id_reservacion", "left_semi")
        .withColumn("estado", F.lit("cancelada"))
        .select(*hotel.reservacion.columns)
    )
    released = booked.select("id_habitacion").distinct()
    if strict_release:
        others = (
            hotel.estancia.filter(F.col("fecha_hora_checkout_real").isNull())
            .join(cancellations.select("id_reservacion"), "id_reservacion", "left_anti")
            .select("id_habitacion")
        )
        released = released.join(others, "id_habitacion", "left_anti")
    moved = move_rooms(hotel, released, ("ocupada",), "disponible", ntz(now))
    return Delta({"cancelacion": rows, **moved.inserts}, {"reservacion": bookings, **moved.updates})
