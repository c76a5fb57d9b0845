"""Room state: requested changes, check-ins and the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions import ntz
from innsight.plans._common import dedupe_requests, first_reason, known, mark_first, new_id, split
from innsight.schemas import ESTADOS_HABITACION, HABITACION_ASIGNABLE
from innsight.session import checkpoint
from innsight.tables import Delta, Hotel


def previous_value(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``anterior``: the value of the row before it within its key.

    A scan in pieces: rows are dealt by ranges of key and order, so a key with a
    long history, or with all of its events at one moment, lies in several
    pieces. Inside a piece a window finds the predecessor; from piece to piece
    only the last value of each key travels, one row per key and piece. Null
    keys are one key; nulls in ``order`` come first.
    """
    dealt = rows.repartitionByRange(key, *order).withColumn("_tramo", F.spark_partition_id())
    # ranges are drawn from a sample: both uses below must see the same ones
    pieces = checkpoint(dealt)
    inside = Window.partitionBy(key, "_tramo").orderBy(*order)
    closing = pieces.groupBy(key, "_tramo").agg(F.max(F.struct(*order, value)).alias("_u"))
    carried = closing.select(
        F.col(key).alias("_clave"),
        F.col("_tramo").alias("_pieza"),
        F.lag(F.col(f"_u.{value}")).over(Window.partitionBy(key).orderBy("_tramo")).alias("_previo"),
    )
    same = F.col(key).eqNullSafe(F.col("_clave")) & (F.col("_tramo") == F.col("_pieza"))
    first = F.row_number().over(inside) == 1
    return (
        pieces.withColumn("_dentro", F.lag(value).over(inside))
        .withColumn("_primera", first)
        .join(carried, same, "left")
        .withColumn("anterior", F.when(F.col("_primera"), F.col("_previo")).otherwise(F.col("_dentro")))
        .drop("_tramo", "_dentro", "_previo", "_primera", "_clave", "_pieza")
    )


def refused_events(events: DataFrame) -> DataFrame:
    """Events without a room or a time, with their reason: they have no place in a room's history."""
    reason = first_reason(
        ("missing_room", F.col("id_habitacion").isNull()), ("missing_time", F.col("fecha_hora").isNull())
    )
    return split(events.withColumn("motivo_rechazo", reason))[1]


def room_state_log(events: DataFrame) -> DataFrame:
    """Real state changes of an ordered feed (request_id, id_habitacion, estado, fecha_hora).

    The first event of a room sets its state and logs nothing. Events without a
    room or a time are left out (``refused_events``).
    """
    placed = events.filter(F.col("id_habitacion").isNotNull() & F.col("fecha_hora").isNotNull())
    chained = previous_value(placed, "id_habitacion", ["fecha_hora", "request_id"], "estado")
    return chained.filter(F.col("anterior") != F.col("estado")).select(
        "request_id",
        "id_habitacion",
        F.col("anterior").alias("estado_anterior"),
        F.col("estado").alias("estado_nuevo"),
        "fecha_hora",
    )


def log_rows(changes: DataFrame, *id_columns: str) -> DataFrame:
    """Audit rows of changes whose state really moved."""
    return changes.filter(F.col("estado_anterior") != F.col("estado_nuevo")).select(
        new_id("bitacora", *id_columns).alias("id_bitacora"),
        "id_habitacion",
        "id_empleado",
        "id_reservacion",
        "estado_anterior",
        "estado_nuevo",
        "fecha_hora",
    )


def move_rooms(hotel: Hotel, rooms: DataFrame, before: tuple[str, ...], after: str, when: Column) -> Delta:
    """Put ``rooms`` (id_habitacion) that are in a state of ``before`` into ``after``, and log it."""
    moved = hotel.habitacion.filter(F.col("estado").isin(*before)).join(
        rooms.select("id_habitacion"), "id_habitacion", "left_semi"
    )
    log = log_rows(
        moved.select(
            "id_habitacion",
            F.lit(None).cast("long").alias("id_empleado"),
            F.lit(None).cast("long").alias("id_reservacion"),
            F.col("estado").alias("estado_anterior"),
            F.lit(after).alias("estado_nuevo"),
            when.alias("fecha_hora"),
        ),
        "id_habitacion",
        "fecha_hora",
    )
    updated = moved.withColumn("estado", F.lit(after)).select(*hotel.habitacion.columns)
    return Delta(inserts={"bitacora_habitacion": log}, updates={"habitacion": updated})


def set_room_state(hotel: Hotel, requests: DataFrame) -> Delta:
    """Requests (request_id, arrival, id_habitacion, estado, id_empleado, id_reservacion).

    The last request per room decides its state; every step on the way is logged.
    A request for an unknown room or without an arrival time changes nothing
    and is refused.
    """
    requests, repeats = dedupe_requests(requests)
    rooms = hotel.habitacion.select("id_habitacion", F.col("estado").alias("estado_actual"))
    judged = requests.join(rooms, "id_habitacion", "left").withColumn(
        "motivo_rechazo",
        first_reason(
            ("invalid_state", ~F.coalesce(F.col("estado").isin(*ESTADOS_HABITACION), F.lit(False))),
            ("unknown_room", F.col("estado_actual").isNull()),
            ("missing_arrival", F.col("arrival").isNull()),
        ),
    )
    valid, rejected = split(checkpoint(judged))
    chained = previous_value(valid, "id_habitacion", ["arrival", "request_id"], "estado")
    log = log_rows(
        chained.select(
            "request_id",
            "id_habitacion",
            "id_empleado",
            "id_reservacion",
            F.coalesce("anterior", "estado_actual").alias("estado_anterior"),
            F.col("estado").alias("estado_nuevo"),
            F.col("arrival").alias("fecha_hora"),
        ),
        "request_id",
    )
    last = (
        valid.groupBy("id_habitacion")
        .agg(F.max(F.struct("arrival", "request_id", "estado")).alias("u"))
        .select("id_habitacion", F.col("u.estado").alias("_nuevo"))
    )
    updated = (
        hotel.habitacion.join(last, "id_habitacion")
        .filter(F.col("estado") != F.col("_nuevo"))
        .withColumn("estado", F.col("_nuevo"))
        .select(*hotel.habitacion.columns)
    )
    return Delta({"bitacora_habitacion": log}, {"habitacion": updated}, rejected.unionByName(repeats))


def check_in(hotel: Hotel, requests: DataFrame, now: dt.datetime) -> Delta:
    """Requests (request_id, arrival, id_reservacion, id_empleado, id_habitacion) open stays.

    A room takes one check-in: it must be assignable, and the earliest request
    of the batch makes it ocupada for the others.
    """
    requests, repeats = dedupe_requests(requests)
    rooms = hotel.habitacion.select("id_habitacion", "estado")
    bookings = hotel.reservacion.select("id_reservacion", F.col("fecha_salida").alias("_salida"))
    staff = known(hotel.empleado, "id_empleado", "_empleado")
    judged = (
        requests.join(rooms, "id_habitacion", "left")
        .join(bookings, "id_reservacion", "left")
        .join(staff, "id_empleado", "left")
        .withColumn("_programado", F.col("_salida").cast("timestamp_ntz") + F.expr("interval 12 hours"))
        .withColumn(
            "motivo_rechazo",
            first_reason(
                ("room_not_assignable", F.col("estado").isNotNull() & ~F.col("estado").isin(*HABITACION_ASIGNABLE)),
                ("unknown_room", F.col("estado").isNull()),
                ("unknown_booking", F.col("_salida").isNull()),
                ("unknown_employee", F.col("_empleado").isNull()),
                ("checkout_not_after_checkin", F.col("_programado") <= ntz(now)),
            ),
        )
    )
    candidates, refused = split(checkpoint(judged))
    ranked = mark_first(candidates, "id_habitacion")
    accepted = ranked.filter("es_primera")
    late = ranked.filter(~F.col("es_primera")).select("request_id", F.lit("room_not_assignable").alias("motivo_rechazo"))
    stays = accepted.select(
        new_id("estancia", "request_id").alias("id_estancia"),
        "id_reservacion",
        "id_empleado",
        "id_habitacion",
        ntz(now).alias("fecha_hora_checkin"),
        F.col("_programado").alias("fecha_hora_checkout_programado"),
        F.lit(None).cast("timestamp_ntz").alias("fecha_hora_checkout_real"),
    )
    moved = move_rooms(hotel, accepted, HABITACION_ASIGNABLE, "ocupada", ntz(now))
    return Delta({"estancia": stays, **moved.inserts}, moved.updates, refused.unionByName(late).unionByName(repeats))
