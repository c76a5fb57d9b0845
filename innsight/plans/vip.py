"""Loyalty: enrolment, counters, recomputation and upgrades."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions import field_rank, greatest_strict, nights, vip_level
from innsight.plans._common import (
    ROOM_NIGHT,
    dedupe_requests,
    first_reason,
    held_room_nights,
    live_bookings,
    mark_first,
    new_id,
    split,
)
from innsight.schemas import HABITACION_ASIGNABLE, NIVELES_VIP, RESERVA_LIBERADA
from innsight.session import checkpoint
from innsight.tables import Delta, Hotel


def enrol_vip(hotel: Hotel, new_payers: DataFrame, today: dt.date) -> Delta:
    """New payers start as bronce with zeros; those already enrolled are left alone."""
    fresh = new_payers.select("id_huesped_facturador").distinct().join(
        hotel.cliente_vip.select("id_huesped_facturador"), "id_huesped_facturador", "left_anti"
    )
    zero = F.lit(0).cast("long")
    rows = fresh.select(
        new_id("vip", "id_huesped_facturador").alias("id_vip"),
        "id_huesped_facturador",
        F.lit("bronce").alias("nivel_vip"),
        zero.alias("puntos_acumulados"),
        zero.alias("contador_reservas"),
        F.lit(today).alias("fecha_registro"),
    )
    return Delta(inserts={"cliente_vip": rows})


def booking_increments(bookings: DataFrame) -> DataFrame:
    """Per payer: number of new bookings and points, floored booking by booking."""
    points = greatest_strict(F.floor(F.col("total") / 100), F.lit(0).cast("long"))
    return bookings.groupBy("id_huesped_facturador").agg(
        F.count("*").alias("nuevas"), F.sum(points).cast("long").alias("puntos")
    )


def count_bookings(
    hotel: Hotel, bookings: DataFrame, legacy_thresholds: bool = False, keep_higher: bool = False
) -> Delta:
    """Counters, points and level after new bookings of any state.

    The count decides the level from the lowest threshold on, below it the level
    stays. ``legacy_thresholds`` fires one booking early, as an update that reads
    its own increment does; ``keep_higher`` never lowers a level.
    """
    added = booking_increments(bookings)
    payers = hotel.huesped_facturador.join(added, "id_huesped_facturador").withColumn(
        "numero_reservas", F.col("numero_reservas") + F.col("nuevas")
    )
    level = vip_level(F.col("_cuenta"), F.col("nivel_vip"), 1 if legacy_thresholds else 0)
    if keep_higher:
        rises = field_rank(level, NIVELES_VIP) > field_rank("nivel_vip", NIVELES_VIP)
        level = F.when(rises, level).otherwise(F.col("nivel_vip"))
    vips = (
        hotel.cliente_vip.join(added, "id_huesped_facturador")
        .withColumn("_cuenta", F.col("contador_reservas") + F.col("nuevas"))
        .withColumn("nivel_vip", level)
        .withColumn("contador_reservas", F.col("_cuenta"))
        .withColumn("puntos_acumulados", F.col("puntos_acumulados") + F.col("puntos"))
    )
    return Delta(
        updates={
            "huesped_facturador": payers.select(*hotel.huesped_facturador.columns),
            "cliente_vip": vips.select(*hotel.cliente_vip.columns),
        }
    )


def recompute_vip(hotel: Hotel, today: dt.date, payers: DataFrame | None = None) -> Delta:
    """Level, points and counter from the booking history; missing members are enrolled.

    Runs for all payers unless ``payers`` (id_huesped_facturador) narrows it.
    """
    wanted = (hotel.huesped_facturador if payers is None else payers).select("id_huesped_facturador").distinct()
    history = (
        hotel.reservacion.filter(~F.col("estado").isin(*RESERVA_LIBERADA))
        .groupBy("id_huesped_facturador")
        .agg(F.count("*").alias("_n"), F.sum("total").alias("_gasto"))
    )
    count = F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    spent = F.coalesce(F.col("_gasto"), F.lit(0).cast("decimal(22,2)"))
    fresh = (
        wanted.join(history, "id_huesped_facturador", "left")
        .select(
            "id_huesped_facturador",
            vip_level(count, F.lit("bronce")).alias("nivel_vip"),
            F.floor(spent / 100).cast("long").alias("puntos_acumulados"),
            count.alias("contador_reservas"),
        )
        .join(hotel.cliente_vip.select("id_vip", "id_huesped_facturador", "fecha_registro"), "id_huesped_facturador", "left")
    )
    columns = hotel.cliente_vip.columns
    enrolled = F.col("id_vip").isNotNull()
    new = (
        fresh.filter(~enrolled)
        .withColumn("id_vip", new_id("vip", "id_huesped_facturador"))
        .withColumn("fecha_registro", F.lit(today))
    )
    return Delta({"cliente_vip": new.select(*columns)}, {"cliente_vip": fresh.filter(enrolled).select(*columns)})


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``lugar``: 0, 1, 2, ... in the given order, without a one-task sort.

    Rows are range-partitioned and sorted per partition; only the number of rows
    of each partition visits the driver, to become the partition's offset.
    """
    spark = rows.sparkSession
    local = checkpoint(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_parte", F.shiftrightunsigned("_id", 33))
    )
    sizes = {r["_parte"]: r["count"] for r in local.groupBy("_parte").count().collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    base = spark.createDataFrame(offsets, "_parte long, _base long")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return local.join(F.broadcast(base), "_parte").withColumn("lugar", F.col("_base") + inside).drop(
        "_id", "_parte", "_base"
    )


def _ladder(hotel: Hotel) -> tuple[DataFrame, DataFrame]:
    """Assignable rooms by category price, and where on it each price's upgrades start."""
    prices = hotel.categoria_habitacion.select("id_categoria", "precio_base")
    rooms = (
        hotel.habitacion.filter(F.col("estado").isin(*HABITACION_ASIGNABLE))
        .select("id_habitacion", "id_categoria")
        .join(prices, "id_categoria")
        .select("precio_base", "id_habitacion")
    )
    ladder = checkpoint(positions(rooms, "precio_base", "id_habitacion"))
    first = ladder.groupBy("precio_base").agg(F.min("lugar").alias("primero"))
    # One row per distinct category price: as many as there are categories at most.
    dearer = Window.orderBy(F.desc("precio_base")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        prices.select("precio_base")
        .distinct()
        .join(first, "precio_base", "left")
        .select("precio_base", F.min("primero").over(dearer).alias("desde"))
        .filter(F.col("desde").isNotNull())
    )
    return ladder, starts


def _judge_upgrades(hotel: Hotel, requests: DataFrame) -> DataFrame:
    """Requests with their booking's dates and cheapest booked category, or a ``motivo_rechazo``."""
    booked = (
        hotel.reservacion_habitacion.select("id_reservacion", "id_habitacion")
        .join(hotel.habitacion.select("id_habitacion", "id_categoria"), "id_habitacion")
        .join(hotel.categoria_habitacion.select("id_categoria", "precio_base"), "id_categoria")
        .groupBy("id_reservacion")
        .agg(F.min("precio_base").alias("precio_base"))
    )
    bookings = hotel.reservacion.select("id_reservacion", "id_huesped_facturador", "fecha_inicio", "fecha_salida")
    levels = hotel.cliente_vip.select("id_huesped_facturador", "nivel_vip")
    return (
        requests.select("request_id", "arrival", "id_reservacion")
        .join(bookings, "id_reservacion", "left")
        .join(levels, "id_huesped_facturador", "left")
        .join(booked, "id_reservacion", "left")
        .withColumn(
            "motivo_rechazo",
            first_reason(
                ("not_vip", F.col("nivel_vip").isNull() | F.col("precio_base").isNull()),
                ("level_too_low", ~F.col("nivel_vip").isin("oro", "platino")),
            ),
        )
    )


def propose_upgrades(hotel: Hotel, requests: DataFrame, probe: int = 8) -> DataFrame:
    """Requests (request_id, arrival, id_reservacion) with ``id_habitacion_nueva``.

    Each request is judged alone against the stored bookings: the room of the
    cheapest dearer category, lowest id first, that is free for its dates; NULL
    when there is none or with a ``motivo_rechazo``.

    Rooms stand on one ladder ordered by price. A request climbs from the first
    dearer room; each round tests the next stretch of rooms for those still
    climbing and doubles the stretch, so the work is at most twice the climb.
    """
    judged = checkpoint(_judge_upgrades(hotel, requests))
    eligible = judged.filter(F.col("motivo_rechazo").isNull())
    ladder, starts = _ladder(hotel)
    top = ladder.agg(F.max("lugar")).first()[0]
    climbing = checkpoint(
        eligible.join(starts, "precio_base").select(
            "request_id", "id_reservacion", "fecha_inicio", "fecha_salida", "desde"
        )
    )
    held = checkpoint(held_room_nights(hotel, eligible))
    found = []
    while top is not None and not climbing.isEmpty():
        stretch = F.sequence(F.col("desde"), F.least(F.col("desde") + probe - 1, F.lit(top)))
        tried = climbing.withColumn("lugar", F.explode(stretch)).join(ladder.drop("precio_base"), "lugar")
        other = (F.col("reserva_menor") != F.col("id_reservacion")) | (F.col("reserva_mayor") != F.col("id_reservacion"))
        blocked = (
            tried.withColumn("noche", F.explode(nights("fecha_inicio", "fecha_salida")))
            .join(held, ROOM_NIGHT)
            .filter(other)
            .select("request_id", "lugar")
            .distinct()
        )
        free = tried.join(blocked, ["request_id", "lugar"], "left_anti")
        best = free.groupBy("request_id").agg(
            F.min(F.struct("lugar", "id_habitacion")).getField("id_habitacion").alias("id_habitacion_nueva")
        )
        step = checkpoint(climbing.join(best, "request_id", "left"))
        found.append(step.filter(F.col("id_habitacion_nueva").isNotNull()).select("request_id", "id_habitacion_nueva"))
        climbing = (
            step.filter(F.col("id_habitacion_nueva").isNull())
            .withColumn("desde", F.col("desde") + probe)
            .filter(F.col("desde") <= top)
            .drop("id_habitacion_nueva")
        )
        probe *= 2
    none = judged.select("request_id", F.lit(None).cast("long").alias("id_habitacion_nueva")).limit(0)
    chosen = reduce(DataFrame.unionByName, found, none)
    return judged.join(chosen, "request_id", "left").select(
        "request_id", "arrival", "id_reservacion", "fecha_inicio", "fecha_salida", "id_habitacion_nueva", "motivo_rechazo"
    )


#: Days that one task assigns; requests belong to the block in which they begin.
BLOCK_DAYS = 16

_SIDE = (
    "bloque long, clase int, orden long, id_reservacion long, lugar long, ini long, fin long, desde long, viva boolean"
)
#: Rows of a block: its requests, rooms of the ladder, stored bookings of these rooms.
PEDIDO, CUARTO, GUARDADA = range(3)


def assign_in_order(requests, rooms, stored, others):
    """First free room of each request of a block, in order of arrival; tuples in, ``(orden, lugar)`` out.

    ``requests`` are (orden, booking, ini, fin, desde, live), ``rooms`` the
    sorted places of the ladder, ``stored`` (booking, lugar, ini, fin) the live
    bookings of these rooms, ``others`` (orden, booking, ini, fin, lugar, live) the
    requests of other blocks with the rooms they have so far.
    """
    turn = {booking: orden for orden, booking, *_ in (*requests, *others)}
    moved = {booking for _, booking, _, _, lugar, _ in others if lugar is not None}
    held: dict[int, list[tuple]] = {}
    for booking, lugar, ini, fin in stored:
        held.setdefault(lugar, []).append((booking, ini, fin))
    taken: dict[int, list[tuple]] = {}
    for orden, _, ini, fin, lugar, live in others:
        if lugar is not None and live:
            taken.setdefault(lugar, []).append((orden, ini, fin))
    found = []
    for orden, booking, ini, fin, desde, live in sorted(requests):

        def blocked(lugar: int) -> bool:
            if ini is None or fin is None:
                return False
            return any(a < fin and b > ini and first < orden for first, a, b in taken.get(lugar, ())) or any(
                a < fin and b > ini and other != booking and not (other in moved and turn[other] < orden)
                for other, a, b in held.get(lugar, ())
            )

        pick = next((lugar for lugar in rooms[bisect_left(rooms, desde) :] if not blocked(lugar)), None)
        found.append((orden, pick))
        if pick is not None:
            moved.add(booking)
            if live and ini is not None and fin is not None:
                taken.setdefault(pick, []).append((orden, ini, fin))
    return found


def _solve(block, others):
    import pandas as pd

    def rows(frame, *columns):
        clean = frame[list(columns)].astype(object)
        return list(clean.where(clean.notna(), None).itertuples(index=False, name=None))

    found = assign_in_order(
        rows(block[block.clase == PEDIDO], "orden", "id_reservacion", "ini", "fin", "desde", "viva"),
        sorted(block[block.clase == CUARTO].lugar.astype("int64")),
        rows(block[block.clase == GUARDADA], "id_reservacion", "lugar", "ini", "fin"),
        rows(others, "orden", "id_reservacion", "ini", "fin", "lugar", "viva"),
    )
    out = pd.DataFrame(found, columns=["orden", "lugar"])
    return out.astype({"orden": "int64", "lugar": "Int64"})


def _blocks(start: str, end: str) -> Column:
    """Blocks that a stay touches; a stay without dates is in block null."""
    first = F.floor(F.col(start) / BLOCK_DAYS)
    return F.explode_outer(F.sequence(first, F.greatest(first, F.floor((F.col(end) - 1) / BLOCK_DAYS))))


def _assignment(hotel: Hotel, eligible: DataFrame) -> DataFrame:
    """``orden, lugar`` of each eligible request, as one call after the other would choose.

    A request depends on the earlier ones that overlap it. Blocks of days are
    settled side by side, each in order of arrival, against the rooms that the
    requests of other blocks have so far; that is repeated until no room
    changes. Whatever no longer changes satisfies each request's rule, and only
    the rooms chosen one by one do, for each request's rule names earlier ones
    alone. Changes pass from block to block only through stays over a border,
    so few repetitions are needed.
    """
    day = lambda c: F.datediff(F.col(c), F.lit(dt.date(1970, 1, 1))).cast("long")
    ladder, starts = _ladder(hotel)
    asked = eligible.join(starts, "precio_base").select(
        "orden", "id_reservacion", day("fecha_inicio").alias("ini"), day("fecha_salida").alias("fin"), "desde",
        (~F.col("estado").isin(*RESERVA_LIBERADA)).alias("viva"),
    )
    asked = checkpoint(asked.withColumn("hogar", F.coalesce(F.floor(F.col("ini") / BLOCK_DAYS), F.lit(-(1 << 40)))))
    # which blocks must know what happens in block ``b``: those with a request that reaches it
    reach = asked.select(_blocks("ini", "fin").alias("b"), F.col("hogar").alias("bloque")).distinct()
    reach = checkpoint(reach.filter("b is not null"))
    live = live_bookings(hotel).select("id_reservacion", day("fecha_inicio").alias("ini"), day("fecha_salida").alias("fin"))
    held = (
        hotel.reservacion_habitacion.select("id_reservacion", "id_habitacion")
        .join(ladder.select("id_habitacion", "lugar"), "id_habitacion")
        .join(live, "id_reservacion")
        .select("id_reservacion", "lugar", "ini", "fin", _blocks("ini", "fin").alias("b"))
        .join(reach, "b")
        .drop("b")
        .distinct()
    )
    # as many blocks as the calendar of the requests has
    blocks = [r.hogar for r in asked.select("hogar").distinct().collect()]
    rooms = ladder.select("lugar", F.explode(F.array(*map(F.lit, blocks)).cast("array<long>")).alias("bloque"))
    parts = (
        asked.withColumnRenamed("hogar", "bloque").withColumn("clase", F.lit(PEDIDO)),
        rooms.withColumn("clase", F.lit(CUARTO)),
        held.withColumn("clase", F.lit(GUARDADA)),
    )
    empty = asked.sparkSession.createDataFrame([], _SIDE)
    fixed = checkpoint(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts, empty))
    picks = asked.select("orden", F.lit(None).cast("long").alias("lugar"))
    while True:
        others = (
            asked.join(picks, "orden")
            .select("orden", "id_reservacion", "ini", "fin", "lugar", "viva", "hogar", _blocks("ini", "fin").alias("b"))
            .join(reach.withColumnRenamed("bloque", "destino"), "b")
            .filter("hogar <> destino")
            .drop("b", "hogar")
            .distinct()
        )
        settled = checkpoint(
            fixed.groupBy("bloque").cogroup(others.groupBy("destino")).applyInPandas(_solve, "orden long, lugar long")
        )
        before = picks.withColumnRenamed("lugar", "antes")
        if settled.join(before, "orden").filter(~F.col("lugar").eqNullSafe(F.col("antes"))).isEmpty():
            return settled.join(ladder.select("lugar", F.col("id_habitacion").alias("id_habitacion_nueva")), "lugar")
        picks = settled


def upgrade(hotel: Hotel, requests: DataFrame) -> Delta:
    """Move booked rooms to the upgrade that one request after the other would get; rate and subtotal stay.

    Each request, in order of arrival, takes the first room of a dearer category
    that is free for its dates of stored bookings and of earlier moves; rooms
    that earlier moves left are free. Of several requests for one booking the
    earliest counts. Requests without a better room change nothing.
    """
    requests, repeats = dedupe_requests(requests)
    ranked = mark_first(requests.filter("id_reservacion is not null"), "id_reservacion")
    first = ranked.filter("es_primera").select(*requests.columns).unionByName(requests.filter("id_reservacion is null"))
    again = ranked.filter(~F.col("es_primera")).select("request_id", F.lit("duplicate_request").alias("motivo_rechazo"))
    judged = checkpoint(_judge_upgrades(hotel, first))
    eligible, refused = judged.filter(F.col("motivo_rechazo").isNull()), split(judged)[1]
    states = hotel.reservacion.select("id_reservacion", "estado")
    ordered = positions(
        eligible.join(states, "id_reservacion").withColumn("_sin", F.col("arrival").isNull()), "_sin", "arrival", "request_id"
    ).withColumnRenamed("lugar", "orden")
    moves = ordered.select("orden", "id_reservacion").join(_assignment(hotel, ordered), "orden")
    base = hotel.reservacion_habitacion
    rows = base.join(moves.select("id_reservacion", "id_habitacion_nueva"), "id_reservacion").withColumn(
        "id_habitacion", F.col("id_habitacion_nueva")
    )
    rejected = refused.unionByName(again).unionByName(repeats)
    return Delta(updates={"reservacion_habitacion": rows.select(*base.columns)}, rejected=rejected)
