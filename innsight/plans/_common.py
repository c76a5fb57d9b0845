"""Pieces every batch applier uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions import month_nights, nights
from innsight.schemas import RESERVA_LIBERADA
from innsight.session import checkpoint
from innsight.tables import Hotel

ROOM_NIGHT = ["id_habitacion", "noche"]


def new_id(kind: str, *columns: str) -> Column:
    """Positive surrogate key hashed from the request, the same on every retry."""
    return F.xxhash64(F.lit(kind), *[F.col(c) for c in columns]).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that refuses the row, NULL when none does."""
    return F.coalesce(*[F.when(refuses, F.lit(name)) for name, refuses in rules])


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a ``motivo_rechazo``, and (request_id, motivo_rechazo) of the others.

    Appliers checkpoint what they pass here: every table of a ``Delta`` then
    starts from the judged requests instead of judging them again.
    """
    reason = F.col("motivo_rechazo")
    return judged.filter(reason.isNull()), judged.filter(reason.isNotNull()).select("request_id", "motivo_rechazo")


def valid_range() -> Column:
    """Whether the stay ends after it begins; a missing date makes it false."""
    return F.coalesce(F.col("fecha_salida") > F.col("fecha_inicio"), F.lit(False))


def dedupe_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of each request id, and the others with their reason.

    A request delivered twice is carried out once: of the rows of an id the
    earliest stays, of equally early ones the least in its other columns, and the
    rest is refused as ``duplicate_request``. Rows without an id are refused as
    ``missing_request_id``. Rows of one id are combined inside each task first.
    """
    others = [c for c in requests.columns if c != "request_id"]
    order = [F.col("arrival").isNull().alias("_tarde"), F.col("arrival").alias("_llegada")] if "arrival" in others else []
    least = F.min(F.struct(*order, *[F.col(c) for c in others])).alias("_fila")
    named = requests.filter(F.col("request_id").isNotNull())
    counted = checkpoint(named.groupBy("request_id").agg(least, F.count(F.lit(1)).alias("_veces")))
    first = counted.select("request_id", *[F.col(f"_fila.{c}").alias(c) for c in others])
    again = counted.filter("_veces > 1").select(
        "request_id", F.explode(F.expr("array_repeat('duplicate_request', cast(_veces - 1 as int))")).alias("motivo_rechazo")
    )
    nameless = requests.filter(F.col("request_id").isNull()).select(
        "request_id", F.lit("missing_request_id").alias("motivo_rechazo")
    )
    return first.select(*requests.columns), again.unionByName(nameless)


def known(df: DataFrame, column: str, flag: str) -> DataFrame:
    """The keys of ``df`` with a marker column, for a left join that tests existence."""
    return df.select(column).distinct().withColumn(flag, F.lit(True))


def arrival_order() -> Column:
    return F.struct("arrival", "request_id")


def mark_first(requests: DataFrame, key: str) -> DataFrame:
    """``requests`` with ``es_primera``: the earliest request of its key.

    The minimum is combined inside each task before the shuffle; the way back
    joins on the unique request id.
    """
    first = (
        requests.groupBy(key)
        .agg(F.min(arrival_order()).alias("p"))
        .select(F.col("p.request_id").alias("request_id"), F.lit(True).alias("_p"))
    )
    return requests.join(first, "request_id", "left").withColumn("es_primera", F.col("_p").isNotNull()).drop("_p")


def live_bookings(hotel: Hotel, span: DataFrame | None = None) -> DataFrame:
    """Bookings that hold a room: neither cancelled nor expired.

    ``span`` holds the asked-for dates; its two extremes become scan filters.
    """
    live = hotel.reservacion.filter(~F.col("estado").isin(*RESERVA_LIBERADA)).select(
        "id_reservacion", "fecha_inicio", "fecha_salida"
    )
    if span is not None:
        live = live.filter(
            (F.col("fecha_inicio") < span.agg(F.max("fecha_salida")).scalar())
            & (F.col("fecha_salida") > span.agg(F.min("fecha_inicio")).scalar())
        )
    return live


def held_months(hotel: Hotel, spans: DataFrame) -> DataFrame:
    """Calendar of the rooms and dates of ``spans``: one row per (room, month) with a bit per held night.

    Only bookings of asked rooms, between the earliest and the latest asked date,
    are read into it; each makes one row per month it touches.
    """
    first, last = spans.agg(F.min("fecha_inicio"), F.max("fecha_salida")).first()
    live = hotel.reservacion.filter(~F.col("estado").isin(*RESERVA_LIBERADA))
    live = live.filter((F.col("fecha_inicio") < F.lit(last)) & (F.col("fecha_salida") > F.lit(first)))
    rooms = hotel.reservacion_habitacion.select("id_reservacion", "id_habitacion")
    return (
        rooms.join(spans.select("id_habitacion").distinct(), "id_habitacion", "left_semi")
        .join(live.select("id_reservacion", "fecha_inicio", "fecha_salida"), "id_reservacion")
        .select("id_habitacion", month_nights("fecha_inicio", "fecha_salida").alias("m"))
        .groupBy("id_habitacion", F.col("m.mes").alias("mes"))
        .agg(F.bit_or("m.mascara").alias("ocupadas"))
    )


def held_room_nights(hotel: Hotel, span: DataFrame | None = None) -> DataFrame:
    """One row per held (room, night), with the lowest and highest booking holding it."""
    rooms = hotel.reservacion_habitacion.select("id_reservacion", "id_habitacion")
    return (
        rooms.join(live_bookings(hotel, span), "id_reservacion")
        .select("id_reservacion", "id_habitacion", F.explode(nights("fecha_inicio", "fecha_salida")).alias("noche"))
        .groupBy(*ROOM_NIGHT)
        .agg(F.min("id_reservacion").alias("reserva_menor"), F.max("id_reservacion").alias("reserva_mayor"))
    )
