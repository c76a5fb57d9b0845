"""Running booking counters per payer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.functions import vip_level
from innsight.plans.vip import booking_increments
from innsight.streaming._common import LatestRows, drain, each_batch


def booking_counters_stream(bookings: DataFrame) -> DataFrame:
    """Streaming count and points per payer (update mode); partial sums form before the shuffle."""
    return booking_increments(bookings)


def _kept(spark: SparkSession, root: str) -> LatestRows:
    return LatestRows(
        spark, f"{root}/contadores", ["id_huesped_facturador"], "id_huesped_facturador long, nuevas long, puntos long"
    )


def run_booking_counters(bookings: DataFrame, root: str) -> None:
    """Consume the available bookings; each batch stores the payers it changed."""
    kept = _kept(bookings.sparkSession, root)
    drain(each_batch(booking_counters_stream(bookings), kept.write, "update"), f"{root}/control")


def booking_counters(spark: SparkSession, root: str) -> DataFrame:
    """Latest counters per payer with the level they reach."""
    return _kept(spark, root).read().select(
        "id_huesped_facturador",
        F.col("nuevas").alias("contador_reservas"),
        F.col("puntos").alias("puntos_acumulados"),
        vip_level(F.col("nuevas"), F.lit("bronce")).alias("nivel_vip"),
    )
