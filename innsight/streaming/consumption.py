"""Service consumption: validation and windowed totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.plans.services import validate_consumption
from innsight.streaming._common import LatestRows, drain, each_batch, put


def run_consumption_validator(consumption: DataFrame, root: str) -> None:
    """Split the available rows into ``validos`` and ``rechazados``, batch by batch."""

    def work(rows: DataFrame, batch: int) -> None:
        good, bad = validate_consumption(rows)
        put(good, f"{root}/validos", batch)
        put(bad, f"{root}/rechazados", batch)

    drain(each_batch(consumption, work), f"{root}/control")


def consumption_by_service_window(consumption: DataFrame, width: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Uses, units and amount per service and tumbling window.

    A watermark needs zoned time, so the zone-less column is cast in front of
    it. Rows for a window whose end the watermark has passed are dropped.
    """
    amount = F.col("cantidad") * F.col("precio_unitario")
    return (
        consumption.withColumn("momento", F.col("fecha_hora").cast("timestamp"))
        .withWatermark("momento", delay)
        .groupBy(F.window("momento", width).alias("ventana"), "id_servicio")
        .agg(
            F.count("*").alias("veces_consumido"),
            F.sum("cantidad").alias("unidades"),
            F.sum(amount).cast("decimal(22,2)").alias("importe_total"),
        )
        .select(
            F.col("ventana.start").cast("timestamp_ntz").alias("desde"),
            F.col("ventana.end").cast("timestamp_ntz").alias("hasta"),
            "id_servicio",
            "veces_consumido",
            "unidades",
            "importe_total",
        )
    )


def _windows(spark: SparkSession, root: str) -> LatestRows:
    schema = (
        "desde timestamp_ntz, hasta timestamp_ntz, id_servicio long, veces_consumido long, unidades long, "
        "importe_total decimal(22,2)"
    )
    return LatestRows(spark, f"{root}/ventanas", ["desde", "id_servicio"], schema)


def run_consumption_windows(consumption: DataFrame, root: str, width: str = "30 days", delay: str = "1 day") -> None:
    """Consume the available rows; each batch stores the windows it changed, so the last ones of a finished source are there."""
    windows = consumption_by_service_window(consumption, width, delay)
    drain(each_batch(windows, _windows(consumption.sparkSession, root).write, "update"), f"{root}/control")


def consumption_windows(spark: SparkSession, root: str) -> DataFrame:
    """Totals per service and window after the newest batch, open windows included."""
    rows = _windows(spark, root).read()
    return rows.select("desde", "hasta", "id_servicio", "veces_consumido", "unidades", "importe_total")
