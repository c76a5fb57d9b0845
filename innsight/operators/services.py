"""Service demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import half_open, total_money
from innsight.operators._common import services
from innsight.params import Params
from innsight.tables import Hotel


def _per_service(consumption: DataFrame, times: str) -> DataFrame:
    """Uses, units and amount per service, condensed before the catalogue is joined."""
    amount = F.col("cantidad") * F.col("precio_unitario")
    return consumption.groupBy("id_servicio").agg(
        F.count("*").alias(times),
        F.sum("cantidad").alias("unidades"),
        total_money(amount).alias("importe_total"),
    )


def top_services(hotel: Hotel, p: Params) -> DataFrame:
    """Services consumed in the last month, most used first."""
    used = hotel.consumo_servicio.filter(half_open("fecha_hora", p.last_month))
    return (
        services(hotel)
        .join(_per_service(used, "veces_consumido"), "id_servicio")
        .orderBy(F.desc("veces_consumido"), F.desc("importe_total"), "id_servicio")
    )


def unused_services(hotel: Hotel, p: Params) -> DataFrame:
    """Services nobody consumed in the last month."""
    used = hotel.consumo_servicio.filter(half_open("fecha_hora", p.last_month)).select("id_servicio").distinct()
    return (
        services(hotel, "precio", "disponible")
        .join(used, "id_servicio", "left_anti")
        .orderBy("origen", "tipo_servicio", "nombre_servicio", "id_servicio")
    )


def vip_top_services(hotel: Hotel, limit: int = 20) -> DataFrame:
    """The services consumed most on bookings paid by VIPs.

    Bookings are few beside their consumption: those of VIPs are found first, and
    what is consumed on them is condensed per service inside each task. Condensing
    per booking and service before would hold about every row in a task's memory.
    """
    amount = F.col("cantidad") * F.col("precio_unitario")
    vip_bookings = hotel.reservacion.select("id_reservacion", "id_huesped_facturador").join(
        hotel.cliente_vip.select("id_huesped_facturador"), "id_huesped_facturador"
    )
    used = hotel.consumo_servicio.select("id_reservacion", "id_servicio", "cantidad", "precio_unitario")
    ranked = (
        used.join(vip_bookings.select("id_reservacion"), "id_reservacion")
        .groupBy("id_servicio")
        .agg(
            F.count("*").alias("consumos"),
            F.sum("cantidad").alias("unidades"),
            F.sum(amount).cast("decimal(22,2)").alias("importe_total"),
        )
    )
    return (
        services(hotel)
        .join(ranked, "id_servicio")
        .orderBy(F.desc("consumos"), F.desc("importe_total"), "id_servicio")
        .limit(limit)
    )
