"""Clients, loyalty and guest records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import full_name
from innsight.operators._common import payers, vip_levels
from innsight.schemas import RESERVA_CON_INGRESO
from innsight.tables import Hotel


def frequent_clients(hotel: Hotel, minimum: int = 5) -> DataFrame:
    """Payers with more than ``minimum`` bookings that were not cancelled.

    Bookings are counted per payer first: one row per payer reaches the joins.
    """
    counted = (
        hotel.reservacion.filter(F.col("estado") != "cancelada")
        .groupBy("id_huesped_facturador")
        .agg(F.count("*").alias("reservas_reales"))
        .filter(F.col("reservas_reales") > minimum)
    )
    return (
        counted.join(payers(hotel, "cliente", "email", "numero_reservas"), "id_huesped_facturador")
        .join(vip_levels(hotel), "id_huesped_facturador", "left")
        .select(
            "id_huesped_facturador",
            "cliente",
            "email",
            F.col("numero_reservas").alias("cache_trigger"),
            "reservas_reales",
            F.coalesce("nivel_vip", F.lit("sin_vip")).alias("nivel_vip"),
        )
        .orderBy(F.desc("reservas_reales"), "id_huesped_facturador")
    )


def top_clients(hotel: Hotel, limit: int = 10) -> DataFrame:
    """The payers with the highest booking income."""
    income = (
        hotel.reservacion.filter(F.col("estado").isin(*RESERVA_CON_INGRESO))
        .groupBy("id_huesped_facturador")
        .agg(F.count("*").alias("reservas"), F.sum("total").cast("decimal(22,2)").alias("ingreso_total"))
    )
    return (
        income.join(payers(hotel, "cliente", "email", "procedencia"), "id_huesped_facturador")
        .join(vip_levels(hotel), "id_huesped_facturador", "left")
        .select(
            "id_huesped_facturador",
            "cliente",
            "email",
            "procedencia",
            "reservas",
            "ingreso_total",
            F.coalesce("nivel_vip", F.lit("sin_vip")).alias("nivel_vip"),
        )
        .orderBy(F.desc("ingreso_total"), F.desc("reservas"), "id_huesped_facturador")
        .limit(limit)
    )


def guests_without_email(hotel: Hotel) -> DataFrame:
    """Guests without an address and whether they pay or accompany."""
    paying = hotel.huesped_facturador.select("id_huesped", F.lit(True).alias("paga"))
    return (
        hotel.huesped.filter(F.col("email").isNull() | (F.col("email") == ""))
        .join(paying, "id_huesped", "left")
        .withColumn("rol", F.when(F.col("paga"), "facturador").otherwise("acompanante"))
        .orderBy("rol", "apellidos", "nombres", "id_huesped")
        .select("id_huesped", full_name().alias("huesped"), "fecha_nacimiento", "pais_origen", "rol")
    )


def user_public(hotel: Hotel) -> DataFrame:
    """Users without their password hash."""
    return hotel.usuario.select("id_usuario", "email", "rol")
