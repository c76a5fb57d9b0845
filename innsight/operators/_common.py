"""Joins that several reports share.

No join here carries a broadcast hint: room, service and staff tables are small
in one hotel and large in a chain, so the planner picks by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions import full_name
from innsight.tables import Hotel


def categories(hotel: Hotel) -> DataFrame:
    return hotel.categoria_habitacion.select("id_categoria", F.col("nombre").alias("categoria"))


def room_categories(hotel: Hotel) -> DataFrame:
    """(id_habitacion, id_categoria, categoria)."""
    return hotel.habitacion.select("id_habitacion", "id_categoria").join(categories(hotel), "id_categoria")


def room_labels(hotel: Hotel) -> DataFrame:
    """(id_habitacion, numero_habitacion, categoria)."""
    rooms = hotel.habitacion.select("id_habitacion", "numero_habitacion", "id_categoria")
    return rooms.join(categories(hotel), "id_categoria").drop("id_categoria")


def room_listing(hotel: Hotel) -> DataFrame:
    return hotel.habitacion.join(categories(hotel), "id_categoria").select(
        "id_habitacion",
        "numero_habitacion",
        "piso",
        "categoria",
        F.col("precio").alias("tarifa_noche"),
        F.col("estado").alias("estado_actual"),
    )


def guests(hotel: Hotel, alias: str = "huesped") -> DataFrame:
    """(id_huesped, full name)."""
    return hotel.huesped.select("id_huesped", full_name().alias(alias))


def payers(hotel: Hotel, alias: str, *columns: str) -> DataFrame:
    """(id_huesped_facturador, name of the payer's own guest row, columns...)."""
    payer = hotel.huesped_facturador.select("id_huesped_facturador", "id_huesped", *columns)
    return payer.join(guests(hotel, alias), "id_huesped").drop("id_huesped")


def vip_levels(hotel: Hotel) -> DataFrame:
    return hotel.cliente_vip.select("id_huesped_facturador", "nivel_vip")


def services(hotel: Hotel, *columns: str) -> DataFrame:
    """Service catalogue with its type name and origin."""
    kinds = hotel.tipo_servicio.select(
        "id_tipo_servicio", F.col("nombre").alias("tipo_servicio"), F.col("categoria").alias("origen")
    )
    return (
        hotel.servicio.select("id_servicio", "id_tipo_servicio", "nombre_servicio", *columns)
        .join(kinds, "id_tipo_servicio")
        .select("id_servicio", "nombre_servicio", "tipo_servicio", "origen", *columns)
    )


def collected(hotel: Hotel, alias: str) -> DataFrame:
    """Completed payments per invoice, summed before any join."""
    return (
        hotel.pago.filter(F.col("estado") == "completado")
        .groupBy("id_factura")
        .agg(F.sum("monto").cast("decimal(22,2)").alias(alias))
    )


def optional(rows: DataFrame, other: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join on a key that many rows lack; ``other`` holds each key once.

    Rows without the key match nothing and are dealt by ``row_id``, so they don't
    gather in one task.
    """
    # one struct, so that the optimizer can't take the constant part out of the join key
    own = F.lit(-1).cast("long")
    dealt = F.when(F.col(key).isNull(), F.abs(F.hash(row_id).cast("long"))).otherwise(own)
    left = rows.withColumn("_llave", F.struct(F.col(key).alias("k"), dealt.alias("d")))
    right = other.withColumn("_llave", F.struct(F.col(key).alias("k"), own.alias("d"))).drop(key)
    return left.join(right, "_llave", "left").drop("_llave")


def stay_nights() -> Column:
    """Calendar nights from check-in to the real, else the scheduled, check-out."""
    return F.datediff(stay_end().cast("date"), F.col("fecha_hora_checkin").cast("date"))


def stay_end() -> Column:
    return F.coalesce("fecha_hora_checkout_real", "fecha_hora_checkout_programado")
