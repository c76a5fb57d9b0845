"""Service consumption requests and price checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import beyond_money, money, ntz
from innsight.plans._common import dedupe_requests, first_reason, known, new_id, split
from innsight.schemas import FACTOR_CON_IVA, RESERVA_CONSUME, TASA_IVA
from innsight.session import checkpoint
from innsight.tables import Delta, Hotel


def register_services(hotel: Hotel, requests: DataFrame, now: dt.datetime) -> Delta:
    """Requests (request_id, id_reservacion, id_servicio, id_empleado, cantidad).

    Consumption is charged at the catalogue price. A booking with an account,
    open or closed, also gets an account line; account totals are left to
    ``rebuild_account_totals``. A request whose charge, or whose quantity, is too
    wide to be stored is refused alone.
    """
    requests, repeats = dedupe_requests(requests)
    gross = F.col("cantidad") * F.col("precio")
    with_tax = F.lit(FACTOR_CON_IVA).cast("decimal(3,2)")
    catalogue = hotel.servicio.select("id_servicio", "nombre_servicio", "precio", "disponible")
    bookings = hotel.reservacion.select("id_reservacion", "id_huesped", F.col("estado").alias("_estado"))
    judged = (
        requests.select("request_id", "id_reservacion", "id_servicio", "id_empleado", "cantidad")
        .join(catalogue, "id_servicio", "left")
        .join(bookings, "id_reservacion", "left")
        .join(known(hotel.empleado, "id_empleado", "_empleado"), "id_empleado", "left")
        .withColumn(
            "motivo_rechazo",
            first_reason(
                ("invalid_quantity", F.col("cantidad") <= 0),
                ("unknown_service", F.col("precio").isNull()),
                ("service_unavailable", ~F.col("disponible")),
                ("unknown_booking", F.col("id_huesped").isNull()),
                ("booking_not_active", ~F.col("_estado").isin(*RESERVA_CONSUME)),
                ("unknown_employee", F.col("_empleado").isNull()),
                ("amount_too_large", beyond_money(gross * with_tax) | (F.col("cantidad") >= 10**8)),
            ),
        )
    )
    accepted, rejected = split(checkpoint(judged))
    used = accepted.select(
        new_id("consumo", "request_id").alias("id_consumo"),
        "id_reservacion",
        "id_huesped",
        "id_servicio",
        "id_empleado",
        "cantidad",
        F.col("precio").alias("precio_unitario"),
        ntz(now).alias("fecha_hora"),
    )
    lines = accepted.join(hotel.cuenta.select("id_reservacion", "id_cuenta"), "id_reservacion").select(
        new_id("detalle", "request_id").alias("id_detalle_cuenta"),
        "id_cuenta",
        F.lit("servicio").alias("tipo"),
        F.concat(F.lit("Servicio: "), F.col("nombre_servicio")).alias("descripcion"),
        F.col("cantidad").cast("decimal(10,2)").alias("cantidad"),
        F.col("precio").alias("precio_unitario"),
        F.lit(0).cast("decimal(12,2)").alias("descuento"),
        money(gross * F.lit(TASA_IVA).cast("decimal(3,2)")).alias("impuesto"),
        money(gross * with_tax).alias("importe"),
    )
    return Delta({"consumo_servicio": used, "detalle_cuenta": lines}, rejected=rejected.unionByName(repeats))


def validate_service_prices(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services with a positive price, and the refused others with their reason."""
    return _divide(rows, ("invalid_price", F.col("precio") <= 0))


def validate_consumption(rows: DataFrame, updating: bool = False) -> tuple[DataFrame, DataFrame]:
    """Consumption with positive price and quantity; an update only checks the price."""
    rules = [("invalid_price", F.col("precio_unitario") <= 0)]
    if not updating:
        rules.append(("invalid_quantity", F.col("cantidad") <= 0))
    return _divide(rows, *rules)


def _divide(rows: DataFrame, *rules) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("motivo_rechazo", first_reason(*rules))
    good = judged.filter(F.col("motivo_rechazo").isNull()).drop("motivo_rechazo")
    return good, judged.filter(F.col("motivo_rechazo").isNotNull())
