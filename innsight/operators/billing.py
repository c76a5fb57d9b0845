"""Payments, invoices and income."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions import field_rank, half_open, month_of, ratio, total_money
from innsight.operators._common import collected, payers
from innsight.params import Params, Window, add_months
from innsight.schemas import ORDEN_PAGO
from innsight.tables import Hotel


def payments_by_status(hotel: Hotel, p: Params) -> DataFrame:
    """Number and amount of last month's payments per state."""
    return (
        hotel.pago.filter(half_open("fecha_pago", p.last_month))
        .groupBy(F.col("estado").alias("estado_pago"))
        .agg(F.count("*").alias("num_pagos"), total_money("monto").alias("monto"))
        .orderBy(field_rank("estado_pago", ORDEN_PAGO))
    )


def _no_money() -> Column:
    return F.lit(0).cast("decimal(22,2)")


def invoices_collected(hotel: Hotel, p: Params) -> DataFrame:
    """Last month's invoices with what has really been paid on them."""
    return (
        hotel.factura.filter(half_open("fecha_emision", p.last_month))
        .join(collected(hotel, "cobrado"), "id_factura", "left")
        .join(payers(hotel, "facturado_a", "rfc"), "id_huesped_facturador")
        .select(
            "id_factura",
            "fecha_emision",
            "facturado_a",
            "rfc",
            "subtotal",
            "impuestos",
            F.col("total").alias("total_facturado"),
            F.coalesce("cobrado", _no_money()).alias("total_cobrado"),
            "estado_factura",
        )
        .orderBy(F.desc("fecha_emision"), F.desc("id_factura"))
    )


def unpaid_invoices(hotel: Hotel, p: Params) -> DataFrame:
    """Last month's pending and overdue invoices."""
    return (
        hotel.factura.filter(
            half_open("fecha_emision", p.last_month) & F.col("estado_factura").isin("pendiente", "vencida")
        )
        .join(collected(hotel, "cobrado"), "id_factura", "left")
        .join(payers(hotel, "facturado_a", "rfc", "email"), "id_huesped_facturador")
        .select(
            "id_factura",
            "fecha_emision",
            "facturado_a",
            "rfc",
            "email",
            "total",
            F.coalesce("cobrado", _no_money()).alias("pagado"),
            "estado_factura",
            F.datediff(F.lit(p.hoy), "fecha_emision").alias("dias_desde_emision"),
        )
        .orderBy(F.desc("estado_factura"), "fecha_emision", "id_factura")
    )


def daily_billing_stats(hotel: Hotel, p: Params) -> DataFrame:
    """One row about the daily totals of last month; NULLs and 0 when nothing was issued."""
    daily = (
        hotel.factura.filter(half_open("fecha_emision", p.last_month))
        .groupBy("fecha_emision")
        .agg(total_money("total").alias("total_dia"))
    )
    amount = F.col("total_dia").cast("double")
    return daily.agg(
        F.min("fecha_emision").alias("desde"),
        F.max("fecha_emision").alias("hasta"),
        F.count("*").alias("dias_con_factura"),
        ratio(F.sum("total_dia"), F.count("*")).alias("promedio_diario"),
        total_money("total_dia").alias("total_periodo"),
        F.round(F.stddev_samp(amount), 2).alias("desviacion_diaria"),
    )


def monthly_income(hotel: Hotel, year: int | None = None, month: int | None = None) -> DataFrame:
    """Income per month, split by invoice state; of one month or of all of them.

    A single month becomes a date range on the bare column, so the scan prunes.
    A month without invoices has no row.
    """
    invoices = hotel.factura
    if year is not None and month is not None:
        first = dt.date(year, month, 1)
        invoices = invoices.filter(half_open("fecha_emision", Window(first, add_months(first, 1))))

    def in_state(state: str, alias: str):
        amount = F.sum(F.when(F.col("estado_factura") == state, F.col("total"))).cast("decimal(22,2)")
        return F.coalesce(amount, _no_money()).alias(alias)

    return (
        invoices.groupBy(month_of("fecha_emision").alias("mes"))
        .agg(
            F.count("*").alias("facturas_emitidas"),
            F.coalesce(total_money("subtotal"), _no_money()).alias("subtotal_total"),
            F.coalesce(total_money("impuestos"), _no_money()).alias("impuestos_total"),
            F.coalesce(total_money("total"), _no_money()).alias("ingreso_total"),
            in_state("pagada", "ingreso_cobrado"),
            in_state("pendiente", "por_cobrar"),
            in_state("vencida", "vencido"),
            in_state("cancelada", "facturado_cancelado"),
        )
        .orderBy("mes")
    )


def booking_finance(hotel: Hotel) -> DataFrame:
    """Booking money next to the payer's tax id and address."""
    payer = hotel.huesped_facturador.select("id_huesped_facturador", "rfc", F.col("email").alias("email_facturador"))
    return hotel.reservacion.join(payer, "id_huesped_facturador").select(
        "id_reservacion",
        "fecha_inicio",
        "fecha_salida",
        "estado",
        "metodo",
        "subtotal",
        "total",
        "id_huesped_facturador",
        "rfc",
        "email_facturador",
    )
