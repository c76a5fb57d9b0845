"""Bookings, arrivals, cancellations and sales."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import half_open, percentage, ratio, text_key, total_money
from innsight.operators._common import guests, payers, room_categories
from innsight.params import Params
from innsight.schemas import RESERVA_POR_LLEGAR
from innsight.tables import Hotel


def _expected(hotel: Hotel) -> DataFrame:
    return hotel.reservacion.filter(F.col("estado").isin(*RESERVA_POR_LLEGAR))


def due_without_checkin(hotel: Hotel, p: Params, fecha: dt.date | None = None) -> DataFrame:
    """Expected bookings that cover the date and have no stay yet."""
    day = F.lit(fecha or p.hoy)
    payer = hotel.huesped_facturador.select("id_huesped_facturador", F.col("email").alias("email_facturador"))
    return (
        _expected(hotel)
        .filter((F.col("fecha_inicio") <= day) & (F.col("fecha_salida") > day))
        .join(hotel.estancia.select("id_reservacion"), "id_reservacion", "left_anti")
        .join(guests(hotel), "id_huesped")
        .join(payer, "id_huesped_facturador")
        .select(
            "id_reservacion", "huesped", "email_facturador", "fecha_inicio", "fecha_salida", "estado", "metodo", "total"
        )
        .orderBy("fecha_inicio", "id_reservacion")
    )


def arrivals_next_7_days(hotel: Hotel, p: Params) -> DataFrame:
    """Expected bookings arriving after today and within seven days."""
    limit = F.lit(p.hoy + dt.timedelta(days=7))
    phone = hotel.huesped_facturador.select("id_huesped_facturador", "telefono_celular")
    return (
        _expected(hotel)
        .filter((F.col("fecha_inicio") > F.lit(p.hoy)) & (F.col("fecha_inicio") <= limit))
        .join(guests(hotel), "id_huesped")
        .join(phone, "id_huesped_facturador")
        .select(
            "id_reservacion",
            "huesped",
            "telefono_celular",
            "fecha_inicio",
            "fecha_salida",
            F.datediff("fecha_salida", "fecha_inicio").alias("noches"),
            "estado",
            "total",
        )
        .orderBy("fecha_inicio", "id_reservacion")
    )


def stale_bookings(hotel: Hotel, p: Params) -> DataFrame:
    """Expected bookings whose departure date has passed."""
    payer = hotel.huesped_facturador.select("id_huesped_facturador", "email")
    return (
        _expected(hotel)
        .filter(F.col("fecha_salida") < F.lit(p.hoy))
        .join(guests(hotel), "id_huesped")
        .join(payer, "id_huesped_facturador")
        .select(
            "id_reservacion",
            "estado",
            "metodo",
            "huesped",
            "email",
            "fecha_inicio",
            "fecha_salida",
            F.datediff(F.lit(p.hoy), "fecha_salida").alias("dias_vencido"),
            "total",
        )
        .orderBy(F.desc("dias_vencido"), "id_reservacion")
    )


def cancellations(hotel: Hotel, p: Params) -> DataFrame:
    """Cancellations of the last month with the booking they ended."""
    bookings = hotel.reservacion.select(
        "id_reservacion",
        "id_huesped",
        F.col("fecha_inicio").alias("check_in_original"),
        F.col("total").alias("total_reserva"),
    )
    return (
        hotel.cancelacion.filter(half_open("fecha_cancelacion", p.last_month))
        .join(bookings, "id_reservacion")
        .join(guests(hotel), "id_huesped")
        .select(
            "id_cancelacion",
            "id_reservacion",
            "huesped",
            "fecha_cancelacion",
            "check_in_original",
            "motivo",
            "penalizacion",
            "total_reserva",
        )
        .orderBy(F.desc("fecha_cancelacion"), "id_cancelacion")
    )


def repeat_cancellers(hotel: Hotel, minimum: int = 2, ci_ai: bool = False) -> DataFrame:
    """Every cancelled room of payers with more than ``minimum`` cancellations.

    ``ci_ai`` sorts clients ignoring case and accents.

    Cancellations are counted before the booked rooms fan them out; the count
    and the payer's data meet as one row per payer.
    """
    bookings = hotel.reservacion.select(
        "id_reservacion", "id_huesped_facturador", F.col("fecha_inicio").alias("fecha_reservada")
    )
    cancelled = hotel.cancelacion.select("id_reservacion", "fecha_cancelacion", "motivo").join(
        bookings, "id_reservacion"
    )
    repeaters = (
        cancelled.groupBy("id_huesped_facturador")
        .agg(F.count("*").alias("total_cancelaciones"))
        .filter(F.col("total_cancelaciones") > minimum)
        .join(payers(hotel, "cliente", "email"), "id_huesped_facturador")
    )
    rooms = hotel.reservacion_habitacion.select("id_reservacion", "id_habitacion")
    return (
        cancelled.join(repeaters, "id_huesped_facturador")
        .join(rooms, "id_reservacion")
        .join(room_categories(hotel), "id_habitacion")
        .select(
            "cliente",
            "email",
            "total_cancelaciones",
            "id_reservacion",
            "fecha_reservada",
            F.col("categoria").alias("tipo_habitacion"),
            "fecha_cancelacion",
            "motivo",
        )
        .orderBy(F.desc("total_cancelaciones"), text_key("cliente", ci_ai), F.desc("fecha_cancelacion"), "id_reservacion")
    )


def bookings_by_country(hotel: Hotel, ci_ai: bool = False) -> DataFrame:
    """Bookings per guest country and their share of all bookings.

    ``ci_ai`` groups countries ignoring case and accents.
    """
    country = text_key("pais_origen", ci_ai)
    total = hotel.reservacion.agg(F.count("*").alias("total")).scalar()
    per_guest = hotel.reservacion.groupBy("id_huesped").agg(F.count("*").alias("n"))
    return (
        per_guest.join(hotel.huesped.select("id_huesped", country.alias("pais")), "id_huesped")
        .groupBy("pais")
        .agg(F.sum("n").alias("reservas"))
        .select(
            F.coalesce(F.col("pais").cast("string"), F.lit("(sin pais)")).alias("pais_origen"),
            "reservas",
            percentage(F.col("reservas"), total).alias("porcentaje_global"),
        )
        .orderBy(F.desc("reservas"), "pais_origen")
    )


def _sold(hotel: Hotel, p: Params) -> DataFrame:
    """Booked rooms of the last year's bookings that were not cancelled, per category."""
    bookings = hotel.reservacion.filter(
        half_open("fecha_inicio", p.last_year) & (F.col("estado") != "cancelada")
    ).select("id_reservacion")
    rooms = hotel.reservacion_habitacion.select(
        "id_reservacion",
        "id_habitacion",
        (F.col("noches") * F.col("cantidad_habitaciones")).alias("noches_cuarto"),
        "subtotal",
    )
    return (
        rooms.join(bookings, "id_reservacion", "left_semi")
        .join(room_categories(hotel), "id_habitacion")
        .groupBy("id_categoria", "categoria")
        .agg(
            F.countDistinct("id_reservacion").alias("reservas"),
            F.sum("noches_cuarto").alias("noches_vendidas"),
            total_money("subtotal").alias("ingreso"),
        )
    )


def bookings_by_category(hotel: Hotel, p: Params) -> DataFrame:
    return (
        _sold(hotel, p)
        .select("categoria", "reservas", "noches_vendidas", F.col("ingreso").alias("ingreso_proyectado"))
        .orderBy(F.desc("reservas"), "categoria")
    )


def revenue_by_category(hotel: Hotel, p: Params) -> DataFrame:
    """Room revenue and average daily rate per category."""
    return (
        _sold(hotel, p)
        .select(
            "categoria",
            "reservas",
            "noches_vendidas",
            F.col("ingreso").alias("ingreso_habitacion"),
            ratio(F.col("ingreso"), F.col("noches_vendidas")).alias("adr"),
        )
        .orderBy(F.desc("ingreso_habitacion"), "categoria")
    )
