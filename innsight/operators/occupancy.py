"""Room availability, occupancy and stays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions import field_rank, full_name, half_open, hours_between, month_of, percentage, ratio
from innsight.operators._common import (
    categories,
    guests,
    optional,
    payers,
    room_categories,
    room_labels,
    room_listing,
    stay_end,
    stay_nights,
    vip_levels,
)
from innsight.params import Params
from innsight.schemas import HABITACION_ASIGNABLE, ORDEN_VIP, RESERVA_BLOQUEA_AGENDA
from innsight.tables import Hotel


def available_rooms(
    hotel: Hotel, p: Params, desde: dt.date | None = None, hasta: dt.date | None = None
) -> DataFrame:
    """Assignable rooms without a blocking booking that overlaps ``[desde, hasta)``."""
    desde, hasta = desde or p.hoy, hasta or p.tomorrow
    blocking = hotel.reservacion.filter(
        F.col("estado").isin(*RESERVA_BLOQUEA_AGENDA)
        & (F.col("fecha_inicio") < F.lit(hasta))
        & (F.col("fecha_salida") > F.lit(desde))
    ).select("id_reservacion")
    busy = hotel.reservacion_habitacion.select("id_reservacion", "id_habitacion").join(
        blocking, "id_reservacion", "left_semi"
    )
    return (
        room_listing(hotel)
        .filter(F.col("estado_actual").isin(*HABITACION_ASIGNABLE))
        .join(busy.select("id_habitacion").distinct(), "id_habitacion", "left_anti")
        .orderBy("categoria", "numero_habitacion", "id_habitacion")
    )


def idle_rooms(hotel: Hotel, p: Params) -> DataFrame:
    """Rooms no stay checked into during the last month."""
    used = hotel.estancia.filter(half_open("fecha_hora_checkin", p.last_month)).select("id_habitacion").distinct()
    return (
        room_listing(hotel)
        .join(used, "id_habitacion", "left_anti")
        .orderBy("categoria", "numero_habitacion", "id_habitacion")
    )


def _open_stays(hotel: Hotel) -> DataFrame:
    return hotel.estancia.filter(F.col("fecha_hora_checkout_real").isNull())


def current_stays(hotel: Hotel) -> DataFrame:
    """Stays without a real check-out, whatever the state of their booking."""
    bookings = hotel.reservacion.select("id_reservacion", "id_huesped", F.col("fecha_salida").alias("fecha_fin_reserva"))
    return (
        _open_stays(hotel)
        .select("id_estancia", "id_reservacion", "id_habitacion", "fecha_hora_checkin")
        .join(bookings, "id_reservacion")
        .join(guests(hotel), "id_huesped")
        .join(room_labels(hotel), "id_habitacion")
        .orderBy(F.desc("fecha_hora_checkin"), "id_estancia")
        .select(
            "id_estancia",
            "huesped",
            F.col("fecha_hora_checkin").cast("date").alias("fecha_ingreso"),
            "fecha_fin_reserva",
            F.col("numero_habitacion").alias("habitacion"),
            F.col("categoria").alias("tipo_habitacion"),
        )
    )


def guests_in_house(hotel: Hotel) -> DataFrame:
    """Open stays whose booking is in state check_in, with the VIP level if any."""
    bookings = hotel.reservacion.filter(F.col("estado") == "check_in").select(
        "id_reservacion", "id_huesped", "id_huesped_facturador"
    )
    return (
        _open_stays(hotel)
        .select("id_reservacion", "id_habitacion", "fecha_hora_checkin", "fecha_hora_checkout_programado")
        .join(bookings, "id_reservacion")
        .join(guests(hotel), "id_huesped")
        .join(room_labels(hotel), "id_habitacion")
        .join(vip_levels(hotel), "id_huesped_facturador", "left")
        .orderBy("fecha_hora_checkin", "id_reservacion")
        .select(
            "id_reservacion",
            "huesped",
            "numero_habitacion",
            "categoria",
            "fecha_hora_checkin",
            "fecha_hora_checkout_programado",
            F.datediff(
                F.col("fecha_hora_checkout_programado").cast("date"), F.col("fecha_hora_checkin").cast("date")
            ).alias("noches"),
            "nivel_vip",
        )
    )


def vips_in_house(hotel: Hotel) -> DataFrame:
    """Open stays paid by a VIP, highest level first."""
    bookings = hotel.reservacion.select(
        "id_reservacion", "id_huesped_facturador", F.col("fecha_salida").alias("check_out_programado")
    )
    vips = hotel.cliente_vip.select(
        "id_vip", "id_huesped_facturador", "nivel_vip", "contador_reservas", "puntos_acumulados"
    ).join(payers(hotel, "cliente"), "id_huesped_facturador")
    return (
        _open_stays(hotel)
        .select("id_estancia", "id_reservacion", "id_habitacion", F.col("fecha_hora_checkin").cast("date").alias("check_in"))
        .join(bookings, "id_reservacion")
        .join(vips, "id_huesped_facturador")
        .join(room_labels(hotel), "id_habitacion")
        .orderBy(field_rank("nivel_vip", ORDEN_VIP), F.desc("contador_reservas"), "id_estancia")
        .select(
            "id_vip",
            "nivel_vip",
            "contador_reservas",
            "puntos_acumulados",
            "cliente",
            "numero_habitacion",
            F.col("categoria").alias("tipo_habitacion"),
            "check_in",
            "check_out_programado",
        )
    )


def occupancy_by_category(hotel: Hotel, p: Params, fecha: dt.date | None = None) -> DataFrame:
    """Rooms and occupied rooms per category on one date."""
    fecha = fecha or p.hoy
    next_day = F.lit(fecha + dt.timedelta(days=1))
    occupied = (
        hotel.estancia.filter(
            (F.col("fecha_hora_checkin") < next_day)
            & (F.col("fecha_hora_checkout_real").isNull() | (F.col("fecha_hora_checkout_real") >= next_day))
        )
        .select("id_habitacion")
        .distinct()
        .withColumn("ocupada", F.lit(True))
    )
    rooms = hotel.habitacion.select("id_habitacion", "id_categoria").join(occupied, "id_habitacion", "left")
    per_category = rooms.groupBy("id_categoria").agg(
        F.count("*").alias("total_habitaciones"), F.count("ocupada").alias("ocupadas")
    )
    return (
        per_category.join(categories(hotel), "id_categoria")
        .select(
            "categoria",
            "total_habitaciones",
            "ocupadas",
            percentage(F.col("ocupadas"), F.col("total_habitaciones")).alias("porcentaje_ocupacion"),
        )
        .orderBy(F.desc("porcentaje_ocupacion"), "categoria")
    )


def avg_stay_by_category(hotel: Hotel) -> DataFrame:
    """Stay length per category: mean of whole hours / 24, shortest and longest in nights.

    Stays are first condensed per room, so a room with very many stays reaches
    the join as one row.
    """
    hours = hours_between("fecha_hora_checkin", stay_end())
    per_room = hotel.estancia.groupBy("id_habitacion").agg(
        F.count("*").alias("n"),
        F.count(hours).alias("n_horas"),
        F.sum(hours).alias("horas"),
        F.min(stay_nights()).alias("menor"),
        F.max(stay_nights()).alias("mayor"),
    )
    return (
        per_room.join(room_categories(hotel), "id_habitacion")
        .groupBy("id_categoria", "categoria")
        .agg(
            F.sum("n").alias("estancias"),
            ratio(F.sum("horas"), F.sum("n_horas") * 24).alias("noches_promedio"),
            F.min("menor").alias("noches_min"),
            F.max("mayor").alias("noches_max"),
        )
        .drop("id_categoria")
        .orderBy(F.desc("noches_promedio"), "categoria")
    )


def monthly_occupancy(hotel: Hotel, p: Params) -> DataFrame:
    """Nights per check-in month and category over the category's capacity that month.

    All nights of a stay count in its check-in month; ``monthly_occupancy_exact``
    spreads them.
    """
    per_room = (
        hotel.estancia.filter(half_open("fecha_hora_checkin", p.last_year))
        .groupBy(month_of("fecha_hora_checkin").alias("mes"), "id_habitacion")
        .agg(
            F.sum(stay_nights()).alias("noches"),
            F.min(F.col("fecha_hora_checkin").cast("date")).alias("primer_dia"),
        )
    )
    return _occupancy_share(hotel, per_room)


def monthly_occupancy_exact(hotel: Hotel, p: Params) -> DataFrame:
    """As ``monthly_occupancy``, each night charged to the month it falls in."""
    start = F.col("fecha_hora_checkin").cast("date")
    end = stay_end().cast("date")
    month = F.trunc(F.col("inicio_mes"), "month")
    per_room = (
        hotel.estancia.filter(half_open("fecha_hora_checkin", p.last_year) & (end > start))
        .select(
            "id_habitacion",
            start.alias("ini"),
            end.alias("fin"),
            F.explode(
                F.sequence(F.trunc(start, "month"), F.trunc(F.date_sub(end, 1), "month"), F.expr("interval 1 month"))
            ).alias("inicio_mes"),
        )
        .withColumn(
            "noches",
            F.datediff(
                F.least(F.col("fin"), F.add_months(month, 1)), F.greatest(F.col("ini"), F.col("inicio_mes"))
            ),
        )
        .groupBy(month_of("inicio_mes").alias("mes"), "id_habitacion")
        .agg(F.sum("noches").alias("noches"), F.min("inicio_mes").alias("primer_dia"))
    )
    return _occupancy_share(hotel, per_room)


def _occupancy_share(hotel: Hotel, per_room: DataFrame) -> DataFrame:
    rooms = hotel.habitacion.select("id_habitacion", "id_categoria")
    capacity = rooms.groupBy("id_categoria").agg(F.count("*").alias("habitaciones"))
    days = F.day(F.last_day("primer_dia"))
    return (
        per_room.join(rooms, "id_habitacion")
        .groupBy("mes", "id_categoria")
        .agg(F.sum("noches").alias("noches_ocupadas"), F.min("primer_dia").alias("primer_dia"))
        .join(capacity.join(categories(hotel), "id_categoria"), "id_categoria")
        .withColumn("noches_disponibles", F.col("habitaciones") * days)
        .select(
            "mes",
            "categoria",
            "noches_ocupadas",
            "noches_disponibles",
            percentage(F.col("noches_ocupadas"), F.col("noches_disponibles")).alias("porcentaje"),
        )
        .orderBy("mes", F.desc("porcentaje"), "categoria")
    )


def longest_stay_per_category(hotel: Hotel, p: Params) -> DataFrame:
    """The longest stay of each category in the last year, lowest id on ties."""
    stays = (
        hotel.estancia.filter(half_open("fecha_hora_checkin", p.last_year))
        .select(
            "id_estancia",
            "id_habitacion",
            F.col("fecha_hora_checkin").cast("date").alias("check_in"),
            stay_end().cast("date").alias("check_out"),
            stay_nights().alias("noches"),
        )
        .join(hotel.habitacion.select("id_habitacion", "numero_habitacion", "id_categoria"), "id_habitacion")
    )
    order = Window.partitionBy("id_categoria").orderBy(F.desc("noches"), "id_estancia")
    return (
        stays.withColumn("puesto", F.row_number().over(order))
        .filter(F.col("puesto") == 1)
        .join(categories(hotel), "id_categoria")
        .select("categoria", "numero_habitacion", "check_in", "check_out", "noches")
        .orderBy(F.desc("noches"), "categoria")
    )


def room_audit(hotel: Hotel, id_habitacion: int | None = None) -> DataFrame:
    """State changes with room, booking and employee; of one room, latest first, or of all in no order.

    Changes made by triggers name neither booking nor employee; they are dealt
    over all tasks on their way through the joins.
    """
    log = hotel.bitacora_habitacion
    if id_habitacion is not None:
        log = log.filter(F.col("id_habitacion") == id_habitacion)
    rooms = hotel.habitacion.select("id_habitacion", "numero_habitacion")
    bookings = (
        hotel.reservacion.select("id_reservacion", "id_huesped", F.col("total").alias("costo_reserva"))
        .join(guests(hotel), "id_huesped", "left")
        .drop("id_huesped")
    )
    staff = hotel.empleado.select("id_empleado", full_name().alias("empleado"), F.col("rol").alias("rol_empleado"))
    named = optional(optional(log, bookings, "id_reservacion", "id_bitacora"), staff, "id_empleado", "id_bitacora")
    listed = named.join(rooms, "id_habitacion").select(
        "id_bitacora",
        F.col("fecha_hora").alias("cambio"),
        "estado_anterior",
        "estado_nuevo",
        "numero_habitacion",
        "id_reservacion",
        "huesped",
        "costo_reserva",
        "empleado",
        "rol_empleado",
    )
    return listed if id_habitacion is None else listed.orderBy(F.desc("cambio"), "id_bitacora")
