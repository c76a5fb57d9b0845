"""Cached totals and counters: rebuild them, or list the rows that drifted.

Every ``rebuild_*`` returns the whole table with fresh values. ``audit`` compares
the stored table with its rebuilt form and keeps only the keys that differ.
Sums and counts are taken per key before they meet the table. Sums keep their
own width, so one outsized booking cannot fail a run; storing a table checks the
declared width of its columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.expressions import SUM_MONEY, money
from innsight.schemas import FACTOR_CON_IVA, TABLES, TASA_IVA
from innsight.tables import Hotel, conform


def _rate(text: str):
    return F.lit(text).cast("decimal(3,2)")


def _zero():
    return F.lit(0).cast(SUM_MONEY)


def _with(base: DataFrame, **fresh) -> DataFrame:
    """``base`` with some columns recomputed, column order kept."""
    return base.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in base.columns])


def rebuild_booking_totals(hotel: Hotel) -> DataFrame:
    """Subtotal = booked rooms + consumed services; total = subtotal with tax."""
    rooms = hotel.reservacion_habitacion.groupBy("id_reservacion").agg(F.sum("subtotal").alias("_cuartos"))
    used = hotel.consumo_servicio.groupBy("id_reservacion").agg(
        F.sum(F.col("cantidad") * F.col("precio_unitario")).alias("_consumos")
    )
    base = hotel.reservacion
    joined = base.join(rooms, "id_reservacion", "left").join(used, "id_reservacion", "left")
    amount = (F.coalesce("_cuartos", _zero()) + F.coalesce("_consumos", _zero())).cast(SUM_MONEY)
    return joined.select(
        *[c for c in base.columns if c not in ("subtotal", "total")],
        amount.alias("subtotal"),
        F.round(amount * _rate(FACTOR_CON_IVA), 2).cast(SUM_MONEY).alias("total"),
    ).select(*base.columns)


def rebuild_account_totals(hotel: Hotel) -> DataFrame:
    """Account totals from their lines; an account without lines keeps its values."""
    net = F.col("cantidad") * F.col("precio_unitario") - F.col("descuento")
    lines = hotel.detalle_cuenta.groupBy("id_cuenta").agg(
        F.sum(net).alias("_neto"), F.sum(net + F.col("impuesto")).alias("_bruto")
    )
    base = hotel.cuenta
    joined = base.join(lines, "id_cuenta", "left")
    return joined.select(
        *[c for c in base.columns if c not in ("subtotal", "total")],
        F.coalesce(F.round("_neto", 2), F.col("subtotal")).cast(SUM_MONEY).alias("subtotal"),
        F.coalesce(F.round("_bruto", 2), F.col("total")).cast(SUM_MONEY).alias("total"),
    ).select(*base.columns)


def rebuild_invoice_totals(hotel: Hotel) -> DataFrame:
    """Invoice money copied from its account, tax on the account subtotal."""
    accounts = hotel.cuenta.select("id_cuenta", F.col("subtotal").alias("_sub"), F.col("total").alias("_tot"))
    base = hotel.factura
    joined = base.join(accounts, "id_cuenta", "left")
    return joined.select(
        *[c for c in base.columns if c not in ("subtotal", "impuestos", "total")],
        F.coalesce("_sub", "subtotal").alias("subtotal"),
        F.coalesce(money(F.col("_sub") * _rate(TASA_IVA)), F.col("impuestos")).alias("impuestos"),
        F.coalesce("_tot", "total").alias("total"),
    ).select(*base.columns)


def rebuild_payment_amounts(hotel: Hotel) -> DataFrame:
    """Completed and refunded payments cover the invoice, all others half of it."""
    invoices = hotel.factura.select("id_factura", F.col("total").alias("_tot"))
    base = hotel.pago
    whole = F.col("estado").isin("completado", "reembolsado")
    amount = F.when(whole, F.col("_tot")).otherwise(money(F.col("_tot") * _rate("0.50")))
    joined = base.join(invoices, "id_factura", "left")
    return joined.select(
        *[c for c in base.columns if c != "monto"], F.coalesce(amount, F.col("monto")).alias("monto")
    ).select(*base.columns)


def _bookings_per_payer(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("id_huesped_facturador").agg(F.count("*").alias("_n"))


def rebuild_payer_counts(hotel: Hotel) -> DataFrame:
    """``numero_reservas`` = all bookings of the payer."""
    joined = hotel.huesped_facturador.join(
        _bookings_per_payer(hotel.reservacion), "id_huesped_facturador", "left"
    )
    return _with(joined, numero_reservas=F.coalesce("_n", F.lit(0).cast("long"))).select(*hotel.huesped_facturador.columns)


def rebuild_vip_counts(hotel: Hotel) -> DataFrame:
    """``contador_reservas`` = bookings of the payer that were not cancelled; expired ones count."""
    live = hotel.reservacion.filter(F.col("estado") != "cancelada")
    joined = hotel.cliente_vip.join(_bookings_per_payer(live), "id_huesped_facturador", "left")
    return _with(joined, contador_reservas=F.coalesce("_n", F.lit(0).cast("long"))).select(*hotel.cliente_vip.columns)


def rebuild_room_state(hotel: Hotel) -> DataFrame:
    """Rooms with an open stay become ocupada, all others keep their state."""
    busy = (
        hotel.estancia.filter(F.col("fecha_hora_checkout_real").isNull())
        .select("id_habitacion")
        .distinct()
        .withColumn("_abierta", F.lit(True))
    )
    joined = hotel.habitacion.join(busy, "id_habitacion", "left")
    state = F.when(F.col("_abierta"), "ocupada").otherwise(F.col("estado"))
    return _with(joined, estado=state).select(*hotel.habitacion.columns)


REBUILDS: dict[str, tuple[str, tuple[str, ...], Callable[[Hotel], DataFrame]]] = {
    "booking_totals": ("reservacion", ("subtotal", "total"), rebuild_booking_totals),
    "account_totals": ("cuenta", ("subtotal", "total"), rebuild_account_totals),
    "invoice_totals": ("factura", ("subtotal", "impuestos", "total"), rebuild_invoice_totals),
    "payment_amounts": ("pago", ("monto",), rebuild_payment_amounts),
    "payer_counts": ("huesped_facturador", ("numero_reservas",), rebuild_payer_counts),
    "vip_counts": ("cliente_vip", ("contador_reservas",), rebuild_vip_counts),
    "room_state": ("habitacion", ("estado",), rebuild_room_state),
}


def audit(hotel: Hotel, name: str) -> DataFrame:
    """Keys whose cached values differ from the recomputed ones, with both values."""
    table, columns, rebuild = REBUILDS[name]
    key = TABLES[table].key
    stored = hotel.table(table).select(key, *[F.col(c).alias(f"{c}_guardado") for c in columns])
    fresh = rebuild(hotel).select(key, *[F.col(c).alias(f"{c}_recalculado") for c in columns])
    drifted = reduce(
        lambda a, b: a | b,
        [~F.col(f"{c}_guardado").eqNullSafe(F.col(f"{c}_recalculado")) for c in columns],
    )
    return stored.join(fresh, key).filter(drifted)


def reconcile(hotel: Hotel) -> Hotel:
    """All rebuilds in dependency order: bookings, accounts, invoices, payments, counters, rooms."""
    for table, _, rebuild in REBUILDS.values():
        hotel = hotel.replace(**{table: conform(rebuild(hotel), TABLES[table].struct)})
    return hotel
