"""Express check-out: close the stay and the account, invoice, collect, release the room."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions import money, ntz
from innsight.plans._common import dedupe_requests, first_reason, known, mark_first, new_id, split
from innsight.plans.rooms import move_rooms
from innsight.schemas import TASA_IVA
from innsight.session import checkpoint
from innsight.tables import Delta, Hotel


def checkout(hotel: Hotel, requests: DataFrame, now: dt.datetime, strict: bool = False) -> Delta:
    """Requests (request_id, arrival, id_reservacion, id_empleado).

    An account may be invoiced again; ``strict`` refuses bookings without an
    open stay and all but the earliest request for a booking.
    """
    requests, repeats = dedupe_requests(requests)
    today = F.lit(now.date())
    accounts = hotel.cuenta.select("id_reservacion", "id_cuenta", "fecha_apertura", "fecha_cierre", "subtotal", "total")
    bookings = hotel.reservacion.select("id_reservacion", "id_huesped_facturador")
    open_stays = hotel.estancia.filter(F.col("fecha_hora_checkout_real").isNull())
    judged = (
        requests.select("request_id", "arrival", "id_reservacion", "id_empleado")
        .join(accounts, "id_reservacion", "left")
        .join(bookings, "id_reservacion", "left")
        .join(known(hotel.empleado, "id_empleado", "_empleado"), "id_empleado", "left")
    )
    rules = [
        ("no_account", F.col("id_cuenta").isNull() | F.col("id_huesped_facturador").isNull()),
        ("account_opens_later", F.col("fecha_cierre").isNull() & (F.col("fecha_apertura") > today)),
        ("unknown_employee", F.col("_empleado").isNull()),
        ("nothing_to_pay", F.col("total") <= 0),
    ]
    if strict:
        judged = mark_first(judged, "id_reservacion").join(
            known(open_stays, "id_reservacion", "_abierta"), "id_reservacion", "left"
        )
        rules += [("no_open_stay", F.col("_abierta").isNull()), ("duplicate_request", ~F.col("es_primera"))]
    accepted, rejected = split(checkpoint(judged.withColumn("motivo_rechazo", first_reason(*rules))))

    done = accepted.select("id_reservacion").distinct()
    closing = open_stays.join(done, "id_reservacion", "left_semi")
    stays = closing.withColumn("fecha_hora_checkout_real", ntz(now)).select(*hotel.estancia.columns)
    closed = (
        hotel.cuenta.filter(F.col("fecha_cierre").isNull())
        .join(done, "id_reservacion", "left_semi")
        .withColumn("fecha_cierre", today)
        .select(*hotel.cuenta.columns)
    )
    completed = (
        hotel.reservacion.join(done, "id_reservacion", "left_semi")
        .withColumn("estado", F.lit("completada"))
        .select(*hotel.reservacion.columns)
    )
    invoices = accepted.select(
        new_id("factura", "request_id").alias("id_factura"),
        "id_cuenta",
        "id_huesped_facturador",
        "id_empleado",
        today.alias("fecha_emision"),
        "subtotal",
        money(F.col("subtotal") * F.lit(TASA_IVA).cast("decimal(3,2)")).alias("impuestos"),
        "total",
        F.lit("pagada").alias("estado_factura"),
    )
    # short numbers are padded, longer ones kept whole
    number = F.col("id_factura").cast("string")
    payments = invoices.select(
        new_id("pago", "id_factura").alias("id_pago"),
        "id_factura",
        today.alias("fecha_pago"),
        F.col("total").alias("monto"),
        F.lit("efectivo").alias("metodo_pago"),
        F.concat(F.lit("FAST-"), F.repeat(F.lit("0"), 6 - F.length(number)), number).alias("referencia"),
        F.lit("completado").alias("estado"),
    )
    released = move_rooms(hotel, closing.select("id_habitacion").distinct(), ("ocupada",), "limpieza", ntz(now))
    return Delta(
        {"factura": invoices, "pago": payments, **released.inserts},
        {"estancia": stays, "cuenta": closed, "reservacion": completed, **released.updates},
        rejected.unionByName(repeats),
    )
