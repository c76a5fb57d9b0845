"""Goldens worked out by hand from the generator's formulas (scale 1, anchor 2026-05-15)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from innsight.operators import billing, bookings, guests, occupancy, quality, reconcile
from innsight.params import Params
from innsight.sources.generator import ANCHOR, generate

P = Params(ANCHOR)


def counts(df, *by):
    return {tuple(r[c] for c in by) if len(by) > 1 else r[by[0]]: r["count"] for r in df.groupBy(*by).count().collect()}


ROWS = {
    "huesped": 50, "usuario": 50, "empleado": 50, "categoria_habitacion": 50, "evento_temporada": 50,
    "tipo_servicio": 50, "huesped_facturador": 50, "cliente_vip": 50, "habitacion": 50, "bono_empleado": 50,
    "paquete_promocional": 50, "servicio": 50, "reservacion": 120, "reservacion_habitacion": 120, "estancia": 60,
    "cancelacion": 50, "cuenta": 60, "detalle_cuenta": 180, "factura": 50, "pago": 50,
    "detalle_paquete_promocional": 50, "consumo_servicio": 120, "bitacora_habitacion": 110, "queja": 50,
    "satisfaccion": 50,
}


def test_row_counts(seed):
    assert {n: seed.table(n).count() for n in seed.names()} == ROWS


def test_states(seed):
    assert counts(seed.factura, "estado_factura") == {"pagada": 43, "pendiente": 4, "vencida": 3}
    assert counts(seed.pago, "estado") == {"completado": 43, "pendiente": 4, "reembolsado": 3}
    assert seed.cancelacion.filter("penalizacion > 0").count() == 30
    assert seed.queja.filter("fecha_resolucion IS NULL").count() == 10
    assert counts(seed.satisfaccion, "calificacion") == {5: 35, 4: 10, 3: 3, 2: 2}
    assert counts(seed.tipo_servicio, "categoria") == {"interno": 30, "externo": 20}


def test_counters(seed):
    def expected(*ranges):
        return {i: value for low, high, value in ranges for i in range(low, high + 1)}

    got = {r[0]: r[1] for r in seed.huesped_facturador.select("id_huesped_facturador", "numero_reservas").collect()}
    assert got == expected((1, 5, 12), (6, 10, 2), (11, 30, 1), (31, 40, 2), (41, 50, 1))
    got = {r[0]: r[1] for r in seed.cliente_vip.select("id_huesped_facturador", "contador_reservas").collect()}
    assert got == expected((1, 5, 8), (6, 10, 2), (11, 30, 0), (31, 50, 1))


def test_occupied_rooms(seed):
    busy = {r[0] for r in seed.habitacion.filter("estado = 'ocupada'").select("id_habitacion").collect()}
    assert busy == {7, 8, 14, 15, 21, 22, 29, 36, 43, 50}


def test_reports(seed):
    assert occupancy.current_stays(seed).count() == 10
    assert occupancy.guests_in_house(seed).count() == 10
    assert occupancy.vips_in_house(seed).count() == 10
    share = counts(occupancy.occupancy_by_category(seed, P), "porcentaje_ocupacion")
    assert share == {100.0: 10, 0.0: 40}
    for empty in (
        bookings.due_without_checkin(seed, P), bookings.arrivals_next_7_days(seed, P), bookings.stale_bookings(seed, P),
        billing.invoices_collected(seed, P), billing.unpaid_invoices(seed, P), guests.guests_without_email(seed),
    ):
        assert empty.count() == 0
    assert [r.id_reservacion for r in bookings.cancellations(seed, P).collect()] == [51]
    assert [r.reservas_reales for r in guests.frequent_clients(seed).collect()] == [8] * 5
    assert bookings.repeat_cancellers(seed).count() == 20
    stats = billing.daily_billing_stats(seed, P).collect()
    assert len(stats) == 1 and stats[0].dias_con_factura == 0 and stats[0].total_periodo is None
    assert occupancy.monthly_occupancy(seed, P).count() == 40
    audit = occupancy.room_audit(seed, 1).collect()
    assert [r.id_reservacion for r in audit] == [50, 50]
    assert billing.monthly_income(seed, 2026, 4).count() == 1
    assert billing.monthly_income(seed, 1999, 1).count() == 0


def test_reconciled_data_shows_no_drift(seed):
    for name in reconcile.REBUILDS:
        assert reconcile.audit(seed, name).count() == 0, name


def test_generated_data_is_clean(seed):
    assert quality.primary_keys(seed).filter("claves_repetidas > 0 OR filas_nulas > 0").count() == 0
    assert quality.unique_keys(seed).filter("claves_repetidas > 0").count() == 0
    assert quality.foreign_keys(seed).filter("filas_huerfanas > 0").count() == 0
    assert quality.row_rules(seed).filter("filas > 0").count() == 0


def test_blocks_repeat_with_their_own_keys(spark):
    hotel = generate(spark, scale=3, anchor=dt.date(2026, 5, 15))
    assert hotel.reservacion.count() == 360
    assert quality.unique_keys(hotel).filter("claves_repetidas > 0").count() == 0
    assert quality.foreign_keys(hotel).filter("filas_huerfanas > 0").count() == 0
    per_block = hotel.habitacion.filter("estado = 'ocupada'").groupBy(F.floor((F.col("id_habitacion") - 1) / 50)).count()
    assert {r["count"] for r in per_block.collect()} == {10}
