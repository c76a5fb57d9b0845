"""Named queries over the fixture tables, one per operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight import plans, streaming
from innsight.operators import billing, bookings, guests, occupancy, quality, reconcile, services, staff
from innsight.params import Params
from innsight.sources.fixture import (
    FIXTURE_TODAY,
    booking_followups,
    booking_requests,
    checkin_requests,
    fixture_hotel,
    room_events,
    service_requests,
    stream_bookings,
    stream_consumption,
    stream_room_events,
    stream_service_requests,
)
from innsight.sources.store import append, commit, read_hotel, read_table, write_hotel
from innsight.tables import Delta, Hotel

Query = Callable[[SparkSession, str], DataFrame]
P = Params(FIXTURE_TODAY)
NOW = dt.datetime(2001, 6, 15, 11)
NEXT_MONTH = FIXTURE_TODAY + dt.timedelta(days=30)


def _on_hotel(build: Callable[[Hotel], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(fixture_hotel(spark, sf_dir))


def _reports() -> dict[str, Callable[[Hotel], DataFrame]]:
    return {
        "q01_available_rooms": lambda h: occupancy.available_rooms(h, P),
        "q01_available_rooms_between": lambda h: occupancy.available_rooms(h, P, P.hoy, NEXT_MONTH),
        "q02_current_stays": occupancy.current_stays,
        "q03_due_without_checkin": lambda h: bookings.due_without_checkin(h, P),
        "q04_occupancy_by_category": lambda h: occupancy.occupancy_by_category(h, P),
        "q05_arrivals_next_7_days": lambda h: bookings.arrivals_next_7_days(h, P),
        "q06_cancellations": lambda h: bookings.cancellations(h, P),
        "q07_frequent_clients": guests.frequent_clients,
        "q08_top_services": lambda h: services.top_services(h, P),
        "q09_payments_by_status": lambda h: billing.payments_by_status(h, P),
        "q10_invoices_collected": lambda h: billing.invoices_collected(h, P),
        "q11_top_clients": guests.top_clients,
        "q12_idle_rooms": lambda h: occupancy.idle_rooms(h, P),
        "q13_avg_stay_by_category": occupancy.avg_stay_by_category,
        "q14_unused_services": lambda h: services.unused_services(h, P),
        "q15_bookings_by_category": lambda h: bookings.bookings_by_category(h, P),
        "q16_repeat_cancellers": bookings.repeat_cancellers,
        "q17_bookings_by_country": bookings.bookings_by_country,
        "q18_daily_billing_stats": lambda h: billing.daily_billing_stats(h, P),
        "q19_guests_without_email": guests.guests_without_email,
        "q20_vips_in_house": occupancy.vips_in_house,
        "q21_room_audit": occupancy.room_audit,
        "q22_unpaid_invoices": lambda h: billing.unpaid_invoices(h, P),
        "q23_stale_bookings": lambda h: bookings.stale_bookings(h, P),
        "q24_monthly_occupancy": lambda h: occupancy.monthly_occupancy(h, P),
        "q24b_monthly_occupancy_exact": lambda h: occupancy.monthly_occupancy_exact(h, P),
        "q25_revenue_by_category": lambda h: bookings.revenue_by_category(h, P),
        "q26_employee_bonuses": lambda h: staff.employee_bonuses(h, P),
        "q27_vip_top_services": services.vip_top_services,
        "q28_complaints_by_department": lambda h: staff.complaints_by_department(h, P),
        "q29_satisfaction_ranking": lambda h: staff.satisfaction_ranking(h, P),
        "q30_longest_stay_per_category": lambda h: occupancy.longest_stay_per_category(h, P),
        "p_h_guests_in_house": occupancy.guests_in_house,
        "p_i_monthly_income": billing.monthly_income,
        "p_i_income_of_month": lambda h: billing.monthly_income(h, P.last_month.start.year, P.last_month.start.month),
        "v1_employee_public": staff.employee_public,
        "v2_user_public": guests.user_public,
        "v3_booking_finance": billing.booking_finance,
    }


def _upkeep() -> dict[str, Callable[[Hotel], DataFrame]]:
    found: dict[str, Callable[[Hotel], DataFrame]] = {}
    for i, (name, (_, _, rebuild)) in enumerate(reconcile.REBUILDS.items(), start=1):
        found[f"r{i}_{name}"] = rebuild
        found[f"r{i}_audit_{name}"] = lambda h, name=name: reconcile.audit(h, name)
    found |= {
        "dq_primary_keys": quality.primary_keys,
        "dq_unique_keys": quality.unique_keys,
        "dq_foreign_keys": quality.foreign_keys,
        "dq_row_rules": lambda h: quality.row_rules(h, "regla"),
        "dq_required_columns": lambda h: quality.row_rules(h, "obligatorio"),
        "ref_delete_rejected": lambda h: _purge(h).rejected,
        "ref_delete_removed": _purged_keys,
    }
    return found


def _purge(h: Hotel) -> quality.Deletion:
    """Delete every booking that ended more than a year ago, where references allow it."""
    old = h.reservacion.filter(F.col("fecha_salida") < F.lit(P.last_year.start)).select("id_reservacion")
    return quality.cascade_delete(h, "reservacion", old)


def _purged_keys(h: Hotel) -> DataFrame:
    parts = [
        keys.select(F.lit(table).alias("tabla"), F.col(keys.columns[0]).alias("llave"))
        for table, keys in _purge(h).deleted.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _insert(delta: Delta, table: str, *generated: str) -> DataFrame:
    """New rows of ``table`` without the keys hashed for them."""
    return delta.inserts[table].drop(*generated)


def _book(spark: SparkSession, sf_dir: str) -> Delta:
    return plans.book(fixture_hotel(spark, sf_dir), booking_requests(spark, sf_dir))


def _availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = plans.check_availability(fixture_hotel(spark, sf_dir), booking_requests(spark, sf_dir))
    return judged.select("request_id", "disponible", "motivo_rechazo")


def _set_state(spark: SparkSession, sf_dir: str) -> Delta:
    requests = room_events(spark, sf_dir).select(
        "request_id",
        F.col("fecha_hora").alias("arrival"),
        "id_habitacion",
        "estado",
        (F.col("request_id") % 10).alias("id_empleado"),
        F.lit(None).cast("long").alias("id_reservacion"),
    )
    return plans.set_room_state(fixture_hotel(spark, sf_dir), requests)


def _check_in(h: Hotel) -> Delta:
    return plans.check_in(h, checkin_requests(h), NOW)


def _checkout(h: Hotel) -> Delta:
    return plans.checkout(h, booking_followups(h), NOW)


def _checkout_twice(h: Hotel) -> Delta:
    """Every booking asks to leave twice; ``strict`` lets the earlier request through."""
    asked = booking_followups(h)
    again = asked.withColumns(
        {"request_id": -F.col("request_id") - 1, "arrival": F.expr("arrival + INTERVAL '1' HOUR")}
    )
    return plans.checkout(h, asked.unionByName(again), NOW, strict=True)


def _cancel(h: Hotel, strict_release: bool = False) -> Delta:
    return plans.cancel(h, booking_followups(h), NOW, strict_release)


def _register(spark: SparkSession, sf_dir: str) -> Delta:
    return plans.register_services(fixture_hotel(spark, sf_dir), service_requests(spark, sf_dir), NOW)


def _recomputed(h: Hotel) -> DataFrame:
    delta = plans.recompute_vip(h, P.hoy)
    return delta.updates["cliente_vip"].unionByName(delta.inserts["cliente_vip"]).drop("id_vip")


def _consumption_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = service_requests(spark, sf_dir).withColumn("precio_unitario", F.lit(1).cast("decimal(12,2)"))
    return plans.validate_consumption(rows)[1].select("request_id", "motivo_rechazo")


def _correction_refused(h: Hotel) -> DataFrame:
    """Recorded consumption with a discount on its price; a price must stay positive, a quantity is not asked again."""
    cheaper = h.consumo_servicio.withColumn("precio_unitario", F.expr("cast(precio_unitario - 1000 as decimal(12,2))"))
    return plans.validate_consumption(cheaper, updating=True)[1].select("id_consumo", "precio_unitario", "motivo_rechazo")


def _appliers() -> dict[str, Query]:
    stored: dict[str, Callable[[Hotel], DataFrame]] = {
        "p_c_checkout_invoices": lambda h: _insert(_checkout(h), "factura", "id_factura"),
        "p_c_checkout_payments": lambda h: _insert(_checkout(h), "pago", "id_pago", "id_factura", "referencia"),
        "p_c_checkout_stays": lambda h: _checkout(h).updates["estancia"],
        "p_c_checkout_accounts": lambda h: _checkout(h).updates["cuenta"],
        "p_c_checkout_bookings": lambda h: _checkout(h).updates["reservacion"],
        "p_c_checkout_rooms": lambda h: _checkout(h).updates["habitacion"],
        "p_c_checkout_log": lambda h: _insert(_checkout(h), "bitacora_habitacion", "id_bitacora"),
        "p_c_checkout_rejected": lambda h: _checkout(h).rejected,
        "p_c_checkout_strict_invoices": lambda h: _insert(_checkout_twice(h), "factura", "id_factura"),
        "p_c_checkout_strict_rejected": lambda h: _checkout_twice(h).rejected,
        "p_f_cancel_rows": lambda h: _insert(_cancel(h), "cancelacion", "id_cancelacion"),
        "p_f_cancel_rejected": lambda h: _cancel(h).rejected,
        "t_j_cancel_bookings": lambda h: _cancel(h).updates["reservacion"],
        "t_j_cancel_rooms": lambda h: _cancel(h).updates["habitacion"],
        "t_j_cancel_rooms_strict": lambda h: _cancel(h, strict_release=True).updates["habitacion"],
        "p_g_recompute_vip": _recomputed,
        "p_j_propose_upgrades": lambda h: plans.propose_upgrades(h, booking_followups(h)).drop("arrival"),
        "p_j_upgrade_rows": lambda h: plans.upgrade(h, booking_followups(h)).updates["reservacion_habitacion"],
        "p_j_upgrade_rejected": lambda h: plans.upgrade(h, booking_followups(h)).rejected,
        "t_a_checkin_stays": lambda h: _insert(_check_in(h), "estancia", "id_estancia"),
        "t_a_checkin_rooms": lambda h: _check_in(h).updates["habitacion"],
        "t_g_checkin_rejected": lambda h: _check_in(h).rejected,
        "t_d_enrol_vip": lambda h: _insert(plans.enrol_vip(h, h.huesped_facturador, P.hoy), "cliente_vip", "id_vip"),
        "t_e_count_bookings_payers": lambda h: plans.count_bookings(h, h.reservacion).updates["huesped_facturador"],
        "t_e_count_bookings_vips": lambda h: plans.count_bookings(h, h.reservacion).updates["cliente_vip"],
        "t_e_count_bookings_legacy": lambda h: plans.count_bookings(h, h.reservacion, True).updates["cliente_vip"],
        "t_h_expire_bookings": lambda h: plans.expire_bookings(h, P.hoy).updates["reservacion"],
        "t_i_correction_rejected": _correction_refused,
        "t_i_service_prices": lambda h: plans.validate_service_prices(h.servicio)[0],
    }
    batches: dict[str, Query] = {
        "p_a_book_bookings": lambda s, d: _insert(_book(s, d), "reservacion", "id_reservacion"),
        "p_a_book_rooms": lambda s, d: _insert(
            _book(s, d), "reservacion_habitacion", "id_reservacion", "id_reservacion_habitacion"
        ),
        "p_a_book_vips": lambda s, d: _book(s, d).updates["cliente_vip"],
        "p_a_book_rejected": lambda s, d: _book(s, d).rejected,
        "p_b_state_log": lambda s, d: _insert(_set_state(s, d), "bitacora_habitacion", "id_bitacora"),
        "p_b_state_rooms": lambda s, d: _set_state(s, d).updates["habitacion"],
        "p_d_check_availability": _availability,
        "p_e_service_consumption": lambda s, d: _insert(_register(s, d), "consumo_servicio", "id_consumo"),
        "p_e_service_lines": lambda s, d: _insert(_register(s, d), "detalle_cuenta", "id_detalle_cuenta"),
        "p_e_service_rejected": lambda s, d: _register(s, d).rejected,
        "t_c_room_state_log": lambda s, d: plans.room_state_log(room_events(s, d)),
        "t_f_booking_dates": lambda s, d: plans.validate_booking_dates(booking_requests(s, d))[1],
        "t_i_consumption_rejected": _consumption_refused,
    }
    return {**{name: _on_hotel(build) for name, build in stored.items()}, **batches}


def _stored(spark: SparkSession, sf_dir: str, *names: str) -> tuple[Hotel, str]:
    """Some tables of the fixture hotel, stored in a folder of their own and read back."""
    root = streaming.work_dir(spark, "hotel")
    hotel = fixture_hotel(spark, sf_dir)
    write_hotel(Hotel(spark, {name: (lambda name=name: hotel.table(name)) for name in names}), root)
    return read_hotel(spark, root), root


def _read_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings of the last year, from the months that hold them."""
    _, root = _stored(spark, sf_dir, "reservacion")
    return read_table(spark, root, "reservacion", P.last_year.start, P.last_year.end).drop("mes")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices appended in two batches, those due and those paid."""
    path = streaming.work_dir(spark, "appended")
    invoices = fixture_hotel(spark, sf_dir).factura
    append(invoices.filter("estado_factura <> 'pagada'"), path)
    append(invoices.filter("estado_factura = 'pagada'"), path)
    return spark.read.schema(invoices.schema).parquet(path)


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bookings after those that nobody came for have expired."""
    hotel, root = _stored(spark, sf_dir, "reservacion", "estancia")
    return commit(hotel, plans.expire_bookings(hotel, P.hoy), root).reservacion


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored members after two enrolments of every payer."""
    hotel, root = _stored(spark, sf_dir, "cliente_vip", "huesped_facturador")
    everybody = hotel.replace(cliente_vip=hotel.cliente_vip.limit(0))
    fresh = plans.enrol_vip(everybody, hotel.huesped_facturador, P.hoy).inserts["cliente_vip"]
    # a member's own key, so that a payer who is enrolled already is absent only once
    delta = Delta(inserts={"cliente_vip": fresh.withColumn("id_vip", F.col("id_huesped_facturador"))})
    return commit(commit(hotel, delta, root), delta, root).cliente_vip


def _storage() -> dict[str, Query]:
    return {
        "src_read_stored": _read_stored,
        "snk1_append": _appended,
        "snk2_update": _updated,
        "snk3_insert_if_absent": _inserted,
    }


def _stream_room_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = streaming.RoomLog(spark, streaming.work_dir(spark, "room-log"))
    log.run(stream_room_events(spark, sf_dir))
    return log.closed_log()


def _stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = streaming.work_dir(spark, "counters")
    streaming.run_booking_counters(stream_bookings(spark, sf_dir), root)
    return streaming.booking_counters(spark, root)


def _stream_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = streaming.work_dir(spark, "validator")
    rows = stream_service_requests(spark, sf_dir).withColumn("precio_unitario", F.lit(1).cast("decimal(12,2)"))
    streaming.run_consumption_validator(rows, root)
    valid = spark.read.parquet(f"{root}/validos").select("request_id", F.lit(None).cast("string").alias("motivo_rechazo"))
    refused = spark.read.parquet(f"{root}/rechazados").select("request_id", "motivo_rechazo")
    return valid.unionByName(refused)


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = streaming.work_dir(spark, "windows")
    streaming.run_consumption_windows(stream_consumption(spark, sf_dir), root)
    return streaming.consumption_windows(spark, root)


def _streams() -> dict[str, Query]:
    return {
        "s1_room_state_log": _stream_room_log,
        "s2_booking_counters": _stream_counters,
        "s3_consumption_validator": _stream_validator,
        "s4_consumption_windows": _stream_windows,
    }


def queries() -> dict[str, Query]:
    builds = {**_reports(), **_upkeep()}
    return {**{name: _on_hotel(build) for name, build in builds.items()}, **_appliers(), **_storage(), **_streams()}
