"""Batch appliers against sequential brute force on small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from innsight import plans
from innsight.operators import occupancy, quality, reconcile
from innsight.plans.rooms import previous_value
from innsight.plans.vip import positions
from innsight.sources.generator import ANCHOR, generate

NOW = dt.datetime(2026, 5, 15, 11)
T0 = dt.datetime(2026, 1, 1)
REQUEST_SPAN = ["id_habitacion", "fecha_inicio", "fecha_salida"]
REQUEST = "request_id long, arrival timestamp_ntz, id_habitacion long, fecha_inicio date, fecha_salida date"


def day(n: int) -> dt.date:
    return ANCHOR + dt.timedelta(days=n)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def overlap(a, b) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def sequential(requests):
    granted, taken = set(), {}
    for rid, _, room, start, end in sorted(requests, key=lambda r: (r[1], r[0])):
        if all(not overlap((start, end), span) for span in taken.get(room, [])):
            granted.add(rid)
            taken.setdefault(room, []).append((start, end))
    return granted


def random_requests(seed: int, n: int, rooms: int):
    """A third of all requests want room 1."""
    rng = random.Random(seed)
    found = []
    for i in range(n):
        start = rng.randrange(40)
        room = 1 if i % 3 == 0 else rng.randrange(rooms) + 1
        found.append((i, T0 + dt.timedelta(minutes=rng.randrange(n)), room, day(start), day(start + 1 + rng.randrange(6))))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_come_equals_sequential_calls(spark, seed):
    requests = random_requests(seed, 150, 6)
    got = {r[0] for r in plans.first_come(spark.createDataFrame(requests, REQUEST)).collect()}
    assert got == sequential(requests)


def test_first_come_resolves_a_staircase(spark):
    """Each request overlaps the next: every second one is granted."""
    requests = [(i, T0 + dt.timedelta(minutes=i), 1, day(i), day(i + 2)) for i in range(9)]
    got = {r[0] for r in plans.first_come(spark.createDataFrame(requests, REQUEST)).collect()}
    assert got == {0, 2, 4, 6, 8}


def test_a_long_staircase_takes_no_more_jobs(spark):
    def jobs(n):
        requests = [(i, T0 + dt.timedelta(minutes=i), 1, day(i), day(i + 2)) for i in range(n)]
        frame = spark.createDataFrame(requests, REQUEST)
        spark.sparkContext.setJobGroup(f"staircase-{n}", "")
        got = {r[0] for r in plans.first_come(frame).collect()}
        assert got == set(range(0, n, 2))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"staircase-{n}"))

    assert jobs(200) == jobs(9)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_requests_for_one_room(spark):
    """A room that all ask for, and repeated requests: only the earliest of equal ones is kept on the way."""
    rng = random.Random(8)
    requests = []
    for i in range(3000):
        start = rng.randrange(40)
        arrival = None if i % 500 == 7 else T0 + dt.timedelta(minutes=rng.randrange(900))
        requests.append((i, arrival, None if i % 3 == 0 else 1, day(start), day(start + rng.randrange(6))))
    granted: dict = {}
    for i, arrival, room, a, b in sorted(requests, key=lambda r: (r[1] is not None, r[1] or T0, r[0])):
        if a < b and not any(a < y and b > x for x, y, _ in granted.get(room, ())):
            granted.setdefault(room, []).append((a, b, i))
    got = {r[0] for r in plans.first_come(spark.createDataFrame(requests, REQUEST).repartition(8)).collect()}
    assert got == {i for found in granted.values() for *_, i in found}


def test_calendar_of_months(spark, seed):
    """Stays over month and year ends, of a single night and of many months, against the nights themselves."""
    rng = random.Random(4)
    hotel = seed.replace(
        reservacion=seed.reservacion.withColumn("fecha_salida", F.date_add("fecha_inicio", (F.col("id_reservacion") % 97).cast("int")))
    )
    spans = [(i, 1 + rng.randrange(50), rng.randrange(-200, 200), rng.choice([1, 2, 31, 70])) for i in range(400)]
    rows = [(i, T0, room, day(a), day(a + n)) for i, room, a, n in spans]
    got = dict(rows_of(plans.check_availability(hotel, spark.createDataFrame(rows, REQUEST)), "request_id", "disponible"))
    stays = hotel.reservacion.filter("estado not in ('cancelada', 'expirada')").drop("subtotal")
    held = rows_of(hotel.reservacion_habitacion.join(stays, "id_reservacion"), "id_habitacion", "fecha_inicio", "fecha_salida")
    state = dict(rows_of(hotel.habitacion, "id_habitacion", "estado"))
    for i, room, a, n in spans:
        busy = state[room] in ("mantenimiento", "fuera_de_servicio")
        assert got[i] == (not busy and not any(r == room and x < day(a + n) and y > day(a) and x < y for r, x, y in held))


def booking_requests(spark, spans):
    rows = [
        (i, T0 + dt.timedelta(minutes=i), guest, guest, 1, start, end, method, room)
        for i, (guest, room, start, end, method) in enumerate(spans)
    ]
    return spark.createDataFrame(
        rows,
        "request_id long, arrival timestamp_ntz, id_huesped long, id_huesped_facturador long, id_usuario long,"
        "fecha_inicio date, fecha_salida date, metodo string, id_habitacion long",
    )


def test_book_reasons_and_money(spark, seed):
    far = [day(200), day(203)]
    requests = booking_requests(
        spark,
        [
            (1, 1, *far, "internet"),
            (2, 1, day(202), day(204), "internet"),
            (3, 2, day(5), day(5), "internet"),
            (3, 999, *far, "internet"),
            (999, 3, *far, "internet"),
            (3, 3, *far, "paloma"),
            (4, 8, day(0), day(1), "internet"),
            (5, 1, day(203), day(204), "telefono"),
        ],
    )
    delta = plans.book(seed, requests)
    assert dict(rows_of(delta.rejected, "request_id", "motivo_rechazo")) == {
        1: "taken_in_batch", 2: "invalid_range", 3: "unknown_room", 4: "unknown_guest", 5: "invalid_method",
        6: "room_unavailable",
    }
    booked = {r.id_huesped: r for r in delta.inserts["reservacion"].collect()}
    assert set(booked) == {1, 5}
    rate = seed.habitacion.filter("id_habitacion = 1").first().precio
    assert booked[1].subtotal == rate * 3 and float(booked[1].total) == round(float(rate) * 3 * 1.16, 2)
    assert {r.estado for r in booked.values()} == {"confirmada"}

    after = seed.apply(delta)
    assert after.reservacion.count() == 122 and after.reservacion_habitacion.count() == 122
    assert reconcile.audit(after, "payer_counts").count() == 0
    assert reconcile.audit(after, "vip_counts").count() == 0
    again = plans.book(after, requests)
    assert again.inserts["reservacion"].count() == 0


def test_requests_without_dates_are_refused(spark, seed):
    open_ended = booking_requests(spark, [(1, 1, day(200), None, "internet"), (1, 1, None, day(200), "internet")])
    delta = plans.book(seed, open_ended)
    assert {r.motivo_rechazo for r in delta.rejected.collect()} == {"invalid_range"} and delta.rejected.count() == 2
    assert delta.inserts["reservacion"].count() == 0
    assert plans.first_come(open_ended.select("request_id", "arrival", *REQUEST_SPAN)).count() == 0
    assert plans.check_availability(seed, open_ended).filter("disponible IS NULL").count() == 2
    assert plans.validate_booking_dates(open_ended)[0].count() == 0


def test_a_request_delivered_twice_is_done_once(spark, seed):
    booking = booking_requests(spark, [(1, 1, day(200), day(203), "internet")])
    delta = plans.book(seed, booking.union(booking))
    assert delta.inserts["reservacion"].count() == 1 and delta.inserts["reservacion_habitacion"].count() == 1
    assert [r.motivo_rechazo for r in delta.rejected.collect()] == ["duplicate_request"]
    leaving = followups(spark, [101])
    bill = plans.checkout(seed, leaving.union(leaving), NOW)
    assert bill.inserts["factura"].count() == 1 and bill.rejected.count() == 1
    state = spark.createDataFrame(
        [(1, T0, 1, "limpieza", 1, None), (1, T0, 1, "limpieza", 1, None), (2, None, 1, "limpieza", 1, None)],
        "request_id long, arrival timestamp_ntz, id_habitacion long, estado string, id_empleado long, id_reservacion long",
    )
    moved = plans.set_room_state(seed, state)
    assert moved.inserts["bitacora_habitacion"].count() == 1
    assert dict(rows_of(moved.rejected, "request_id", "motivo_rechazo")) == {1: "duplicate_request", 2: "missing_arrival"}


def test_booking_a_batch_leaves_no_overlap(spark, seed):
    rng = random.Random(7)
    spans = []
    for i in range(120):
        start = 100 + rng.randrange(30)
        spans.append((1 + i % 50, 1 + rng.randrange(5), day(start), day(start + 1 + rng.randrange(5)), "internet"))
    after = seed.apply(plans.book(seed, booking_requests(spark, spans)))
    rooms = after.reservacion_habitacion.join(after.reservacion.drop("subtotal"), "id_reservacion").filter(
        "fecha_inicio >= date'2026-08-01'"
    )
    held = rows_of(rooms, "id_habitacion", "fecha_inicio", "fecha_salida")
    assert len(held) > 20
    for i, a in enumerate(held):
        assert all(a[0] != b[0] or not overlap(a[1:], b[1:]) for b in held[i + 1:])


def test_availability_of_one_request(spark, seed):
    """Room 8 is held by an in-house booking; back-to-back dates are free."""
    end = seed.reservacion.join(seed.reservacion_habitacion, "id_reservacion").filter(
        "id_habitacion = 8 AND estado = 'check_in'"
    ).first().fecha_salida
    one = dt.timedelta(days=1)
    asked = [(1, T0, 8, end - one, end), (2, T0, 8, end, end + one), (3, T0, 99, end, end + one), (4, T0, 8, end, end)]
    got = plans.check_availability(seed, spark.createDataFrame(asked, REQUEST))
    assert {r.request_id: (r.disponible, r.motivo_rechazo) for r in got.collect()} == {
        1: (0, None), 2: (1, None), 3: (None, "unknown_room"), 4: (None, "invalid_range"),
    }


def followups(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=i), booking, 1, 1, "motivo") for i, booking in enumerate(rows)],
        "request_id long, arrival timestamp_ntz, id_reservacion long, id_empleado long, id_usuario long, motivo string",
    )


def test_checkout(spark, seed):
    requests = followups(spark, [101, 101, 1, 111, 999])
    loose = plans.checkout(seed, requests, NOW)
    assert loose.inserts["factura"].count() == 3
    strict = plans.checkout(seed, requests, NOW, strict=True)
    assert dict(rows_of(strict.rejected, "request_id", "motivo_rechazo")) == {
        1: "duplicate_request", 2: "no_open_stay", 3: "no_account", 4: "no_account",
    }
    assert strict.inserts["factura"].count() == 1
    after = seed.apply(strict)
    assert after.reservacion.filter("id_reservacion = 101").first().estado == "completada"
    assert after.estancia.filter("id_reservacion = 101").first().fecha_hora_checkout_real == NOW
    room = after.estancia.filter("id_reservacion = 101").first().id_habitacion
    assert after.habitacion.filter(f"id_habitacion = {room}").first().estado == "limpieza"
    assert after.cuenta.filter("id_reservacion = 101").first().fecha_cierre == NOW.date()
    paid = after.pago.join(strict.inserts["factura"].select("id_factura"), "id_factura").first()
    assert paid.referencia == f"FAST-{paid.id_factura:06d}"
    log = strict.inserts["bitacora_habitacion"].first()
    assert (log.estado_anterior, log.estado_nuevo, log.id_empleado) == ("ocupada", "limpieza", None)


def test_cancel(spark, seed):
    delta = plans.cancel(seed, followups(spark, [111, 111, 1, 51, 999, 101]), NOW)
    assert dict(rows_of(delta.rejected, "request_id", "motivo_rechazo")) == {
        1: "final_state", 2: "final_state", 3: "final_state", 4: "unknown_booking",
    }
    fines = {r.id_reservacion: float(r.penalizacion) for r in delta.inserts["cancelacion"].collect()}
    rooms = float(seed.reservacion_habitacion.filter("id_reservacion = 101").first().subtotal)
    assert fines == {111: 0.0, 101: round(rooms * 0.55, 2)}
    after = seed.apply(delta)
    assert after.reservacion.filter("estado = 'cancelada'").count() == 52
    assert {r.estado for r in delta.updates["habitacion"].collect()} == {"disponible"}


def test_strict_release_keeps_rooms_others_sleep_in(spark, seed):
    """Booking 111 is moved into the room of in-house booking 101, then cancelled."""
    room = seed.estancia.filter("id_reservacion = 101").first().id_habitacion
    moved = seed.reservacion_habitacion.withColumn(
        "id_habitacion", F.when(F.col("id_reservacion") == 111, room).otherwise(F.col("id_habitacion"))
    )
    hotel = seed.replace(reservacion_habitacion=moved)
    request = followups(spark, [111])
    assert plans.cancel(hotel, request, NOW).updates["habitacion"].count() == 1
    assert plans.cancel(hotel, request, NOW, strict_release=True).updates["habitacion"].count() == 0


def test_register_services(spark, seed):
    hotel = seed.replace(
        servicio=seed.servicio.withColumn("disponible", F.col("id_servicio") != 2)
    )
    requests = spark.createDataFrame(
        [(0, 101, 1, 1, 3), (1, 101, 1, 1, 0), (2, 101, 77, 1, 1), (3, 101, 2, 1, 1), (4, 999, 1, 1, 1),
         (5, 51, 1, 1, 1), (6, 111, 1, 1, 2)],
        "request_id long, id_reservacion long, id_servicio long, id_empleado long, cantidad int",
    )
    delta = plans.register_services(hotel, requests, NOW)
    assert dict(rows_of(delta.rejected, "request_id", "motivo_rechazo")) == {
        1: "invalid_quantity", 2: "unknown_service", 3: "service_unavailable", 4: "unknown_booking",
        5: "booking_not_active",
    }
    assert delta.inserts["consumo_servicio"].count() == 2
    line = delta.inserts["detalle_cuenta"].collect()
    assert len(line) == 1 and float(line[0].impuesto) == 576.0 and float(line[0].importe) == 4176.0
    after = hotel.apply(delta)
    assert reconcile.audit(after, "account_totals").count() == 1


def test_set_room_state(spark, seed):
    requests = spark.createDataFrame(
        [(0, T0, 1, "limpieza", 3, None), (1, T0 + dt.timedelta(days=2), 1, "mantenimiento", 4, None),
         (2, T0 + dt.timedelta(days=2, minutes=1), 1, "mantenimiento", 4, None), (3, T0, 2, "rota", 1, None),
         (4, T0, 99, "limpieza", 1, None), (5, T0, 7, "ocupada", 1, 101)],
        "request_id long, arrival timestamp_ntz, id_habitacion long, estado string, id_empleado long,"
        "id_reservacion long",
    )
    delta = plans.set_room_state(seed, requests)
    log = rows_of(delta.inserts["bitacora_habitacion"], "id_habitacion", "estado_anterior", "estado_nuevo", "id_empleado")
    assert sorted(log) == [(1, "disponible", "limpieza", 3), (1, "limpieza", "mantenimiento", 4)]
    assert rows_of(delta.updates["habitacion"], "id_habitacion", "estado") == [(1, "mantenimiento")]
    assert dict(rows_of(delta.rejected, "request_id", "motivo_rechazo")) == {3: "invalid_state", 4: "unknown_room"}


def test_check_in_takes_a_room_once(spark, seed):
    requests = spark.createDataFrame(
        [(0, T0, 111, 1, 1), (1, T0 + dt.timedelta(minutes=1), 112, 1, 1), (2, T0, 113, 1, 7), (3, T0, 114, 1, 99),
         (4, T0, 999, 1, 2), (5, T0, 1, 1, 3)],
        "request_id long, arrival timestamp_ntz, id_reservacion long, id_empleado long, id_habitacion long",
    )
    delta = plans.check_in(seed, requests, NOW)
    assert dict(rows_of(delta.rejected, "request_id", "motivo_rechazo")) == {
        1: "room_not_assignable", 2: "room_not_assignable", 3: "unknown_room", 4: "unknown_booking",
        5: "checkout_not_after_checkin",
    }
    assert rows_of(delta.inserts["estancia"], "id_reservacion", "id_habitacion") == [(111, 1)]
    assert rows_of(delta.updates["habitacion"], "id_habitacion", "estado") == [(1, "ocupada")]


@pytest.fixture
def many_pieces(spark):
    """So few rows would be put into one piece."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_room_with_all_events_of_one_moment(many_pieces):
    spark = many_pieces
    rng = random.Random(12)
    states = ["disponible", "ocupada", None]
    rows = [(i, None if i % 7 == 0 else 1, rng.choice(states), T0 if i % 5 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "request_id long, id_habitacion long, estado string, fecha_hora timestamp_ntz")
    chained = previous_value(df.repartition(6), "id_habitacion", ["fecha_hora", "request_id"], "estado")
    last: dict = {}
    want = {}
    for i, room, state, at in sorted(rows, key=lambda r: (r[3] is not None, r[0])):
        want[i] = last.get(room)
        last[room] = state
    assert dict(rows_of(chained, "request_id", "anterior")) == want
    dealt = df.repartitionByRange("id_habitacion", "fecha_hora", "request_id")
    sizes = [r["count"] for r in dealt.filter("id_habitacion = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2000
    from innsight.plans.rooms import refused_events

    refused = refused_events(df)
    assert refused.count() == sum(r[1] is None or r[3] is None for r in rows)
    assert {r.motivo_rechazo for r in refused.collect()} == {"missing_room", "missing_time"}
    assert plans.room_state_log(df).filter("id_habitacion is null or fecha_hora is null").isEmpty()


def test_previous_value_equals_a_plain_history(spark):
    rng = random.Random(5)
    events = [(i, 1 if i % 3 else rng.randrange(4), rng.choice("abc"), T0 + dt.timedelta(hours=rng.randrange(400)))
              for i in range(300)]
    df = spark.createDataFrame(events, "request_id long, id_habitacion long, estado string, fecha_hora timestamp_ntz")
    got = previous_value(df, "id_habitacion", ["fecha_hora", "request_id"], "estado")
    last, want = {}, {}
    for rid, room, state, when in sorted(events, key=lambda e: (e[3], e[0])):
        want[rid] = last.get(room)
        last[room] = state
    assert dict(rows_of(got, "request_id", "anterior")) == want


def test_levels(spark, seed):
    new = seed.reservacion.filter("id_reservacion <= 40")
    delta = plans.count_bookings(seed, new)
    got = {r.id_huesped_facturador: r for r in delta.updates["cliente_vip"].collect()}
    assert {got[i].nivel_vip for i in range(1, 6)} == {"platino"} and got[1].contador_reservas == 16
    few = seed.reservacion.filter("id_reservacion = 1")
    assert plans.count_bookings(seed, few).updates["cliente_vip"].first().nivel_vip == "plata"
    assert plans.count_bookings(seed, few, legacy_thresholds=True).updates["cliente_vip"].first().nivel_vip == "oro"
    assert plans.count_bookings(seed, few, keep_higher=True).updates["cliente_vip"].first().nivel_vip == "platino"


def test_recompute_vip_enrols_missing_members(spark, seed):
    hotel = seed.replace(cliente_vip=seed.cliente_vip.filter("id_huesped_facturador > 1"))
    delta = plans.recompute_vip(hotel, ANCHOR)
    assert delta.updates["cliente_vip"].count() == 49
    new = delta.inserts["cliente_vip"].collect()
    assert len(new) == 1 and new[0].nivel_vip == "plata" and new[0].contador_reservas == 8
    assert plans.enrol_vip(hotel, hotel.huesped_facturador, ANCHOR).inserts["cliente_vip"].count() == 1


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("v"), (F.col("id") % 7).alias("w"))
    got = rows_of(positions(df, "w", "v"), "w", "v", "lugar")
    assert [(w, v) for w, v, _ in sorted(got, key=lambda r: r[2])] == sorted((w, v) for w, v, _ in got)
    assert sorted(p for *_, p in got) == list(range(500))


def _upgrade_by_hand(hotel, ids):
    """What one call per booking would pick, each against the stored tables."""
    price = dict(rows_of(hotel.categoria_habitacion, "id_categoria", "precio_base"))
    rooms = {r.id_habitacion: r for r in hotel.habitacion.collect()}
    level = dict(rows_of(hotel.cliente_vip, "id_huesped_facturador", "nivel_vip"))
    bookings = {r.id_reservacion: r for r in hotel.reservacion.collect()}
    held = [(r.id_habitacion, bookings[r.id_reservacion]) for r in hotel.reservacion_habitacion.collect()]
    found = {}
    for i in ids:
        mine = bookings[i]
        if level[mine.id_huesped_facturador] not in ("oro", "platino"):
            continue
        current = min(price[rooms[room].id_categoria] for room, b in held if b.id_reservacion == i)
        free = [
            (price[r.id_categoria], r.id_habitacion)
            for r in rooms.values()
            if price[r.id_categoria] > current and r.estado in ("disponible", "limpieza")
            and not any(
                room == r.id_habitacion and b.id_reservacion != i and b.estado not in ("cancelada", "expirada")
                and b.fecha_inicio < mine.fecha_salida and b.fecha_salida > mine.fecha_inicio
                for room, b in held
            )
        ]
        found[i] = min(free)[1] if free else None
    return found


def test_upgrades(spark, seed):
    hotel = seed.replace(cliente_vip=seed.cliente_vip.withColumn("nivel_vip", F.lit("oro")))
    ids = list(range(1, 121))
    requests = followups(spark, ids)
    proposed = plans.propose_upgrades(hotel, requests, probe=2)
    got = dict(rows_of(proposed.filter("motivo_rechazo IS NULL"), "id_reservacion", "id_habitacion_nueva"))
    assert got == _upgrade_by_hand(hotel, ids)
    refused = plans.propose_upgrades(seed, followups(spark, [111, 999]))
    assert dict(rows_of(refused, "id_reservacion", "motivo_rechazo")) == {111: "level_too_low", 999: "not_vip"}

    future = followups(spark, list(range(111, 121)) + [115])
    delta = plans.upgrade(hotel, future)
    after = hotel.apply(delta)
    spans = rows_of(
        after.reservacion_habitacion.join(after.reservacion.drop("subtotal"), "id_reservacion").filter(
            "id_reservacion > 110"
        ),
        "id_habitacion", "fecha_inicio", "fecha_salida",
    )
    for i, a in enumerate(spans):
        assert all(a[0] != b[0] or not overlap(a[1:], b[1:]) for b in spans[i + 1:])
    old = dict(rows_of(hotel.reservacion_habitacion, "id_reservacion", "subtotal"))
    assert all(old[r.id_reservacion] == r.subtotal for r in delta.updates["reservacion_habitacion"].collect())


def _upgrade_in_order(hotel, requests):
    """One call after the other on plain lists: room of each booking afterwards."""
    price = dict(rows_of(hotel.categoria_habitacion, "id_categoria", "precio_base"))
    rooms = [(price[r.id_categoria], r.id_habitacion, r.estado) for r in hotel.habitacion.collect()]
    cost = {room: p for p, room, _ in rooms}
    ladder = sorted((p, room) for p, room, state in rooms if state in ("disponible", "limpieza"))
    levels = dict(rows_of(hotel.cliente_vip, "id_huesped_facturador", "nivel_vip"))
    stays = {r.id_reservacion: r for r in hotel.reservacion.collect()}
    booked: dict = {}
    for r in hotel.reservacion_habitacion.collect():
        booked.setdefault(r.id_reservacion, set()).add(r.id_habitacion)
    moved = {}
    for key in requests:
        stay = stays.get(key)
        if stay is None or key not in booked or levels.get(stay.id_huesped_facturador) not in ("oro", "platino"):
            continue
        least = min(cost[room] for room in booked[key])
        for p, room in ladder:
            busy = any(
                room in booked[other] and other != key and stays[other].estado not in ("cancelada", "expirada")
                and stays[other].fecha_inicio < stay.fecha_salida and stays[other].fecha_salida > stay.fecha_inicio
                for other in booked
            )
            if p > least and not busy:
                booked[key] = {room}
                moved[key] = room
                break
    return moved


@pytest.mark.parametrize("seed_number", [1, 2])
def test_upgrades_equal_one_call_after_the_other(spark, seed, seed_number):
    rng = random.Random(seed_number)
    # few rooms of dearer categories, stays crowded into three months, requests in any order
    start = dt.date(2026, 1, 1)
    ids = list(range(1, 121))
    spans = {i: (start + dt.timedelta(rng.randrange(90)), rng.randrange(1, 25)) for i in ids}
    dates = spark.createDataFrame([(i, a, a + dt.timedelta(n)) for i, (a, n) in spans.items()], "id_reservacion long, _a date, _b date")
    stays = seed.reservacion.join(dates, "id_reservacion").withColumns(
        {"fecha_inicio": F.col("_a"), "fecha_salida": F.col("_b"), "id_huesped_facturador": F.lit(1).cast("long")}
    )
    rooms = seed.habitacion.withColumn("estado", F.when(F.col("id_habitacion") % 3 == 0, "disponible").otherwise("mantenimiento"))
    vips = seed.cliente_vip.filter("id_huesped_facturador = 1").withColumn("nivel_vip", F.lit("oro"))
    hotel = seed.replace(reservacion=stays.select(*seed.reservacion.columns), habitacion=rooms, cliente_vip=vips)
    order = rng.sample(ids, 100)
    arrivals = [(n, start + dt.timedelta(n) if seed_number == 1 else None, key) for n, key in enumerate(order)]
    requests = spark.createDataFrame(arrivals, "request_id long, arrival date, id_reservacion long")
    delta = plans.upgrade(hotel, requests)
    got = dict(rows_of(delta.updates["reservacion_habitacion"], "id_reservacion", "id_habitacion"))
    wanted = _upgrade_in_order(hotel, order)
    assert got == wanted and len(wanted) > 10
    once = plans.propose_upgrades(hotel, requests).filter("id_habitacion_nueva is not null")
    assert dict(rows_of(once, "id_reservacion", "id_habitacion_nueva")) != wanted


def test_requests_of_one_id_and_without(spark, seed):
    rows = [
        (1, dt.datetime(2026, 5, 2), 101, 1), (1, dt.datetime(2026, 5, 1), 102, 1), (1, None, 103, 1),
        (None, dt.datetime(2026, 5, 1), 104, 1), (None, dt.datetime(2026, 5, 1), 105, 1), (2, None, 104, 1),
    ]
    requests = spark.createDataFrame(rows, "request_id long, arrival timestamp_ntz, id_reservacion long, id_empleado long")
    delta = plans.checkout(seed, requests, dt.datetime(2026, 5, 15, 11))
    reasons = sorted((r.request_id or 0, r.motivo_rechazo) for r in delta.rejected.collect())
    assert [r for r in reasons if r[1] in ("duplicate_request", "missing_request_id")] == [
        (0, "missing_request_id"), (0, "missing_request_id"), (1, "duplicate_request"), (1, "duplicate_request"),
    ]
    done = {r.id_reservacion for r in delta.updates["reservacion"].collect()}
    assert done <= {102, 104} and 101 not in done


def test_expiry_and_validators(spark, seed):
    late = seed.replace(reservacion=seed.reservacion.filter("id_reservacion > 110"))
    moved = plans.expire_bookings(late, day(40)).updates["reservacion"]
    assert {r.estado for r in moved.collect()} == {"expirada"}
    assert plans.expire_bookings(seed, ANCHOR).updates["reservacion"].count() == 0
    rows = spark.createDataFrame([(1, 0.0, 1), (2, 1.0, 0), (3, 1.0, 1)], "id long, precio_unitario double, cantidad int")
    good, bad = plans.validate_consumption(rows)
    assert good.count() == 1 and dict(rows_of(bad, "id", "motivo_rechazo")) == {1: "invalid_price", 2: "invalid_quantity"}
    assert plans.validate_consumption(rows, updating=True)[1].count() == 1


def test_dirty_rows_are_found(spark, seed):
    bad = seed.reservacion.withColumn(
        "estado", F.when(F.col("id_reservacion") == 5, "perdida").otherwise(F.col("estado"))
    ).withColumn("fecha_salida", F.when(F.col("id_reservacion") == 6, F.col("fecha_inicio")).otherwise(F.col("fecha_salida")))
    hotel = seed.replace(reservacion=bad.unionByName(bad.filter("id_reservacion = 7")))
    broken = {(r.tabla, r.regla): r.filas for r in quality.row_rules(hotel, "regla").filter("filas > 0").collect()}
    assert broken == {("reservacion", "estado"): 1, ("reservacion", "fechas"): 1}
    keys = quality.primary_keys(hotel).filter("claves_repetidas > 0").collect()
    assert [(r.tabla, r.claves_repetidas, r.filas_repetidas) for r in keys] == [("reservacion", 1, 2)]
    named = {r.id_reservacion: r.reglas_rotas for r in quality.violating_rows(hotel, "reservacion").collect()}
    assert named == {5: ["regla:estado"], 6: ["regla:fechas"]}
    orphaned = seed.replace(huesped=seed.huesped.filter("id_huesped <> 1"))
    lost = {(r.tabla, r.columna): r.filas_huerfanas
            for r in quality.foreign_keys(orphaned).filter("filas_huerfanas > 0").collect()}
    assert lost[("reservacion", "id_huesped")] == 12 and ("huesped_facturador", "id_huesped") in lost


def test_cascade_delete(spark, seed):
    keys = spark.createDataFrame([(111,), (1,), (999,)], "id_reservacion long")
    gone = quality.cascade_delete(seed, "reservacion", keys)
    assert rows_of(gone.rejected, "id_reservacion", "motivo") == [(1, "still_referenced")]
    assert rows_of(gone.deleted["reservacion"], "id_reservacion") == [(111,)]
    assert rows_of(gone.deleted["reservacion_habitacion"], "id_reservacion_habitacion") == [(111,)]
    after = gone.remaining(seed)
    assert after.reservacion.count() == 119 and after.reservacion_habitacion.count() == 119

    # an employee only complaints, surveys and the log refer to: references are cleared, rows stay
    free = seed.replace(
        estancia=seed.estancia.filter("id_empleado <> 1"),
        factura=seed.factura.filter("id_empleado <> 1"),
        bono_empleado=seed.bono_empleado.filter("id_empleado <> 1"),
        consumo_servicio=seed.consumo_servicio.filter("id_empleado <> 1"),
    )
    gone = quality.cascade_delete(free, "empleado", spark.createDataFrame([(1,)], "id_empleado long"))
    assert gone.rejected.count() == 0
    after = gone.remaining(free)
    for table in ("queja", "satisfaccion", "bitacora_habitacion"):
        before = free.table(table).filter("id_empleado = 1").count()
        assert before > 0 and gone.cleared[table].count() == before
        assert after.table(table).filter("id_empleado = 1").count() == 0
        assert after.table(table).count() == free.table(table).count()


def test_batches_survive_a_larger_hotel(spark):
    """Blocks do not touch each other: a batch over three blocks is three times the batch over one."""
    hotel = generate(spark, scale=3)
    offset = [b * 120 + i for b in range(3) for i in (101, 111)]
    assert plans.cancel(hotel, followups(spark, offset), NOW).inserts["cancelacion"].count() == 6


def test_outsized_amounts_refuse_their_own_request(spark, seed):
    dear = seed.habitacion.withColumn(
        "precio", F.when(F.col("id_habitacion") == 1, F.lit("9999999999.99").cast("decimal(12,2)")).otherwise(F.col("precio"))
    )
    hotel = seed.replace(habitacion=dear)
    far = [day(200), day(203)]
    delta = plans.book(hotel, booking_requests(spark, [(1, 1, *far, "internet"), (2, 2, *far, "internet")]))
    assert rows_of(delta.rejected, "request_id", "motivo_rechazo") == [(0, "amount_too_large")]
    assert rows_of(delta.inserts["reservacion"], "id_huesped") == [(2,)]
    orders = spark.createDataFrame(
        [(0, 101, 1, 1, 2**31 - 1), (1, 101, 1, 1, 10**8), (2, 101, 1, 1, 3)],
        "request_id long, id_reservacion long, id_servicio long, id_empleado long, cantidad int",
    )
    served = plans.register_services(hotel, orders, NOW)
    assert sorted(rows_of(served.rejected, "request_id", "motivo_rechazo")) == [
        (0, "amount_too_large"), (1, "amount_too_large"),
    ]
    assert rows_of(served.inserts["consumo_servicio"], "cantidad") == [(3,)]
    assert served.inserts["detalle_cuenta"].count() == 1


def test_keys_of_every_type_and_missing_ones(spark, seed):
    """Text keys, keys of two columns and integer keys, each with a repeat and a NULL."""
    guest, pair = seed.usuario, seed.detalle_paquete_promocional
    one, two = guest.first(), pair.first()
    hotel = seed.replace(
        usuario=guest.unionByName(guest.filter(F.col("id_usuario") == one.id_usuario))
        .unionByName(guest.limit(1).withColumn("id_usuario", F.lit(None).cast("long")).withColumn("email", F.lit(None).cast("string"))),
        detalle_paquete_promocional=pair.unionByName(
            pair.filter(F.col(pair.columns[0]) == two[0]).withColumn(pair.columns[0], F.lit(-1).cast("long"))
        ),
    )
    primary = {r.tabla: r for r in quality.primary_keys(hotel).collect()}
    assert (primary["usuario"].claves_repetidas, primary["usuario"].filas_repetidas, primary["usuario"].filas_nulas) == (1, 2, 1)
    assert primary["detalle_paquete_promocional"].claves_repetidas == 0
    unique = {(r.tabla, r.columnas): (r.claves_repetidas, r.filas_repetidas, r.filas_nulas)
              for r in quality.unique_keys(hotel).collect()}
    assert unique["usuario", "email"] == (1, 2, 0)
    assert unique["detalle_paquete_promocional", "id_paquete_promocional, id_servicio"] == (1, 2, 0)
    empty = seed.replace(usuario=guest.limit(0))
    assert {r.claves_repetidas for r in quality.primary_keys(empty).filter("tabla = 'usuario'").collect()} == {0}


def test_each_reference_counts_its_own_orphans(spark, seed):
    """Several columns refer to one parent; NULL is no orphan, a repeated parent no second one."""
    staff = seed.empleado.filter("id_empleado <> 1")
    hotel = seed.replace(empleado=staff.unionByName(staff))
    found = {(r.tabla, r.columna): (r.claves_huerfanas, r.filas_huerfanas)
             for r in quality.foreign_keys(hotel).filter("padre = 'empleado'").collect()}
    assert len(found) == 7
    for (table, column), counted in found.items():
        lost = hotel.table(table).filter(f"{column} = 1").count()
        assert counted == (int(lost > 0), lost)


def test_audit_of_changes_without_booking_or_employee(spark, seed):
    log = seed.bitacora_habitacion
    nobody = log.withColumns({
        "id_empleado": F.when(F.col("id_bitacora") % 3 == 0, F.col("id_empleado")),
        "id_reservacion": F.when(F.col("id_bitacora") % 2 == 0, F.col("id_reservacion")),
    })
    hotel = seed.replace(bitacora_habitacion=nobody)
    people = {r.id_empleado: f"{r.nombres} {r.apellidos}" for r in seed.empleado.collect()}
    costs = {r.id_reservacion: r.total for r in seed.reservacion.collect()}
    asked = {r.id_bitacora: r for r in nobody.collect()}
    audit = occupancy.room_audit(hotel).collect()
    assert len(audit) == len(asked) == log.count()
    for row in audit:
        change = asked[row.id_bitacora]
        assert (row.empleado, row.costo_reserva) == (people.get(change.id_empleado), costs.get(change.id_reservacion))
    one = occupancy.room_audit(hotel, 1).collect()
    assert [r.cambio for r in one] == sorted((r.cambio for r in one), reverse=True)


def test_bookings_held_by_invoices_alone(spark, seed):
    """An invoice holds its booking below the account that a delete would take along; a key asked for twice is refused once."""
    free = seed.replace(**{t: seed.table(t).limit(0) for t in ("estancia", "cancelacion", "consumo_servicio", "queja", "satisfaccion")})
    billed = seed.factura.join(seed.cuenta.select("id_cuenta", "id_reservacion"), "id_cuenta").select("id_reservacion").distinct()
    asked = seed.reservacion.select("id_reservacion")
    gone = quality.cascade_delete(free, "reservacion", asked.unionByName(asked))
    held = sorted(rows_of(billed, "id_reservacion"))
    assert held and sorted(rows_of(gone.rejected, "id_reservacion")) == held
    assert gone.deleted["reservacion"].count() == asked.count() - len(held)
