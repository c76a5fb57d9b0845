"""Streams over several files against their batch twins."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from innsight import plans, streaming
from innsight.streaming import RoomLog

T0 = dt.datetime(2026, 1, 1)
EVENTS = "request_id long, id_habitacion long, estado string, fecha_hora timestamp_ntz"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write_files(spark, parts, schema, folder):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def test_room_log_with_disorder_over_many_batches(spark, tmp_path):
    """Events shuffled by less than the delay come out as if they had been in order."""
    rng = random.Random(3)
    events = [(i, 1 if i % 3 else rng.randrange(5), rng.choice(["disponible", "ocupada", "limpieza"]),
               T0 + dt.timedelta(minutes=10 * i)) for i in range(240)]
    arrival = sorted(events, key=lambda e: e[3] + dt.timedelta(minutes=rng.randrange(50)))
    parts = [arrival[i:i + 60] for i in range(0, 240, 60)]
    log = RoomLog(spark, str(tmp_path / "log"))
    for i, part in enumerate(parts):
        write_files(spark, [part], EVENTS, str(tmp_path / f"in/{i}"))
        stream = streaming.file_stream(spark, str(tmp_path / "in/*/*"), "*.parquet", spark.createDataFrame(part, EVENTS).schema)
        log.run(stream)
    closed = max(e[3] for e in events) - dt.timedelta(hours=1)
    whole = spark.createDataFrame([e for e in events if e[3] <= closed], EVENTS)
    assert log.late().count() == 0
    assert log.pending().count() == sum(e[3] > closed for e in events)
    assert rows(log.log()) == rows(plans.room_state_log(whole))
    assert rows(log.closed_log()) == rows(plans.room_state_log(spark.createDataFrame(events, EVENTS)))


def test_room_log_sets_late_events_aside(spark, tmp_path):
    schema = spark.createDataFrame([], EVENTS).schema
    log = RoomLog(spark, str(tmp_path / "log"))
    first = [(1, 1, "ocupada", T0), (2, 1, "limpieza", T0 + dt.timedelta(hours=5))]
    second = [(3, 1, "disponible", T0 + dt.timedelta(hours=1)), (4, 1, "ocupada", T0 + dt.timedelta(hours=9))]
    for i, part in enumerate([first, second]):
        write_files(spark, [part], EVENTS, str(tmp_path / f"in/{i}"))
        log.run(streaming.file_stream(spark, str(tmp_path / "in/*/*"), "*.parquet", schema))
    assert [r.request_id for r in log.late().collect()] == [3]
    assert rows(log.log()) == [(2, 1, "ocupada", "limpieza", T0 + dt.timedelta(hours=5))]


def test_counters_over_many_batches(spark, seed, tmp_path):
    folder = str(tmp_path / "in")
    seed.reservacion.repartition(5).write.parquet(folder)
    stream = streaming.file_stream(spark, folder, "*.parquet", seed.reservacion.schema, per_trigger=1)
    streaming.run_booking_counters(stream, str(tmp_path / "out"))
    got = streaming.booking_counters(spark, str(tmp_path / "out"))
    want = plans.vip.booking_increments(seed.reservacion)
    assert rows(got.select("id_huesped_facturador", "contador_reservas", "puntos_acumulados")) == rows(
        want.select("id_huesped_facturador", "nuevas", "puntos")
    )


def test_validator_keeps_every_row_once(spark, seed, tmp_path):
    folder = str(tmp_path / "in")
    bad = seed.consumo_servicio.withColumn("cantidad", F.when(F.col("id_consumo") % 4 == 0, 0).otherwise(F.col("cantidad")))
    bad.repartition(3).write.parquet(folder)
    stream = streaming.file_stream(spark, folder, "*.parquet", bad.schema, per_trigger=1)
    streaming.run_consumption_validator(stream, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/validos")).count() == 90
    refused = spark.read.parquet(str(tmp_path / "out/rechazados"))
    assert refused.count() == 30 and {r.motivo_rechazo for r in refused.collect()} == {"invalid_quantity"}


def test_windows_match_a_batch_aggregation(spark, seed, tmp_path):
    folder = str(tmp_path / "in")
    seed.consumo_servicio.orderBy("fecha_hora").coalesce(1).write.parquet(folder)
    stream = streaming.file_stream(spark, folder, "*.parquet", seed.consumo_servicio.schema)
    streaming.run_consumption_windows(stream, str(tmp_path / "out"), "7 days")
    got = streaming.consumption_windows(spark, str(tmp_path / "out"))
    assert rows(got) == rows(streaming.consumption_by_service_window(seed.consumo_servicio, "7 days"))


def test_state_follows_what_changed(spark, tmp_path):
    """Nine batches, whole states every four: readers see the newest rows, old places go, a replay changes nothing."""
    kept = streaming.LatestRows(spark, str(tmp_path / "estado"), ["k"], "k long, v string", every=4)
    assert kept.read().count() == 0
    state: dict = {}
    for batch in range(9):
        changed = {k: f"{batch}-{k}" for k in range(batch % 3, 300 if batch == 0 else 3)}
        state |= changed
        for _ in range(2 if batch == 4 else 1):
            kept.write(spark.createDataFrame(list(changed.items()), "k long, v string"), batch)
        assert dict(rows(kept.read())) == state
    assert kept._there() == [4, 5, 6, 7, 8]
    assert dict(rows(kept.read(7)))[299] == "0-299"
    assert spark.read.parquet(str(tmp_path / "estado/lote=7")).count() == 2
    assert spark.read.parquet(str(tmp_path / "estado/lote=8")).count() == 300
