"""Stored hotels: declared schemas, atomic commits, appends and keyed updates."""

from __future__ import annotations

import datetime as dt
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from innsight import Delta, plans
from innsight.params import Params, Window, add_months
from innsight.schemas import TABLES
from innsight.sources import store
from innsight.sources.store import (
    CommitConflict,
    append,
    commit,
    insert_if_absent,
    read_hotel,
    read_table,
    upsert,
    write_hotel,
)


def test_constraint_inventory():
    assert len(TABLES) == 25
    assert sum(len(t.checks) for t in TABLES.values()) == 38
    assert sum(len(t.references) for t in TABLES.values()) == 37
    assert sum(len(t.unique) for t in TABLES.values()) == 11
    kinds = [r.on_delete for t in TABLES.values() for r in t.references]
    assert (kinds.count("cascade"), kinds.count("set_null"), kinds.count("restrict")) == (6, 4, 27)


def test_month_arithmetic_clamps():
    assert add_months(dt.date(2024, 3, 31), -1) == dt.date(2024, 2, 29)
    assert add_months(dt.date(2024, 2, 29), -12) == dt.date(2023, 2, 28)
    p = Params(dt.date(2026, 5, 15))
    assert p.last_month == Window(dt.date(2026, 4, 15), dt.date(2026, 5, 16))
    assert p.last_year == Window(dt.date(2025, 5, 15), dt.date(2026, 5, 16))


def test_stored_types(seed):
    for name in seed.names():
        got = {f.name: f.dataType for f in seed.table(name).schema}
        assert got == {f.name: f.dataType for f in TABLES[name].struct}, name


def test_commit(spark, seed, tmp_path):
    root = str(tmp_path)
    write_hotel(seed, root)
    hotel = read_hotel(spark, root)
    requests = spark.createDataFrame(
        [(1, dt.datetime(2026, 5, 1), 101, 1)],
        "request_id long, arrival timestamp_ntz, id_reservacion long, id_empleado long",
    )
    delta = plans.checkout(hotel, requests, dt.datetime(2026, 5, 15, 11))
    after = commit(hotel, delta, root)
    assert after.factura.count() == 51 and after.pago.count() == 51 and after.bitacora_habitacion.count() == 111
    assert after.reservacion.count() == 120
    assert after.reservacion.filter("id_reservacion = 101").first().estado == "completada"
    # an uncommitted reader still sees its own version; a new one sees the commit
    assert hotel.factura.count() == 50 and read_hotel(spark, root).factura.count() == 51
    commit(after, Delta(inserts={"factura": delta.inserts["factura"].withColumn("id_factura", F.lit(9999).cast("long"))}), root)
    assert read_hotel(spark, root).factura.count() == 52
    # a retry adds nothing, and a commit from an old reader keeps what others stored
    commit(hotel, delta, root)
    assert read_hotel(spark, root).factura.count() == 52
    room = hotel.habitacion.filter("id_habitacion = 50").withColumn("estado", F.lit("mantenimiento"))
    other = hotel.habitacion.filter("id_habitacion = 49").withColumn("estado", F.lit("bloqueada"))
    commit(hotel, Delta(updates={"habitacion": room}), root)
    last = commit(hotel, Delta(updates={"habitacion": other}), root)
    states = {r.id_habitacion: r.estado for r in last.habitacion.filter("id_habitacion >= 49").collect()}
    assert states[50] == "mantenimiento" and states[49] == "bloqueada"


def test_keyed_writes(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    delta = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in upsert(base, delta, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in insert_if_absent(base, delta, "k").collect()} == {(3, "d")}
    append(base, str(tmp_path / "t"))
    append(delta, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    twice = spark.createDataFrame([(4, "y"), (4, "x"), (1, "z")], "k long, v string")
    assert [tuple(r) for r in insert_if_absent(base, twice, "k").collect()] == [(4, "x")]


def _state(hotel, room, state):
    rows = hotel.habitacion.filter(F.col("id_habitacion") == room).withColumn("estado", F.lit(state))
    return Delta(updates={"habitacion": rows})


def test_two_writers(spark, seed, tmp_path):
    root = str(tmp_path)
    write_hotel(seed, root)
    with pytest.raises(CommitConflict):
        write_hotel(seed, root)
    one, two = read_hotel(spark, root), read_hotel(spark, root)
    assert commit(one, _state(one, 1, "limpieza"), root).version == 1
    # another row: put on top; the same row: refused, and nothing changes
    assert commit(two, _state(two, 2, "limpieza"), root).version == 2
    with pytest.raises(CommitConflict):
        commit(two, _state(two, 1, "mantenimiento"), root)
    last = read_hotel(spark, root)
    assert last.version == 2
    states = {r.id_habitacion: r.estado for r in last.habitacion.filter("id_habitacion <= 2").collect()}
    assert states == {1: "limpieza", 2: "limpieza"}
    assert read_hotel(spark, root, 0).habitacion.filter("id_habitacion = 1").first().estado != "limpieza"


def test_writers_that_publish_at_the_same_moment(spark, seed, tmp_path, monkeypatch):
    root = str(tmp_path)
    write_hotel(seed, root)
    hotel, publish, between = read_hotel(spark, root), store._publish, []

    def late(*args):
        if not between:
            between.append(None)
            commit(read_hotel(spark, root), _state(hotel, 3, "limpieza"), root)
        return publish(*args)

    monkeypatch.setattr(store, "_publish", late)
    after = commit(hotel, _state(hotel, 4, "limpieza"), root)
    states = {r.id_habitacion: r.estado for r in after.habitacion.filter("id_habitacion in (3, 4)").collect()}
    assert after.version == 2 and states == {3: "limpieza", 4: "limpieza"}


def test_crash_before_publishing(spark, seed, tmp_path, monkeypatch):
    root = str(tmp_path)
    write_hotel(seed, root)
    hotel = read_hotel(spark, root)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "_publish", crash)
        with pytest.raises(KeyboardInterrupt):
            commit(hotel, _state(hotel, 5, "limpieza"), root)
    again = read_hotel(spark, root)
    assert again.version == 0 and again.habitacion.filter("id_habitacion = 5").first().estado != "limpieza"
    assert again.habitacion.count() == seed.habitacion.count()
    assert commit(again, _state(again, 5, "limpieza"), root).version == 1


def _files(root, table):
    return {str(p) for p in pathlib.Path(root, table).rglob("*.parquet")}


def test_an_update_rewrites_its_months_only(spark, seed, tmp_path):
    root = str(tmp_path)
    write_hotel(seed, root)
    hotel = read_hotel(spark, root)
    before = _files(root, "reservacion")
    day = hotel.reservacion.agg(F.max("fecha_inicio")).first()[0]
    rows = hotel.reservacion.filter(F.col("fecha_inicio") == F.lit(day)).withColumn("estado", F.lit("expirada"))
    after = commit(hotel, Delta(updates={"reservacion": rows}), root)
    fresh = _files(root, "reservacion") - before
    assert {re.search("mes=([0-9]+)", p)[1] for p in fresh} == {f"{day:%Y%m}"}
    read = {p.removeprefix("file://") for p in after.reservacion.inputFiles()}
    assert read - fresh == {p for p in before if f"mes={day:%Y%m}" not in p}
    assert after.reservacion.count() == hotel.reservacion.count()
    # a changed date moves the row to another month
    moved = rows.withColumn("fecha_inicio", F.add_months("fecha_inicio", 1)).withColumn("fecha_salida", F.add_months("fecha_salida", 1))
    last = commit(after, Delta(updates={"reservacion": moved}), root)
    assert last.reservacion.count() == hotel.reservacion.count()
    assert last.reservacion.filter(F.col("fecha_inicio") == F.lit(day)).isEmpty()


def test_months_outside_are_not_read(spark, seed, tmp_path):
    root = str(tmp_path)
    write_hotel(seed, root)
    start, end = dt.date(2026, 3, 10), dt.date(2026, 5, 1)
    rows = read_table(spark, root, "reservacion", start, end)
    wanted = seed.reservacion.filter(F.col("fecha_inicio").between(F.lit(start), F.lit(dt.date(2026, 4, 30))))
    assert sorted(rows.drop("mes").collect()) == sorted(wanted.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan
    read = rows._jdf.queryExecution().executedPlan()
    assert rows.count() == wanted.count() and "PushedFilters: [IsNotNull(fecha_inicio)" in plan and read is not None
    some = spark.range(1).select(F.lit(202604).alias("mes"), F.lit("x").alias("nombre")).filter("nombre = 'x'")
    joined = read_table(spark, root, "reservacion").join(F.broadcast(some), "mes")
    assert joined.count() == seed.reservacion.filter("date_format(fecha_inicio, 'yyyyMM') = '202604'").count()


def test_rows_without_a_date(spark, seed, tmp_path):
    root = str(tmp_path)
    rows = seed.reservacion.withColumn("fecha_inicio", F.when(F.col("id_reservacion") > 3, F.col("fecha_inicio")))
    write_hotel(seed.replace(reservacion=rows, pago=seed.pago.limit(0)), root)
    hotel = read_hotel(spark, root)
    assert hotel.reservacion.filter("fecha_inicio is null").count() == 3 and hotel.pago.count() == 0
    assert hotel.reservacion.schema.names == seed.reservacion.schema.names
