"""Properties of the physical plans, taken with broadcasting off as over large tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from innsight.catalog import queries
from innsight.operators import billing, bookings, occupancy, quality, services
from innsight.params import Params
from innsight.sources import fixture
from innsight.sources.fixture import fixture_hotel
from innsight.sources.generator import ANCHOR
from tests.conftest import SF_SMALL

P = Params(ANCHOR)
PLANNED = [n for n in queries() if not n.startswith("s")]


@pytest.fixture
def large(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", [n for n in PLANNED if n[0] in "qrv" or n.startswith(("t_", "dq"))])
def test_no_pairing_of_rows_and_no_python(large, name):
    plan = plan_of(queries()[name](large, SF_SMALL))
    for bad in ("NestedLoop", "CartesianProduct", "Python", "Pandas", "BroadcastHashJoin"):
        assert bad not in plan, bad


def test_dates_and_columns_reach_the_scan(seed):
    plan = details_of(occupancy.monthly_occupancy(seed, P))
    assert "GreaterThanOrEqual(fecha_hora_checkin" in plan and "LessThan(fecha_hora_checkin" in plan
    assert "id_empleado" not in plan
    for df, column in (
        (billing.payments_by_status(seed, P), "fecha_pago"),
        (services.top_services(seed, P), "fecha_hora"),
        (bookings.cancellations(seed, P), "fecha_cancelacion"),
        (billing.monthly_income(seed, 2026, 4), "fecha_emision"),
    ):
        assert f"GreaterThanOrEqual({column}" in details_of(df)


def test_best_of_group_is_cut_before_the_shuffle(large, seed):
    plan = plan_of(occupancy.longest_stay_per_category(seed, P))
    assert len(re.findall("WindowGroupLimit", plan)) >= 2


def test_limits_are_taken_per_task(large, seed):
    assert "TakeOrderedAndProject" in plan_of(services.vip_top_services(seed))


def test_countries_without_case_and_accents(spark, seed):
    spelled = seed.huesped.withColumn(
        "pais_origen", F.when(F.col("id_huesped") <= 5, "CANCÚN").when(F.col("id_huesped") <= 10, "Cancun").otherwise("x")
    )
    hotel = seed.replace(huesped=spelled)
    assert {r.reservas for r in bookings.bookings_by_country(hotel).collect()} == {60, 10, 50}
    folded = bookings.bookings_by_country(hotel, ci_ai=True)
    assert {r.reservas for r in folded.collect()} == {70, 50}
    assert bookings.repeat_cancellers(seed, ci_ai=True).count() == 20


def test_references_meet_in_one_shuffle(large, seed):
    """Held values and parent keys share one exchange; the only join is with the list of references."""
    plan = plan_of(quality.foreign_keys(seed))
    assert len(re.findall(r"Exchange hashpartitioning\(padre#\d+, valor#", plan)) == 1
    assert re.findall(r"(\w+Join\w*) \[(\w+)#", plan) == [("SortMergeJoin", "codigo")]


def test_integer_keys_stay_integers(large, seed):
    plan = plan_of(quality.primary_keys(seed))
    assert "as string" not in plan
    assert re.search(r"Exchange hashpartitioning\(restriccion#\d+, valor#\d+L", plan)


def test_missing_keys_are_dealt_over_tasks(large, seed):
    plan = plan_of(occupancy.room_audit(seed))
    assert "Exchange rangepartitioning" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(_llave#", plan)) == 4
    assert not re.findall(r"Exchange hashpartitioning\(id_(?:reservacion|empleado)#", plan)


def test_consumption_is_condensed_per_service_only(large, seed):
    """No task holds an entry per booking and service."""
    plan = plan_of(services.vip_top_services(seed))
    assert re.search(r"HashAggregate\(keys=\[id_servicio#\d+L\], functions=\[partial_count", plan)
    assert not re.search(r"HashAggregate\(keys=\[id_reservacion#\d+L, id_servicio", plan)


def test_held_values_meet_the_keys_in_one_join(large, seed):
    """Restricting references are put together first: five joins of one task's partitions would all be that task's memory."""
    plan = plan_of(quality._blocked(seed, "reservacion", seed.reservacion.select("id_reservacion")))
    assert len(re.findall(r"SortMergeJoin \[valor#\d+L\]", plan)) <= 3


def test_stays_are_found_in_tasks_of_bounded_size(large, monkeypatch):
    """Bare keys compress so well that a size in bytes puts millions of rows into one task."""
    whole = sorted(fixture_hotel(large, SF_SMALL).estancia.collect())
    monkeypatch.setattr(fixture, "LINES_PER_TASK", 1000)
    stays = fixture_hotel(large, SF_SMALL).estancia
    tasks = large.read.parquet(f"{SF_SMALL}/lineitem.parquet").count() // 1000 + 1
    assert tasks > 4
    assert len(re.findall(rf"Exchange hashpartitioning\(id_reservacion#\d+L, {tasks}\), REPARTITION_BY_NUM", plan_of(stays))) == 2
    assert sorted(stays.collect()) == whole


def test_line_items_are_shuffled_once_for_account_details(large):
    """They were shuffled to their bookings and, with the rooms, once more to the accounts."""
    hotel = fixture_hotel(large, SF_SMALL)
    plan = hotel.detalle_cuenta._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Union")]


def test_digests_do_not_travel_for_null_counts(large):
    hotel = fixture_hotel(large, SF_SMALL)
    plan = hotel.consumo_servicio.selectExpr("count_if(id_consumo IS NULL) AS n")._jdf.queryExecution()
    assert "md5" in hotel.consumo_servicio._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan.optimizedPlan().toString()
