import pytest
from pyspark.sql import functions as F

from tests.hand import EXPECTED, EXPENSE_ROWS, SALE_ROWS, at, frames, shape
from turnstile.plans.results import RESULTS, city_highest_sales_per_event, city_sales_per_event, compute
from turnstile.plans.tables import highest_profit_table, table_view


@pytest.mark.parametrize("name", RESULTS)
def test_hand_case(spark, name):
    rows = compute(name, *frames(spark)).collect()
    assert shape(name, rows) == pytest.approx(EXPECTED[name])


@pytest.mark.parametrize("name", RESULTS)
def test_empty_input_gives_no_rows(spark, name):
    assert compute(name, *frames(spark, [], [])).collect() == []


def test_unknown_result_is_named(spark):
    with pytest.raises(KeyError, match="no_such"):
        compute("no_such")


def test_windowed_keys_carry_the_start_in_milliseconds(spark):
    rows = compute("revenue_per_minute", frames(spark)[0]).collect()
    assert {r.key for r in rows} == {
        f"TOTAL_REVENUE_WINDOWED_{int(at(t).timestamp() * 1000)}" for t in ("00:00:00", "00:01:00", "00:02:00")}


@pytest.mark.parametrize("name, expected", [
    ("average_sale_per_event", {"AVG_PER_EVENT": 90}),
    ("revenue_per_minute", {"TOTAL_REVENUE_WINDOWED": 210}),
    ("expenses_per_minute", {"TOTAL_EXPENSES_WINDOWED": 70}),
    ("profit_per_minute", {"TOTAL_PROFIT_WINDOWED": -90}),
    ("revenue_per_event", {"E1": 260, "E2": 396, "E3": 90}),
])
def test_table_view_is_the_last_writer(spark, name, expected):
    assert {r.id: r.value for r in table_view(compute(name, *frames(spark))).collect()} == expected


def test_highest_profit_table_keeps_the_first_update(spark):
    rows = highest_profit_table(*frames(spark)).collect()
    assert {(r.id, r.eventName, r.value) for r in rows} == {
        ("E1", "Tech", 20.0), ("HIGHEST_PROFIT_EVENT", "Rock", 336.0)}
    only = highest_profit_table(*frames(spark, SALE_ROWS[:1], EXPENSE_ROWS[:1])).collect()
    assert [(r.id, r.value) for r in only] == [("E1", 20.0)]


def test_city_sales(spark):
    rows = city_sales_per_event(frames(spark)[0]).collect()
    assert {(r.id, r.eventName): r.value for r in rows} == {
        ("E1", "Aveiro"): 120, ("E1", "Lisboa"): 140, ("E1", "Braga"): 120, ("E2", "Porto"): 396, ("E3", "Lisboa"): 90}


def test_strict_city_key_is_cut_at_the_first_bar(spark):
    rows = [("E1|X", at("00:00:01"), 1, "S", "E1|X", "n", "Porto", "c", "t", 5.0, 1)]
    out = city_highest_sales_per_event(frames(spark, rows, [])[0], strict=True).collect()
    assert [(r.key, r.id, r.eventName) for r in out] == [("E1", "E1|X", "Porto")]
    out = city_highest_sales_per_event(frames(spark, rows, [])[0]).collect()
    assert [(r.key, r.id) for r in out] == [("E1|X", "E1|X")]


def test_total_equals_sum_of_events_when_every_key_is_set(spark):
    sales = frames(spark, [r for r in SALE_ROWS if r[0]], [])[0]
    total = compute("total_revenue", sales).first().value
    assert total == pytest.approx(compute("revenue_per_event", sales).agg(F.sum("value")).first()[0])


def test_folds_stay_hash_aggregates_over_raw_rows(spark):
    plan = compute("total_profit", *frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
    plan = compute("revenue_per_event", frames(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(amount" in plan.split("SortAggregate")[-1]  # only the pre-folded rows are ever sorted
