"""High-water operator against brute force, with slots and slices small enough to matter."""

import random
from datetime import timedelta

import pytest

from tests.hand import at, frames
from turnstile.operators import highwater
from turnstile.plans.results import city_highest_sales_per_event, highest_profit_event
from turnstile.streaming import highwater as streamed


def records(seed, n, events=3, cities=3, refunds=False):
    rnd = random.Random(seed)
    sales, expenses = [], []
    for seq in range(n):
        ts = at("00:00:00") + timedelta(seconds=seq // 3 * rnd.choice([1, 1, 600]) + seq * 40)
        e = f"E{rnd.randrange(events)}" if rnd.random() > 0.3 else "E0"
        if rnd.random() < 0.6:
            price = float(rnd.choice([-2, -1, 0, 1, 2, 3] if refunds else [0, 1, 2, 3]))
            sales.append((e, ts, seq, f"S{seq}", e, f"N{seq}", f"C{rnd.randrange(cities)}", "c", "t", price, 1))
        else:
            expenses.append((e, ts, seq, f"X{seq}", e, "n", "venue", float(rnd.choice([0, 1, 2, 4]))))
    return sales, expenses


def order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2]))


def brute_profit(sales, expenses):
    earned, spent, name, best = {}, {}, {}, None
    for r in order(sales + expenses):
        if len(r) == 11:
            earned[r[0]] = earned.get(r[0], 0) + r[9] * r[10]
            name.setdefault(r[0], r[5])
        else:
            spent[r[0]] = spent.get(r[0], 0) + r[7]
        if r[0] in earned and r[0] in spent:
            value = earned[r[0]] - spent[r[0]]
            if best is None or value > best[1]:
                best = (name[r[0]], value)
    return best


def brute_city(sales):
    total, best = {}, {}
    for r in order(sales):
        key = (r[4], r[6])
        total[key] = total.get(key, 0) + r[9] * r[10]
        if r[4] not in best or total[key] > best[r[4]][1]:
            best[r[4]] = (r[6], total[key])
    return best


@pytest.mark.parametrize("seed, slot, limit", [(1, 60, 50_000), (2, 3_600, 50_000), (3, 10 ** 8, 0), (4, 10 ** 8, 50_000)])
def test_matches_brute_force(spark, monkeypatch, seed, slot, limit):
    monkeypatch.setattr(highwater, "PROFIT_SLOT", slot)
    monkeypatch.setattr(highwater, "CITY_SLOT", slot)
    monkeypatch.setattr(highwater, "BROADCAST_ROWS", limit)
    sales, expenses = records(seed, 200, refunds=seed % 2 == 1)
    s, e = frames(spark, sales, expenses)
    got = highest_profit_event(s, e).collect()
    assert [(r.eventName, r.value) for r in got] == [brute_profit(sales, expenses)]
    got = city_highest_sales_per_event(s).collect()
    assert {r.key: (r.eventName, r.value) for r in got} == brute_city(sales)


def test_one_event_holding_everything_in_one_slot_is_sliced(spark, monkeypatch):
    """A single hot cell: its entries spread over several range slices and still add up."""
    sales, expenses = records(9, 400, events=1, cities=1, refunds=True)
    monkeypatch.setattr(highwater, "PROFIT_SLOT", 10 ** 8)
    s, e = frames(spark, sales, expenses)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = highest_profit_event(s, e).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r.eventName, r.value) for r in got] == [brute_profit(sales, expenses)]


def test_ties_keep_the_earlier(spark):
    rows = [("E1", at("00:00:01"), 1, "S", "E1", "n", "Porto", "c", "t", 5.0, 2),
            ("E1", at("00:00:02"), 2, "S", "E1", "n", "Braga", "c", "t", 10.0, 1),
            ("E1", at("00:00:03"), 3, "S", "E1", "n", "Porto", "c", "t", 0.0, 1)]
    assert [r.eventName for r in city_highest_sales_per_event(frames(spark, rows, [])[0]).collect()] == ["Porto"]


def test_one_sided_events_have_no_profit(spark):
    sales, expenses = records(5, 40)
    assert highest_profit_event(*frames(spark, sales, [])).collect() == []
    assert highest_profit_event(*frames(spark, [], expenses)).collect() == []


def test_amounts_finer_than_the_reported_decimals(spark, monkeypatch):
    """The peak is chosen on exact amounts: 0.0002 + 1.0001 + 0.0003, with an expense between and one at the end."""
    monkeypatch.setattr(highwater, "PROFIT_SLOT", 3_600)
    sale = lambda seq, hour, price: ("E1", at(f"{hour:02}:00:00") + timedelta(seconds=seq), seq, f"S{seq}", "E1", "N", "C", "c", "t", price, 1)
    cost = lambda seq, hour, amount: ("E1", at(f"{hour:02}:00:00") + timedelta(seconds=seq), seq, f"X{seq}", "E1", "N", "v", amount)
    s, e = frames(spark, [sale(1, 0, 0.0002), sale(3, 7, 1.0001), sale(4, 7, 0.0003)], [cost(2, 0, 0.0), cost(5, 7, 0.5)])
    assert [r.value for r in highest_profit_event(s, e).collect()] == [1.0006]


def test_totals_of_any_size(spark):
    """Above 10^13 a thousandth is below the spacing of doubles."""
    sales = [("E0", at("00:00:00") + timedelta(seconds=k), k, f"S{k}", "E0", "N", f"C{k % 2}", "c", "t", [3e13, 3e13, 0.25, 0.125, -1.0][k % 5], 1)
             for k in range(40)]
    s, _ = frames(spark, sales, [])
    got = {r.key: (r.eventName, r.value) for r in city_highest_sales_per_event(s).collect()}
    assert got == brute_city(sales)


@pytest.mark.parametrize("scoped", [True, False])
def test_kept_tables_are_joined_by_shuffle(spark, scoped):
    """Tables and a batch's members grow with the input: none is broadcast, however small its file looks."""
    contest = highwater.city_contest(frames(spark)[0]) if scoped else highwater.profit_contest(*frames(spark))
    members = [("E1", "Aveiro"), ("E1", "Faro"), ("E9", "Porto")] if scoped else [("E1",), ("E4",), ("E9",)]
    table = spark.createDataFrame([(*m, 5) for m in members], [*contest.by, "total"])
    joined = [streamed._touched(contest, table, contest.matches("t"))]
    assert sorted(r[:-1] for r in joined[0].collect()) == members[:1 if scoped else 2]
    if scoped:
        best, known = (spark.createDataFrame(rows, "scope string, pos long") for rows in ([("E1", 1), ("E2", 2), (None, 3)], [("E1", 1), ("E2", 1), (None, 3)]))
        joined.append(streamed._changed(contest, best, known))
        assert [tuple(r) for r in joined[1].collect()] == [("E2", 2)]
    else:
        joined.append(streamed._names(contest.entries, spark.createDataFrame([("E1", "E1", "Tech")], ["member", "id", "name"])))
        assert sorted(tuple(r) for r in joined[1].collect()) == [("E2", "E2", "Rock"), ("E3", "E3", "Football")]
    assert not any("Broadcast" in rows._jdf.queryExecution().executedPlan().toString() for rows in joined)
