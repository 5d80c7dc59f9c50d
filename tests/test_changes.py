"""Changelogs, commit slots, late records and joins by time, record by record in plain Python."""

import random
from datetime import timedelta
from decimal import Decimal

import pytest

from tests.hand import at, frames
from tests.test_highwater import brute_profit, order, records
from turnstile.functions.order import arrival_seq
from turnstile.operators import scan
from turnstile.operators.asof import as_of, catalog_versions, price_sales_asof
from turnstile.operators.grace import accepted, judged
from turnstile.plans import changes as logs
from turnstile.plans.graced import profit_per_minute_graced


def brute_changes(name, sales, expenses):
    """(key, value, seq) of every update, and the time of the record behind it."""
    log, state, out = logs.CHANGELOGS[name], {}, []
    for r in order(sales + expenses):
        sale = len(r) == 11
        if log.keyed and r[0] is None or log.side == ("expenses" if sale else "sales"):
            continue
        key = r[0] if log.keyed else "TOTAL"
        earned, spent, n = state.get(key, (None, None, 0))
        state[key] = earned, spent, n = ((earned or 0) + r[9] * r[10], spent, n + 1) if sale else (earned, (spent or 0) + r[7], n)
        if log.side == "both" and None in (earned, spent):
            continue
        value = {"both": lambda: earned - spent, "expenses": lambda: spent, "sales": lambda: earned / n if "average" in name else earned}[log.side]()
        out.append((key, value, r[2], r[1]))
    return out


def collected(rows):
    return {(r.key, r.seq): round(r.value, 9) for r in rows.selectExpr("*", f"{arrival_seq()} as seq").collect()}


@pytest.mark.parametrize("name", ["revenue_per_event", "profit_per_event", "total_expenses", "total_profit", "average_sale_per_event"])
def test_every_update(spark, name):
    sales, expenses = records(11, 160)
    sales[3] = (None, *sales[3][1:])
    want = brute_changes(name, sales, expenses)
    s, e = frames(spark, sales, expenses)
    assert collected(logs.changes(name, s, e)) == {(k, q): round(v, 9) for k, v, q, _ in want}
    last = {(k, int(t.timestamp()) // 600): (k, v, q) for k, v, q, t in want}
    assert collected(logs.changes(name, s, e, every=600)) == {(k, q): round(v, 9) for k, v, q in last.values()}


def test_one_hot_key(spark):
    s, e = frames(spark, [("E0", at("00:00:00") + timedelta(seconds=i), i, f"S{i}", "E0", "n", "c", "c", "t", 1.0, 1) for i in range(900)], [])
    rows = logs.changes("total_revenue", s)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    assert [r.value for r in rows.orderBy("pos").collect()] == [float(i) for i in range(1, 901)]
    assert logs.changes("total_profit", s, e).count() == 0
    assert logs.changes("total_revenue", s.limit(0)).count() == 0


def test_highest_profit_changes(spark):
    sales, expenses = records(5, 90, refunds=True)
    rows = logs.highest_profit_changes(*frames(spark, sales, expenses)).orderBy("pos").collect()
    both, seen = order(sales + expenses), 0
    for k in range(1, len(both) + 1):
        part = [r for r in both[:k] if len(r) == 11], [r for r in both[:k] if len(r) == 8]
        r = both[k - 1]
        if any(x[0] == r[0] for x in part[0]) and any(x[0] == r[0] for x in part[1]):
            assert (rows[seen].eventName, rows[seen].value) == brute_profit(*part)
            assert rows[seen].id == (r[0] if seen == 0 else "HIGHEST_PROFIT_EVENT")
            seen += 1
    assert seen == len(rows)


def test_grace_on_both_sides_of_the_edge(spark):
    """A window ends at 00:01 and is open while stream time is before 00:01 and 23 h 59 min, the midnight after."""
    def sale(seq, when, day=1):
        return ("E1", at(when, day), seq, f"S{seq}", "E1", "n", "c", "c", "t", 1.0, 10 ** seq)

    def expense(seq, when, day=1):
        return ("E1", at(when, day), seq, f"X{seq}", "E1", "n", "venue", 1.0)

    sales = [sale(0, "00:00:30"), sale(1, "23:59:59"), sale(2, "00:00:10"), sale(3, "00:00:00", 2), sale(4, "00:00:20"), sale(5, "00:01:00")]
    expenses = [expense(0, "00:00:05"), expense(1, "00:00:00", 3), expense(2, "00:00:06"), expense(3, "23:59:59", 2), expense(4, "00:00:59", 2)]
    s, e = frames(spark, sales, expenses)
    assert sorted(r.seq for r in accepted(s).collect()) == [0, 1, 2, 3, 5]
    assert sorted(r.seq for r in accepted(e).collect()) == [0, 1, 3]
    got = {r.key: r.value for r in profit_per_minute_graced(s, e).collect()}
    assert got == {f"TOTAL_PROFIT_WINDOWED_{int(at('00:00:00').timestamp() * 1000)}": 100.0}  # the second day's expense was late
    assert "SinglePartition" not in accepted(s)._jdf.queryExecution().executedPlan().toString()
    apart = judged(s, by="seq % 2")
    assert not any(r.late for r in apart.where("seq % 2 = 0").collect())  # the even ones never see the second day
    assert accepted(s.limit(0)).count() == 0


def test_as_of(spark, monkeypatch):
    rng = random.Random(3)
    facts = [(rng.choice(["hot", "hot", "b", None]), rng.randrange(60), i) for i in range(400)]
    versions = [(k, t, f"{k}{t}", rng.random() < 0.2) for k in ("hot", "b", "c") for t in rng.sample(range(60), 12)]
    original = scan.running
    monkeypatch.setattr("turnstile.operators.asof.running", lambda *a: original(*a, slices=6))
    got = as_of(spark.createDataFrame(facts, "k string, at long, n long"), spark.createDataFrame(versions, "k string, since long, v string, gone boolean"),
                "k", "at", "since", "gone").collect()
    want = {}
    for k, t, n in facts:
        last = max((v for v in versions if v[0] == k and v[1] <= t), key=lambda v: v[1], default=None)
        if last and not last[3]:
            want[n] = (k, t, last[2])
    assert {r.n: (r.k, r["at"], r.v) for r in got} == want and len(got) == len(want)


def test_prices_of_the_catalog_in_force(spark):
    days = {1: [("E1", "10"), ("E2", "20")], 3: [("E1", "10")], 4: [("E1", "12"), ("E2", "25")]}  # the reload of day 2 found nothing
    copies = [(at("00:00:00", day), e, f"name {e}", "city", "c", Decimal(price)) for day, events in days.items() for e, price in events]
    snapshots = spark.createDataFrame(copies, "snapshot_ts timestamp, event_id string, event_name string, city string, category string, "
                                      "base_ticket_price decimal(10,2)")
    kept = {(r.event_id, r.since.day, r.ended) for r in catalog_versions(snapshots).collect()}
    assert kept == {("E1", 1, False), ("E2", 1, False), ("E2", 3, True), ("E1", 4, False), ("E2", 4, False)}
    when = [("E1", "23:59:59", 1), ("E1", "00:00:00", 2), ("E2", "12:00:00", 2), ("E2", "00:00:00", 3), ("E1", "00:00:00", 4), ("E3", "00:00:00", 4)]
    raw = spark.createDataFrame([("k", at(clock, day), i, f"S{i}", e, "NORMAL", 1) for i, (e, clock, day) in enumerate(when)],
                                "key string, ts timestamp, seq long, sale_id string, event_id string, ticket_type string, quantity int")
    early = raw.withColumn("ts", raw.ts - timedelta(days=3)).where("seq = 0")
    assert {r.seq: r.ticket_price for r in price_sales_asof(raw, snapshots).collect()} == {0: 10.0, 1: 10.0, 2: 20.0, 4: 12.0}
    assert price_sales_asof(early, snapshots).count() == 0
