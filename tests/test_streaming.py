"""Streams against their batch results, replays, late records, quarantine and pricing."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.hand import EXPECTED, EXPENSE_ROWS, SALE_ROWS, at, frames, shape
from tests.test_highwater import brute_city, brute_profit, order, records
from turnstile.constants import LATENESS
from turnstile.plans.results import RESULTS
from turnstile.plans.tables import highest_profit_table
from turnstile.sinks.envelope import from_records
from turnstile.sinks.tables import SnapshotTable, UpsertTable
from turnstile.sources import topics
from turnstile.sources.catalog import RefreshingCatalog, read_result, seed_events
from turnstile.sources.decode import decode_expenses, decode_sales, good
from turnstile.streaming import runners
from turnstile.streaming.families import FAMILIES
from turnstile.streaming.state import read_state

WINDOWED = [n for n in RESULTS if n.endswith("per_minute")]


def publish(spark, root, sales, expenses):
    s, e = frames(spark, sales, expenses)
    topics.write_files(topics.encode_sales(s).coalesce(1), f"{root}/sales")
    topics.write_files(topics.encode_expenses(e).coalesce(1), f"{root}/expenses")


def streams(spark, root):
    return (good(decode_sales(topics.stream_files(spark, f"{root}/sales"))),
            good(decode_expenses(topics.stream_files(spark, f"{root}/expenses"))))


def run(spark, root, name, sinks=runners.SINKS):
    runners.start_result(name, *streams(spark, root), f"{root}/out", sinks, every=None).awaitTermination()


def chunks(sales, expenses, cuts):
    """Both streams cut at the given places of their common order."""
    both = order(sales + expenses)
    for lo, hi in zip((0, *cuts), (*cuts, len(both))):
        part = both[lo:hi]
        yield [r for r in part if len(r) == 11], [r for r in part if len(r) == 8]


def test_streams_equal_the_hand_case(spark, tmp_path):
    """All results at once, in three chunks; the queries stop and resume from their checkpoints after each."""
    updates: dict[str, list[int]] = {}
    for sales, expenses in chunks(SALE_ROWS, EXPENSE_ROWS, (3, 6)):
        publish(spark, tmp_path, sales, expenses)
        queries = runners.start_all(*streams(spark, tmp_path), f"{tmp_path}/out", every=None, sinks=("by_key",),
                                    more=lambda name: lambda rows, _: updates.setdefault(name, []).append(rows.count()))
        for query in queries:
            query.awaitTermination()
    assert len(queries) == 7 and set(updates) == set(RESULTS)
    for name in RESULTS:
        table = UpsertTable(spark, f"{tmp_path}/out/{name}/by_key", "key").read()
        assert shape(name, table.collect()) == pytest.approx(EXPECTED[name]), name


def test_result_tables_and_change_topic(spark, tmp_path):
    publish(spark, tmp_path, SALE_ROWS, EXPENSE_ROWS)
    for name in ("revenue_per_minute", "average_sale_per_event"):
        run(spark, tmp_path, name)
    out = f"{tmp_path}/out"
    assert [(r.id, r.value) for r in read_result(spark, out, "revenue_per_minute").collect()] == [
        ("TOTAL_REVENUE_WINDOWED", 210.0)]
    assert [r.value for r in read_result(spark, out, "average_sale_per_event").collect()] == [90.0]
    changes = from_records(spark.read.parquet(f"{out}/revenue_per_minute/changes"))
    assert sorted(r.value for r in changes.collect()) == [140.0, 210.0, 516.0]
    with pytest.raises(ValueError, match="total_profit"):
        read_result(spark, out, "total_profit")
    with pytest.raises(ValueError, match="nothing"):
        read_result(spark, out, "nothing")


@pytest.mark.parametrize("cuts", [(2, 41), (10, 90)])
def test_high_water_does_not_depend_on_chunking(spark, tmp_path, cuts):
    sales, expenses = records(7, 120, refunds=True)
    for s, e in chunks(sales, expenses, cuts):
        publish(spark, tmp_path, s, e)
        both = [runners.start_result(n, *streams(spark, tmp_path), f"{tmp_path}/out", ("by_key", "by_id"), every=None)
                for n in ("highest_profit_event", "city_highest_sales_per_event")]
        for query in both:
            query.awaitTermination()
    read = lambda n: UpsertTable(spark, f"{tmp_path}/out/{n}/by_key", "key").read().collect()
    assert [(r.eventName, r.value) for r in read("highest_profit_event")] == [brute_profit(sales, expenses)]
    assert {r.key: (r.eventName, r.value) for r in read("city_highest_sales_per_event")} == brute_city(sales)
    shown = read_result(spark, f"{tmp_path}/out", "highest_profit_event").collect()
    assert sorted(shown) == sorted(highest_profit_table(*frames(spark, sales, expenses)).collect())


def test_high_water_never_falls_and_bounds_the_current_value(spark, tmp_path):
    sales, expenses = records(11, 90, refunds=True)
    seen = []
    for s, e in chunks(sales, expenses, (30, 60)):
        publish(spark, tmp_path, s, e)
        run(spark, tmp_path, "highest_profit_event", ("by_key",))
        run(spark, tmp_path, "profit_per_event", ("by_key",))
        best = UpsertTable(spark, f"{tmp_path}/out/highest_profit_event/by_key", "key").read().first().value
        now = UpsertTable(spark, f"{tmp_path}/out/profit_per_event/by_key", "key").read().agg(F.max("value")).first()[0]
        assert best >= now
        seen.append(best)
    assert seen == sorted(seen)


def test_late_records(spark, tmp_path):
    """One second either side of the closing window, two batches after the one that moved the watermark."""
    start = datetime(2026, 1, 2, tzinfo=timezone.utc) + timedelta(minutes=1)
    sale = lambda seq, ts: ("E1", ts, seq, f"S{seq}", "E1", "n", "c", "c", "t", 1.0, 1)
    edge = start - timedelta(hours=23, minutes=59)  # windows ending at or before this are closed
    batches = [[sale(1, start)], [sale(2, start)], [sale(3, edge - timedelta(seconds=1)), sale(4, edge)]]
    for rows in batches:
        publish(spark, tmp_path, rows, [])
        run(spark, tmp_path, "revenue_per_minute", ("by_key",))
    table = UpsertTable(spark, f"{tmp_path}/out/revenue_per_minute/by_key", "key").read()
    assert {r.window_start.replace(tzinfo=timezone.utc): r.value for r in table.collect()} == {
        start: 2.0, edge: 1.0}


def test_upsert_replay_changes_nothing(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "id string, eventName string, value double, pos long")

    table = UpsertTable(spark, str(tmp_path / "t"), "id")
    table.merge(batch(("a", 'q"\\\n', 1.0, 1), ("a", "late", 2.0, 2), ("b", None, 3.0, 3)), 0)
    for _ in range(2):
        table.merge(batch(("b", "x", 4.0, 1), ("c", "y", 5.0, 2)), 1)
        assert {(r.id, r.eventName, r.value) for r in table.read().collect()} == {
            ("a", "late", 2.0), ("b", "x", 4.0), ("c", "y", 5.0)}
    for version in range(2, 12):
        table.merge(batch(("d", "z", float(version), 1)), version)
    assert table.read().count() == 4 and table.versions() == []
    table = UpsertTable(spark, str(tmp_path / "folded"), "id", keep=2, fold_every=3)
    for version in range(10):
        written = table.merge(batch((f"k{version % 4}", "z", float(version), 1)), version)
        assert written.count() == 1
        assert {r.id: r.value for r in table.read().collect()} == {f"k{v % 4}": float(v) for v in range(max(0, version - 3), version + 1)}
    assert table.versions() == [5, 8] and table.versions("change") == [6, 7, 8, 9]
    table.merge(batch(("new", "run", 1.0, 1)), 0)
    assert [r.id for r in table.read().collect()] == ["new"] and table.versions("change") == [0]


def test_a_query_that_starts_anew_replaces_the_old_table(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    for version in (0, 1, 2):
        table.write(spark.range(5), version)
    table.write(spark.range(2), 0)
    assert table.versions() == [0] and table.read().count() == 2


def test_quarantine_stream(spark, tmp_path):
    publish(spark, tmp_path, SALE_ROWS, EXPENSE_ROWS)
    bad = spark.createDataFrame([("E1", "{bad", at("00:00:00"), 0, 50), ("E1", None, at("00:00:00"), 0, 51)],
                                "key string, value string, timestamp timestamp, partition int, offset long")
    topics.write_files(bad, f"{tmp_path}/sales")
    decoded = decode_sales(topics.stream_files(spark, f"{tmp_path}/sales"))
    runners.start_quarantine(decoded, f"{tmp_path}/q", every=None).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/q/rows").count() == 2
    run(spark, tmp_path, "total_revenue")
    assert UpsertTable(spark, f"{tmp_path}/out/total_revenue/by_key", "key").read().first().value == 866


def test_one_read_for_good_and_refused_records(spark, tmp_path):
    publish(spark, tmp_path, SALE_ROWS, EXPENSE_ROWS)
    bad = spark.createDataFrame([("E1", "{bad", at("00:00:00"), 0, 50), ("E1", None, at("00:00:00"), 0, 51), ("E1", None, at("00:00:00"), 0, 52)],
                                "key string, value string, timestamp timestamp, partition int, offset long")
    topics.write_files(bad.coalesce(1), f"{tmp_path}/sales")
    stream = topics.stream_files(spark, f"{tmp_path}/sales", files_per_batch=1)
    kept = []
    query = runners.start_split(decode_sales(stream), f"{tmp_path}/q", lambda rows, batch: kept.extend((batch, r.seq) for r in rows.collect()), every=None)
    query.awaitTermination()
    assert len(kept) == len(set(kept)) == len(SALE_ROWS)
    rejected = spark.read.parquet(f"{tmp_path}/q/rejected").collect()
    assert sorted(r.reason for r in rejected) == ["empty value", "empty value", "unreadable JSON"]
    counts = {(r.b, r.reason): r.n for r in spark.read.parquet(f"{tmp_path}/q/counts").collect()}
    assert counts == {(0, "good"): 5, (1, "empty value"): 2, (1, "unreadable JSON"): 1}
    # Each record is read once, whatever is written of it.
    assert sum(p.numInputRows for p in query.recentProgress) == len(SALE_ROWS) + 3


@pytest.mark.parametrize("name", ["revenue_per_event", "total_profit", "average_sale_per_event", "profit_per_minute"])
def test_results_read_back_from_the_state(spark, tmp_path, name):
    for sales, expenses in chunks(SALE_ROWS, EXPENSE_ROWS, (4,)):
        publish(spark, tmp_path, sales, expenses)
        run(spark, tmp_path, name, ("by_key",))
    table = UpsertTable(spark, f"{tmp_path}/out/{name}/by_key", "key").read()
    stored = read_state(spark, f"{tmp_path}/out", name)
    assert sorted(map(str, stored.select(*table.columns).collect())) == sorted(map(str, table.collect()))
    assert shape(name, stored.collect()) == pytest.approx(EXPECTED[name])
    early = read_state(spark, f"{tmp_path}/out", name, batch=0)
    assert early.count() < stored.count() or early.collect() != stored.collect()
    with pytest.raises(KeyError, match="highest_profit_event"):
        read_state(spark, f"{tmp_path}/out", "highest_profit_event")


def test_pricing_stream_follows_the_catalog(spark, tmp_path):
    raw = spark.createDataFrame(
        [("E1", at("00:00:01"), 1, "S1", "E1", "VIP", 2), ("E9", at("00:00:02"), 2, "S2", "E9", "NORMAL", 1)],
        "key string, ts timestamp, seq long, sale_id string, event_id string, ticket_type string, quantity int")
    raw.write.parquet(f"{tmp_path}/raw")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/raw")
    catalog = RefreshingCatalog(lambda: seed_events(spark))
    priced = []
    runners.start_pricing(stream, catalog, f"{tmp_path}/p", lambda df, _: priced.extend(df.collect()),
                          every=None).awaitTermination()
    assert [(r.event_name, r.city, r.ticket_price) for r in priced] == [("Tech Conference 2026", "Aveiro", 72.0)]


def test_an_empty_reload_keeps_the_catalog(spark):
    now, source = [0.0], [seed_events(spark)]
    catalog = RefreshingCatalog(lambda: source[0], clock=lambda: now[0])
    assert catalog.current().count() == 5
    source[0] = seed_events(spark).limit(0)
    now[0] = 31.0
    assert catalog.current().count() == 5
    source[0] = seed_events(spark).limit(2)
    now[0] = 45.0
    assert catalog.current().count() == 5
    now[0] = 62.0
    assert catalog.current().count() == 2


def test_replays_can_be_dropped(spark, tmp_path):
    for _ in range(2):
        publish(spark, tmp_path, SALE_ROWS, [])
    sales = runners.without_replays(streams(spark, tmp_path)[0])
    for name in ("total_revenue", "revenue_per_minute"):
        runners.start_result(name, sales, None, f"{tmp_path}/once", every=None).awaitTermination()
        table = UpsertTable(spark, f"{tmp_path}/once/{name}/by_key", "key").read()
        assert shape(name, table.collect()) == EXPECTED[name]


def test_replays_guarded_within_a_time_or_for_ever(spark, tmp_path):
    """A sale three days late counts in a total, unless ids are remembered for a time only."""
    day = datetime(2026, 1, 5, tzinfo=timezone.utc)
    sale = lambda seq, ts: ("E1", ts, seq, f"S{seq}", "E1", "n", "c", "c", "t", 1.0, 1)
    for rows in ([sale(1, day)], [sale(2, day)], [sale(3, day - timedelta(days=3)), sale(2, day)]):
        publish(spark, tmp_path, rows, [])
        for within, kept in ((None, "all"), (LATENESS, "timely")):
            sales = runners.without_replays(streams(spark, tmp_path)[0], within=within)
            runners.start_result("total_revenue", sales, None, f"{tmp_path}/{kept}", ("by_key",), every=None).awaitTermination()
    totals = [UpsertTable(spark, f"{tmp_path}/{kept}/total_revenue/by_key", "key").read().first().value for kept in ("all", "timely")]
    assert totals == [3.0, 2.0]


def test_sinks_may_be_functions(spark, tmp_path, monkeypatch):
    publish(spark, tmp_path, SALE_ROWS, EXPENSE_ROWS)
    called = []
    monkeypatch.setattr(runners, "upsert_jdbc", lambda rows, *args, staging: called.append((rows.count(), *args, staging)))
    sinks = (runners.jdbc_sink("jdbc:x", "u", "p", "t"), lambda rows, batch_id: called.append((rows.first().value, batch_id)))
    run(spark, tmp_path, "total_revenue", sinks)
    assert called == [(1, "jdbc:x", "u", "p", "t", "t_staging_0"), (866.0, 0)]


def test_a_shared_query_shows_what_queries_of_their_own_show(spark, tmp_path):
    names = [name for family in FAMILIES.values() for name in family]
    own, shared = {}, {}
    keep = lambda into, name: lambda rows, _: into.setdefault(name, []).append(sorted(map(str, rows.collect())))
    for sales, expenses in chunks(SALE_ROWS, EXPENSE_ROWS, (2, 5)):
        publish(spark, tmp_path, sales, expenses)
        for name in names:
            inputs = [s if kind in RESULTS[name].inputs else None
                      for kind, s in zip(("sales", "expenses"), streams(spark, tmp_path), strict=True)]
            runners.start_result(name, *inputs, f"{tmp_path}/own", (keep(own, name),), every=None).awaitTermination()
        for family in FAMILIES:
            runners.start_family(family, *streams(spark, tmp_path), f"{tmp_path}/shared", lambda name: (keep(shared, name),),
                                 every=None).awaitTermination()
    assert {name: [rows for rows in batches if rows] for name, batches in shared.items()} == {
        name: [rows for rows in batches if rows] for name, batches in own.items()}


def test_a_small_batch_opens_its_buckets_of_a_large_table_only(spark, tmp_path):
    """Ten rows against a million keys: the files read are those of the ten rows' buckets, and the changes since."""
    table = UpsertTable(spark, str(tmp_path / "t"), "id", bucket_bytes=256 << 10)
    million = spark.range(1_000_000).selectExpr("cast(id as string) as id", "cast(id as double) as value")
    table.merge(million, 0, order=None)
    assert table.versions() == [0]  # a batch larger than the table was is folded at once
    few = spark.createDataFrame([(str(i), -1.0) for i in (*range(0, 900_000, 100_000), 2_000_000)], "id string, value double")
    table.merge(few, 1, order=None)
    assert table.versions() == [0]
    folders = lambda df: {f.split("/v=0/")[1].split("/")[0] for f in df.inputFiles() if "/v=0/" in f}
    whole, part = folders(table.read()), table.read(touching=few)
    assert len(whole) > 30 and 1 <= len(folders(part)) <= 10
    assert sorted((r.id, r.value) for r in part.join(few, "id", "left_semi").collect()) == sorted(few.collect())
    assert table.read().count() == 1_000_001 and table.read().where("value = -1").count() == 10
    old = table.read(before=1, touching=few).join(few, "id", "left_semi")
    assert sorted(r.value for r in old.collect()) == [float(i) for i in range(0, 900_000, 100_000)]
    table.merge(million.limit(5), 0, order=None)  # a run that starts anew is not folded: the old whole table goes
    assert table.versions() == [] and table.read().count() == 5


def test_buckets_take_keys_of_any_type_and_nulls(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), "a", "b", bucket_bytes=1, fold_every=1)
    rows = spark.createDataFrame([("x", None, 1), (None, None, 2), ("x", 3, 3), ("y", 3, 4)], "a string, b long, value int")
    table.merge(rows, 0, order=None)
    for a, b, value in (("x", None, 1), (None, None, 2), ("x", 3, 3)):
        one = spark.createDataFrame([(a, b)], "a string, b int")  # the keys of a narrower type than the table's
        assert (a, b, value) in [tuple(r) for r in table.read(touching=one).collect()]
    table.merge(rows.where("a = 'x'").withColumn("value", rows.value + 10), 1, order=None)
    assert sorted(r.value for r in table.read().collect()) == [2, 4, 11, 13]
    assert table.read(touching=rows.limit(0)).count() == 0


def test_high_water_over_bucketed_tables(spark, tmp_path, monkeypatch):
    """Every table folded and cut into buckets with each batch, against brute force."""
    monkeypatch.setattr("turnstile.streaming.highwater.UpsertTable",
                        lambda *args: UpsertTable(*args, bucket_bytes=1024, fold_every=1))
    sales, expenses = records(5, 100, refunds=True)
    for s, e in chunks(sales, expenses, (20, 60)):
        publish(spark, tmp_path, s, e)
        for name in ("highest_profit_event", "city_highest_sales_per_event"):
            run(spark, tmp_path, name, ("by_key",))
    assert all(list(tmp_path.glob(f"out/{t}/v=*/bucket_of_*")) for t in (
        "highest_profit_event/totals", "highest_profit_event/names", "city_highest_sales_per_event/totals", "city_highest_sales_per_event/bests"))
    read = lambda n: UpsertTable(spark, f"{tmp_path}/out/{n}/by_key", "key").read().collect()
    assert [(r.eventName, r.value) for r in read("highest_profit_event")] == [brute_profit(sales, expenses)]
    assert {r.key: (r.eventName, r.value) for r in read("city_highest_sales_per_event")} == brute_city(sales)
