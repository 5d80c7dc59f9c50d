"""Catalog: seeds, listings, lookups, appends, snapshots; reports."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.hand import at
from turnstile.operators.append import append_cities, append_events, trimmed
from turnstile.operators.lookup import lookup, name_expenses, price_sales, with_ids
from turnstile.plans.report import catalog_report, result_report
from turnstile.sources import catalog, jdbc

RAW = "key string, ts timestamp, seq long, sale_id string, event_id string, ticket_type string, quantity int"
EVENT = "seq long, event_id string, event_name string, city string, category string, base_ticket_price string"


def test_seeds_and_listings(spark):
    cities = catalog.list_cities(catalog.seed_cities(spark)).collect()
    assert [(c.cityId, c.cityName) for c in cities][:2] == [(1, "Aveiro"), (2, "Porto")]
    events = catalog.list_events(catalog.seed_events(spark).union(
        spark.createDataFrame([("E10", "n", "c", "k", Decimal("1.00"))], catalog.EVENTS))).collect()
    assert [e.eventId for e in events] == ["E1", "E10", "E2", "E3", "E4", "E5"]  # ids are text


@pytest.mark.parametrize("limit", [100, 2])
def test_pricing_by_broadcast_and_by_shuffle(spark, limit):
    raw = spark.createDataFrame(
        [("E1", at("00:00:01"), 1, "S1", "E1", "VIP", 2), ("E2", at("00:00:02"), 2, "S2", "E2", "STUDENT", 1),
         ("E3", at("00:00:03"), 3, "S3", "E3", "NORMAL", 1), ("E9", at("00:00:04"), 4, "S4", "E9", "VIP", 1)], RAW)
    rows = price_sales(raw, catalog.seed_events(spark), broadcast_rows=limit).collect()
    assert {r.sale_id: (r.event_name, r.city, round(r.ticket_price, 3)) for r in rows} == {
        "S1": ("Tech Conference 2026", "Aveiro", 72.0), "S2": ("Rock Festival", "Porto", 38.5),
        "S3": ("Football Match", "Lisboa", 30.0)}


def test_a_hot_key_is_spread_over_tasks(spark):
    facts = spark.range(2000).select(F.lit("E1").alias("event_id"), "id")
    joined = lookup(facts, catalog.seed_events(spark).select("event_id", "event_name"), "event_id", broadcast_rows=1)
    assert joined.count() == 2000 and joined.agg(F.countDistinct("id")).first()[0] == 2000
    assert "_salt" in joined._jdf.queryExecution().executedPlan().toString()


def test_expense_names(spark):
    raw = spark.createDataFrame([("E1", at("00:00:01"), 1, "X1", "E1", "venue", 5.0)],
                                "key string, ts timestamp, seq long, expense_id string, event_id string, "
                                "expense_type string, cost double")
    assert name_expenses(raw, catalog.seed_events(spark)).first().event_name == "Tech Conference 2026"


def test_append_events(spark):
    ok = ("name", "city", "music")
    requests = [
        (1, "E6", *ok, "12.345"), (2, "E6", *ok, "1"), (3, "E1", *ok, "1"), (4, "E7", " ", "c", "m", "1"),
        (5, "E7", "n", None, "m", "1"), (6, "x" * 21, *ok, "1"), (7, "E7", *ok, "abc"), (8, "E7", *ok, "100000000"),
        (9, "E7", *ok, ""), (10, "E7", "n" * 151, "c", "m", "1"), (11, "E7", *ok, "7")]
    accepted, rejected = append_events(catalog.seed_events(spark), spark.createDataFrame(requests, EVENT))
    assert {(r.event_id, r.base_ticket_price) for r in accepted.collect()} == {
        ("E6", Decimal("12.35")), ("E7", Decimal("7.00"))}  # a rejected request does not take the id
    assert {r.seq: r.reason for r in rejected.collect()} == {
        2: "event_id already exists", 3: "event_id already exists", 4: "missing event_name", 5: "missing city",
        6: "event_id is longer than 20", 7: "base_ticket_price is not a number",
        8: "base_ticket_price is out of range", 9: "missing base_ticket_price", 10: "event_name is longer than 150"}


def test_append_cities(spark):
    block = 1 << 20
    requests = [(1, "Faro"), (2, " "), (3, "Porto"), (4, "Faro"), (block * 3 + 1, "Evora"), (block + 5, "Beja"),
                (7, "x" * 101), (8, None)]
    accepted, rejected = append_cities(
        catalog.seed_cities(spark), spark.createDataFrame(requests, "seq long, city_name string"))
    assert {r.city_name: r.city_id for r in accepted.collect()} == {"Faro": 6, "Beja": 7, "Evora": 8}
    assert {r.seq: r.reason for r in rejected.collect()} == {
        2: "missing city_name", 3: "city_name already exists", 4: "city_name already exists",
        7: "city_name is longer than 100", 8: "missing city_name"}


def test_first_city_of_an_empty_catalog(spark):
    none = catalog.seed_cities(spark).limit(0)
    accepted, _ = append_cities(none, spark.createDataFrame([(1, "Faro")], "seq long, city_name string"))
    assert [(r.city_id, r.city_name) for r in accepted.collect()] == [(1, "Faro")]


def test_snapshots_accumulate(spark, tmp_path):
    for t in ("2026-01-01 00:00:00", "2026-01-01 00:01:00"):
        catalog.append_snapshot(catalog.seed_events(spark), str(tmp_path / "s"), t)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("snapshot_ts").count().count() == 2


def test_result_report(spark):
    rows = spark.createDataFrame([("i", "n" * 31, 1234.5), (None, None, None), ("x" * 28, "n" * 30, -0.126)],
                                 "id string, eventName string, value double")
    assert [tuple(r) for r in result_report(rows).collect()] == [
        ("i", "n" * 27 + "...", "€    1234.50"), ("-", "-", "€       0.00"), ("x" * 28, "n" * 30, "€      -0.13")]


def test_catalog_report(spark):
    row = catalog_report(catalog.seed_events(spark)).first()
    assert tuple(row) == ("E1", "Tech Conference 2026", "Aveiro", "Technology", "€    40.00")


def test_jdbc_options_and_statements():
    options = jdbc.jdbc_options("jdbc:x", "u", "p", query=jdbc.EVENTS_QUERY, fetchsize="1000")
    assert options == {"url": "jdbc:x", "user": "u", "password": "p", "query": jdbc.EVENTS_QUERY, "fetchsize": "1000"}
    assert jdbc.jdbc_options("jdbc:x", "u", "p", table="cities")["dbtable"] == "cities"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "u", "p")
    assert "on conflict (id) do update" in jdbc.upsert_statement("t", "s")
    assert "if not exists" in jdbc.create_statement("t")


def test_missing_ids_are_filled(spark):
    raw = spark.createDataFrame([(1, "S1"), (2, None), (3, None)], "seq long, sale_id string")
    ids = {r.seq: r.sale_id for r in with_ids(raw, "sale_id").collect()}
    assert ids[1] == "S1" and len(set(ids.values())) == 3 and len(ids[2]) == 36
    assert len(with_ids(raw.drop("sale_id"), "sale_id").first().sale_id) == 36


def test_forms_are_trimmed(spark):
    rows = trimmed(spark.createDataFrame([(1, "  Faro "), (2, "\t\x00Porto de\tMos\r\n"), (3, "\u2003Beja")], "seq long, city_name string"))
    assert [tuple(r) for r in rows.orderBy("seq").collect()] == [(1, "Faro"), (2, "Porto de\tMos"), (3, "\u2003Beja")]


def test_blank_in_any_white_space(spark):
    requests = spark.createDataFrame([(1, "\u2003"), (2, "\x1c\t"), (3, "\u00a0"), (4, ""), (5, "Faro")], "seq long, city_name string")
    accepted, rejected = append_cities(catalog.seed_cities(spark), requests)
    assert {r.seq for r in accepted.collect()} == {3, 5}  # a space that doesn't break is no white space
    assert {r.reason for r in rejected.collect()} == {"missing city_name"}


def test_city_numbers_of_scattered_requests(spark):
    requests = spark.range(5000).selectExpr("xxhash64(id) as seq", "concat('City ', id) as city_name")
    accepted, _ = append_cities(catalog.seed_cities(spark), requests)
    rows = accepted.orderBy("seq").collect()
    assert [r.city_id for r in rows] == list(range(6, 5006))


def test_facts_with_a_map_are_spread(spark):
    facts = spark.range(10).selectExpr("'E1' as event_id", "id", "map('a', id) as more")
    assert lookup(facts, catalog.seed_events(spark).select("event_id", "event_name"), "event_id", broadcast_rows=1).count() == 10


def test_only_rows_of_hot_keys_are_copied(spark):
    """Neither the copies nor a large dimension that its file makes look small are broadcast."""
    facts = spark.range(2000).selectExpr("if(id % 2 = 0, 'E1', if(id % 2 = 1 and id < 1900, concat('E', id % 7), null)) as event_id", "id")
    events = catalog.seed_events(spark).select("event_id", "event_name")
    whole = sorted(facts.join(events, "event_id").collect())
    for hot_rows in (1, 900, 5000):
        joined = lookup(facts, events, "event_id", broadcast_rows=1, hot_rows=hot_rows)
        assert sorted(joined.collect()) == whole
        assert joined.columns == ["event_id", "id", "event_name"]
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan and plan.count("strategy=broadcast") == 2  # the list of hot keys, on either side


def test_a_stream_of_facts_is_joined_by_shuffle(spark, tmp_path):
    spark.range(20).selectExpr("concat('E', id % 7) as event_id", "id").write.parquet(f"{tmp_path}/in")
    facts = spark.readStream.schema("event_id string, id long").parquet(f"{tmp_path}/in")
    joined = lookup(facts, catalog.seed_events(spark).select("event_id", "event_name"), "event_id", broadcast_rows=1)
    joined.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15
