"""The topics of the streaming queries: their records are joined with the events once, and by shuffle where those are many."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnstile.sources import topics
from workload import streams, views


@pytest.fixture
def given(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i), i % 7, "error" if i % 4 == 0 else "view", float(i)) for i in range(120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(6).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "'t' as p_type", "10.5D + id as p_retailprice").write.parquet(
        f"{tmp_path}/part.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey", "concat('n', id) as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_topics_hold_every_record_and_are_joined_once(spark, given, monkeypatch):
    written = []
    whole = topics.write_files
    monkeypatch.setattr(topics, "write_files", lambda records, path, **more: (written.append(records), whole(records, path, **more)))
    root = streams.publish(spark, given)
    for name, view in (("sales", topics.encode_sales(views.ticket_sales(spark, given))), ("expenses", topics.encode_expenses(views.event_expenses(spark, given)))):
        columns = ["key", "value", "timestamp", "partition", "offset"]
        assert sorted(map(str, spark.read.parquet(f"{root}/{name}").select(columns).collect())) == sorted(map(str, view.select(columns).collect()))
    assert len(written) == 2 * streams.CHUNKS
    assert not any("Join" in records._jdf.queryExecution().optimizedPlan().toString() for records in written)


@pytest.mark.parametrize("few", [True, False])
def test_many_events_are_not_broadcast(spark, given, monkeypatch, few):
    monkeypatch.setattr(views, "is_small", lambda events: few)
    for view, joins in ((views.ticket_sales, 2), (views.event_expenses, 1)):
        plan = view(spark, given)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == (joins if few else joins - 1)
        assert plan.count("SortMergeJoin") == (0 if few else 1)
    assert views.ticket_sales(spark, given).agg(F.count("*"), F.sum("seq")).first() == tuple(
        (len(n), sum(n)) for n in [[i for i in range(120) if i % 4 and i % 7 < 6]])[0]
