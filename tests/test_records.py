"""Topic records: decoding, encoding, the result envelope, Kafka options."""

import json

import pytest

from tests.hand import EXPENSE_ROWS, SALE_ROWS, at, frames
from turnstile.functions.order import ARRIVAL, arrival_seq, arrival_ts
from turnstile.sinks.envelope import from_records, to_records
from turnstile.sources import topics
from turnstile.sources.decode import decode_expenses, decode_sales, good, quarantine

GOOD = {
    '{"ticketPrice":"2.5","quantity":"3.0"}': (2.5, 3),
    '{"ticketPrice":1}': (1.0, 0),
    '{"quantity":4}': (0.0, 4),
    '{"ticketPrice":null,"quantity":null}': (0.0, 0),
    "{}": (0.0, 0),
}
BAD = {
    None: "empty value", "": "empty value", "null": "unreadable JSON", "{bad": "unreadable JSON",
    "[1]": "unreadable JSON", "5": "unreadable JSON", '{"quantity":1': "unreadable JSON",
    '{"quantity":1} x': "unreadable JSON", '{"quantity":1}{}': "unreadable JSON", '{"quantity":3.5}': "bad quantity",
    '{"quantity":3000000000}': "bad quantity", '{"ticketPrice":"abc"}': "bad ticketPrice",
    '{"ticketPrice":"NaN"}': "bad ticketPrice", '{"ticketPrice":{"a":1}}': "bad ticketPrice",
}


def records(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, timestamp timestamp, partition int, offset long")


def test_good_and_quarantined_records(spark):
    texts = [*GOOD, *BAD]
    decoded = decode_sales(records(spark, [("k", v, at("00:00:00"), 0, i) for i, v in enumerate(texts)]))
    seq = {i * 2: v for i, v in enumerate(texts)}
    assert {seq[r.seq]: (r.ticket_price, r.quantity) for r in good(decoded).collect()} == GOOD
    assert {seq[r.seq]: r.reason for r in quarantine(decoded).collect()} == BAD


def test_records_without_event_time_are_quarantined(spark):
    early = at("00:00:00").replace(year=1960)
    decoded = decode_expenses(records(spark, [("k", "{}", None, 0, 1), ("k", "{}", early, 0, 2)]))
    assert [r.reason for r in quarantine(decoded).collect()] == ["bad timestamp"] * 2
    assert good(decoded).count() == 0


def test_round_trip(spark):
    sales, expenses = frames(spark)
    back = good(decode_sales(topics.encode_sales(sales, partitions=1)))
    assert back.drop("seq").exceptAll(sales.drop("seq")).count() == 0 and back.count() == len(SALE_ROWS)
    back = good(decode_expenses(topics.encode_expenses(expenses)))
    assert back.drop("seq").exceptAll(expenses.drop("seq")).count() == 0 and back.count() == len(EXPENSE_ROWS)


def test_json_is_parsed_once_however_it_is_filtered(spark, tmp_path):
    topics.write_files(topics.encode_sales(frames(spark)[0]), str(tmp_path))
    plan = good(decode_sales(topics.read_files(spark, str(tmp_path))))
    assert plan._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_file_topics(spark, tmp_path, fmt):
    topics.write_files(topics.encode_sales(frames(spark)[0]), str(tmp_path), fmt)
    assert good(decode_sales(topics.read_files(spark, str(tmp_path), fmt))).count() == len(SALE_ROWS)


def test_sequence_numbers_are_unique_over_topics_and_partitions(spark):
    rows = [("k", "{}", at("00:00:00"), p, o) for p in range(3) for o in range(3)]
    both = decode_sales(records(spark, rows)).select("seq").union(decode_expenses(records(spark, rows)).select("seq"))
    assert both.distinct().count() == 18


def test_arrival_unpacks(spark):
    df = spark.createDataFrame([(at("10:11:12"), 2 ** 60 + 5)], "ts timestamp, seq long").selectExpr(
        "ts", "seq", f"{ARRIVAL} as pos").selectExpr("ts", "seq", f"{arrival_ts()} as t", f"{arrival_seq()} as s")
    row = df.first()
    assert row.ts == row.t and row.seq == row.s


def test_envelope(spark):
    rows = spark.createDataFrame(
        [("k", "E1", 'a "b" \\ c\nd', 1.5), ("k", None, None, 2.0)], "key string, id string, eventName string, value double")
    sent = to_records(rows)
    first, second = (json.loads(r.value) for r in sent.collect())
    assert first == {
        "schema": {"type": "struct", "optional": False, "name": "ResultRecord", "fields": [
            {"type": "string", "optional": False, "field": "id"},
            {"type": "string", "optional": True, "field": "eventName"},
            {"type": "double", "optional": False, "field": "value"}]},
        "payload": {"id": "E1", "eventName": 'a "b" \\ c\nd', "value": 1.5}}
    assert second["payload"] == {"id": "", "eventName": "", "value": 2.0}
    assert from_records(sent).first().eventName == 'a "b" \\ c\nd'


def test_kafka_options():
    assert topics.kafka_options("b:9092", "sales", maxOffsetsPerTrigger="5") == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "sales", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "5"}
