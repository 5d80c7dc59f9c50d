"""Streaming runs over the given tables: both topics are written in three time-ordered chunks, one micro-batch each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.session import materialise, scratch_path, scratch_scope
from turnstile.sinks.envelope import from_records
from turnstile.sinks.tables import UpsertTable
from turnstile.sources import topics
from turnstile.sources.catalog import RefreshingCatalog
from turnstile.sources.decode import decode_expenses, decode_sales, good
from turnstile.streaming.runners import start_pricing, start_result, start_split, without_replays
from workload import views

CHUNKS = 3
_published: dict[tuple[str, str], str] = {}


def publish(spark: SparkSession, sf_dir: str) -> str:
    """Write the two topics once per session and return their folder."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _published:
        root = scratch_path(spark, "topics")
        lo, hi = views.table(spark, sf_dir, "events").select(
            F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
            F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
        files = spark.sparkContext.defaultParallelism
        chunk = F.least(F.floor((F.unix_micros("timestamp") - lo) * CHUNKS / (hi - lo + 1)), F.lit(CHUNKS - 1))
        for name, records in (("sales", topics.encode_sales(views.ticket_sales(spark, sf_dir))),
                              ("expenses", topics.encode_expenses(views.event_expenses(spark, sf_dir)))):
            with scratch_scope(spark):
                chunked = materialise(records.withColumn("chunk", chunk), name)  # joined once, read by each chunk
                for i in range(CHUNKS):
                    topics.write_files(chunked.where(F.col("chunk") == i).repartition(files), f"{root}/{name}")
        _published[known] = root
    return _published[known]


def run(spark: SparkSession, sf_dir: str, name: str, by: str = "key", replayed: bool = False) -> DataFrame:
    """Run result `name` as a stream to the end of the topics; the table it kept, by key or by id.

    `replayed`: every sale arrives twice.
    """
    return UpsertTable(spark, f"{run_to(spark, sf_dir, name, (f'by_{by}',), replayed)}/{name}/by_{by}", by).read()


def run_to(spark: SparkSession, sf_dir: str, name: str, sinks: tuple[str, ...] = ("by_key",), replayed: bool = False) -> str:
    """The folder that a run of result `name` filled."""
    root = publish(spark, sf_dir)
    files = spark.sparkContext.defaultParallelism
    sales = good(decode_sales(topics.stream_files(spark, f"{root}/sales", files_per_batch=files)))
    expenses = good(decode_expenses(topics.stream_files(spark, f"{root}/expenses", files_per_batch=files)))
    if replayed:
        again = good(decode_sales(topics.stream_files(spark, f"{root}/sales", files_per_batch=files)))
        sales = without_replays(sales.unionAll(again))
    out = scratch_path(spark, "streams")
    # State partitions are fixed when a query first starts: one per core is plenty, more only cost commits.
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(usual), files))
    try:
        start_result(name, sales, expenses, out, sinks=sinks, every=None).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    return out


def changes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The updates that a run of result `name` sent, read back from its change records: `key, id, eventName, value` and the micro-batch `b`."""
    sent = spark.read.parquet(f"{run_to(spark, sf_dir, name, ('changes',))}/{name}/changes")
    return from_records(sent.withColumn("key", F.struct("key", "b"))).select("key.*", "id", "eventName", "value")


def split(spark: SparkSession, sf_dir: str) -> str:
    """The altered sales topic read once, in several micro-batches, with good and refused records apart; the folder of the latter."""
    root = scratch_path(spark, "split")
    topics.write_files(views.sales_topic(spark, sf_dir).repartition(4), f"{root}/topic")
    decoded = decode_sales(topics.stream_files(spark, f"{root}/topic", files_per_batch=2))
    start_split(decoded, root, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/good/b={batch}"), every=None).awaitTermination()
    return root


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sales priced as a stream against a catalog that is read again while it runs."""
    root = scratch_path(spark, "priced")
    raw = views.raw_sales(spark, sf_dir)
    files = spark.sparkContext.defaultParallelism
    # Every micro-batch reads the catalog: were their number to grow with the sales, the work would grow with the square of the input.
    raw.repartition(CHUNKS * files).write.parquet(f"{root}/raw")
    catalog = RefreshingCatalog(lambda: views.event_catalog(spark, sf_dir), interval=0.0)
    start_pricing(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/raw"), catalog, root,
                  lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/out/b={batch}"), every=None).awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("b")
