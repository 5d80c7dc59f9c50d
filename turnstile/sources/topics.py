"""Record topics: Kafka, or a folder of parquet / JSON files with the same columns. Batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.schemas import EXPENSE_FIELDS, SALE_FIELDS, TOPIC


def kafka_options(servers: str, topic: str, starting: str = "earliest", **extra: str) -> dict[str, str]:
    """Options of a Kafka read. `extra` takes e.g. maxOffsetsPerTrigger, or minPartitions to split big partitions."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, **extra}


def read_kafka(spark: SparkSession, servers: str, topic: str, **extra: str) -> DataFrame:
    return _text(spark.read.format("kafka").options(**kafka_options(servers, topic, **extra)).load())


def stream_kafka(spark: SparkSession, servers: str, topic: str, **extra: str) -> DataFrame:
    return _text(spark.readStream.format("kafka").options(**kafka_options(servers, topic, **extra)).load())


def _text(records: DataFrame) -> DataFrame:
    return records.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "partition", "offset")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TOPIC).format(fmt).load(path)


def stream_files(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder topic as a stream; files are taken oldest first."""
    reader = spark.readStream.schema(TOPIC).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_files(records: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    records.select(*TOPIC.names).write.mode(mode).format(fmt).save(path)


def encode_sales(sales: DataFrame, partitions: int = 8) -> DataFrame:
    """Decoded sales as topic records, keyed as they are; `seq` becomes the offset."""
    return _encode(sales, SALE_FIELDS, partitions)


def encode_expenses(expenses: DataFrame, partitions: int = 8) -> DataFrame:
    return _encode(expenses, EXPENSE_FIELDS, partitions)


def _encode(rows: DataFrame, fields: dict, partitions: int) -> DataFrame:
    payload = F.to_json(F.struct(*(F.col(column).alias(name) for name, (column, _) in fields.items())))
    return rows.select(
        "key", payload.alias("value"), F.col("ts").alias("timestamp"),
        F.pmod(F.hash("key"), F.lit(partitions)).alias("partition"), F.col("seq").alias("offset"))
