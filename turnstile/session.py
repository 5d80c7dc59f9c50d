"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `extra` entries use `__` for the dots of a setting name."""
    builder = SparkSession.builder.appName("turnstile")
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else built (all of them can change at run time)."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a temporary one in local mode if it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="turnstile-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/turnstile/{label}-{uuid.uuid4().hex}"


_scopes = threading.local()  # one stack per thread: queries run their micro-batches side by side


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size of the table.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_parts(parts: Iterable[DataFrame], label: str, outlives: bool = False, **options: object) -> DataFrame:
    """Write tables of the same columns (one at least) one after the other into one, and read it back.

    Each is made only when the one before is written, and what that one shuffled is deleted first: the disk holds the shuffles of one part.
    If it `outlives` the present scope, it belongs to the one around that. `options` are those of the writer.
    """
    path, spark, schema = None, None, None
    for part in parts:
        if path is None:
            spark, schema = part.sparkSession, part.schema
            path = scratch_path(spark, label)
            if len(stack := getattr(_scopes, "stack", [])) > outlives:
                stack[-1 - outlives].append(path)
        with _shuffles_deleted(spark):
            part.write.mode("append").option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries started inside go when the query ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is materialised inside on leaving: a long-running stream must not fill the folder."""
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    _scopes.stack.append([])
    try:
        yield
    finally:
        for path in _scopes.stack.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def side_by_side(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run jobs that don't depend on one another at once; their results in order. What they materialise belongs to the caller's scopes."""
    stack = getattr(_scopes, "stack", None)

    def scoped(job: Callable[[], object]) -> Callable[[], object]:
        def run() -> object:
            if stack is not None:
                _scopes.stack = stack
            return job()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(scoped(job)) for job in jobs]]
