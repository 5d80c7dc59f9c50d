"""The event catalog: cities and events, their listings, their snapshots, and reading result tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.plans.results import RESULTS
from turnstile.schemas import CITIES, EVENTS
from turnstile.session import scratch_path
from turnstile.sinks.tables import SnapshotTable, UpsertTable, delete

# The catalog a new installation starts with.
SEED_CITIES = ["Aveiro", "Porto", "Lisboa", "Coimbra", "Braga"]
SEED_EVENTS = [
    ("E1", "Tech Conference 2026", "Aveiro", "Technology", Decimal("40.00")),
    ("E2", "Rock Festival", "Porto", "Music", Decimal("55.00")),
    ("E3", "Football Match", "Lisboa", "Sports", Decimal("30.00")),
    ("E4", "Comedy Night", "Coimbra", "Entertainment", Decimal("25.00")),
    ("E5", "Jazz Festival", "Braga", "Music", Decimal("35.00")),
]


def seed_cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEED_CITIES, 1)), CITIES)


def seed_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_EVENTS, EVENTS)


def list_cities(cities: DataFrame) -> DataFrame:
    return cities.select(F.col("city_id").alias("cityId"), F.col("city_name").alias("cityName")).orderBy("cityId")


def list_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("eventId"), F.col("event_name").alias("eventName"), "city", "category",
        F.col("base_ticket_price").alias("baseTicketPrice")).orderBy("eventId")


def read_result(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The stored table of result `name` under `root`: `id, eventName, value`, ordered by id."""
    if name not in RESULTS:
        raise ValueError(f"could not read table {name}: known results are {', '.join(RESULTS)}")
    table = UpsertTable(spark, f"{root}/{name}/by_id", "id").read()
    if table is None:
        raise ValueError(f"could not read table {name}: confirm that its sink has already written it")
    return table.select("id", "eventName", "value").orderBy("id")


def append_snapshot(catalog: DataFrame, path: str, taken_at: str) -> None:
    """One full copy of the catalog, tagged with the time it was taken (a bulk poll)."""
    catalog.withColumn("snapshot_ts", F.lit(taken_at).cast("timestamp")).write \
        .mode("append").partitionBy("snapshot_ts").parquet(path)


class RefreshingCatalog:
    """A catalog that is read again every `interval` seconds; an empty reload keeps the previous one.

    Streams may share one: a reload reads the source once, into a copy, while the others wait.
    """

    def __init__(self, read: Callable[[], DataFrame], interval: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self._read, self._interval, self._clock = read, interval, clock
        self._copies: SnapshotTable | None = None
        self._reads, self._read_at = 0, 0.0
        self._lock = threading.Lock()

    def current(self) -> DataFrame:
        with self._lock:
            if self._copies is None or self._clock() - self._read_at >= self._interval:
                self._reload(self._read())
            return self._copies.read()

    def _reload(self, fresh: DataFrame) -> None:
        if self._copies is None:
            self._copies = SnapshotTable(fresh.sparkSession, scratch_path(fresh.sparkSession, "catalog"))
        self._read_at = self._clock()
        # A copy, so that the catalog in hand stays whole when its source is emptied, and the one judged is the one kept.
        self._copies.write(fresh, self._reads)
        if self._reads and self._copies.read().isEmpty():
            delete(fresh.sparkSession, f"{self._copies.path}/v={self._reads}")
        else:
            self._reads += 1
