"""Tables on shared storage, kept by version: whole snapshots, and upsert tables that write only what changed.

The version is the micro-batch id. A batch reads the version before its own and writes its own, so a replayed batch
gives the same table. Readers take the newest complete version. A query that starts anew over an old folder counts from
0 again, so a write removes the versions ahead of it: they are of an earlier run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET_BYTES = 64 << 20

_BUCKET = "bucket_of_"  # and how many there are: the column by which a whole table lies in folders


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def versions(self, kind: str = "v") -> list[int]:
        """Complete versions, oldest first."""
        folder, fs = hadoop_path(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [n for n in numbers if fs.exists(hadoop_path(self.spark, f"{self.path}/{kind}={n}/_SUCCESS")[0])]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest one before version `before`; None if there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        found = self.versions()
        for old in [v for v in found if v < version][:-self.keep] + [v for v in found if v > version]:
            delete(self.spark, f"{self.path}/v={old}")


class UpsertTable(SnapshotTable):
    """A table with one row per value of `keys`; each batch replaces the rows whose keys it brings.

    A batch writes its own rows to `change=<version>`, whatever the size of the table. Every `fold_every` versions, and after a batch that
    is larger than the table was, the table is also written whole, to `v=<version>`; a reader takes the newest whole one and the changes after
    it, so `fold_every` weighs writing against reading and has no effect on what is read.

    A whole table of more than `bucket_bytes` lies in buckets by a hash of the keys, about so large each: their number grows with the table.
    `read(touching=rows)` opens the buckets with the keys of `rows` only.
    """

    def __init__(self, spark: SparkSession, path: str, *keys: str, keep: int = 5, fold_every: int = 20, bucket_bytes: int = BUCKET_BYTES):
        super().__init__(spark, path, keep)
        self.keys, self.fold_every, self.bucket_bytes = keys, fold_every, bucket_bytes

    def read(self, before: int | None = None, touching: DataFrame | None = None) -> DataFrame | None:
        """The table, as it was before version `before`. With `touching`, rows that have the key columns: at least the rows of their keys."""
        snapshots, changes = ([v for v in self.versions(kind) if before is None or v < before] for kind in ("v", "change"))
        whole = self._whole(snapshots[-1], touching) if snapshots else None
        later = [v for v in changes if not snapshots or v > snapshots[-1]]
        if not later:
            return whole
        rows = self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/change={v}" for v in later))
        columns = [c for c in rows.columns if c != "change"]
        if whole is not None:
            rows = rows.unionByName(whole.withColumn("change", F.lit(snapshots[-1])))
        return self._last(rows, columns, "change")

    def merge(self, batch: DataFrame, version: int, order: str | None = "pos") -> DataFrame:
        """Write the batch's last row per key by `order` (None: it has one row per key). Returns the rows written."""
        path = f"{self.path}/change={version}"
        (self._last(batch, batch.columns, order) if order else batch).write.mode("overwrite").parquet(path)
        for kind in ("v", "change"):
            for ahead in [v for v in self.versions(kind) if v > version]:
                delete(self.spark, f"{self.path}/{kind}={ahead}")
        delete(self.spark, f"{self.path}/v={version}")  # of an earlier attempt
        self._fold(version)
        base = max((v for v in self.versions() if v <= version - self.keep), default=-1)
        for kind, old in (("v", base - 1), ("change", base)):
            for gone in [v for v in self.versions(kind) if v <= old]:
                delete(self.spark, f"{self.path}/{kind}={gone}")
        return self.spark.read.schema(batch.schema).parquet(path)

    def _fold(self, version: int) -> None:
        """Write the table whole, if it is time."""
        snapshots = self.versions()[-1:]
        held = sum(self._bytes("v", v) for v in snapshots)
        if (version + 1) % self.fold_every and self._bytes("change", version) <= max(held, self.bucket_bytes):
            return
        size = held + sum(self._bytes("change", v) for v in self.versions("change") if v > max(snapshots, default=-1))
        buckets = 1 << max(0, -(-size // self.bucket_bytes) - 1).bit_length()
        rows, path = self.read(before=version + 1), f"{self.path}/v={version}"
        if buckets == 1:
            rows.write.parquet(path)
            return
        column = f"{_BUCKET}{buckets}"
        rows.withColumn(column, self._bucket(rows.schema, buckets)).repartition(column).write.partitionBy(column).parquet(path)

    def _whole(self, version: int, touching: DataFrame | None) -> DataFrame:
        path = f"{self.path}/v={version}"
        folder, fs = hadoop_path(self.spark, path)
        buckets = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(folder)) if n.startswith(_BUCKET))
        if not buckets:
            return self.spark.read.parquet(path)
        schema = self.spark.read.parquet(f"{path}/{buckets[0]}").schema
        if touching is not None:  # at most as many numbers as there are buckets
            column = buckets[0].split("=")[0]
            numbers = touching.select(self._bucket(schema, int(column.removeprefix(_BUCKET)))).distinct().collect()
            buckets = sorted({f"{column}={n}" for n, in numbers}.intersection(buckets))
            if not buckets:
                return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{path}/{b}" for b in buckets))

    def _bucket(self, schema: StructType, buckets: int) -> Column:
        """The bucket of a row's keys, taken as the types that the table has."""
        keys = [F.col(k).cast(schema[k].dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _bytes(self, kind: str, version: int) -> int:
        folder, fs = hadoop_path(self.spark, f"{self.path}/{kind}={version}")
        return fs.getContentSummary(folder).getLength()

    def _last(self, rows: DataFrame, columns: list[str], order: str) -> DataFrame:
        values = [c for c in columns if c not in self.keys]
        last = F.max_by(F.struct(*values), order).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*").select(*columns)


def hadoop_path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    folder, fs = hadoop_path(spark, path)
    fs.delete(folder, True)
