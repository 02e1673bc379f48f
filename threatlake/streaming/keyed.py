"""Keyed tables that micro-batches read by the buckets of their own keys and write by batch.

A table is a folder per batch with a folder per bucket of the key's hash. A micro-batch asks for its keys and scans
only the buckets they fall into, by partition pruning, however many keys are stored. It sees earlier batches only
and replaces its own folder, so a replayed batch reads and writes what it did before. ``compact`` merges finished
batches into one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Batch number of what was there before the stream began.
SEED = -1


@dataclass(frozen=True)
class KeyedTable:
    """``schema``: the stored columns, among them ``key``. ``buckets`` is fixed for the life of the table."""

    path: str
    key: str
    schema: T.StructType
    buckets: int = 256

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch, in place of any that an earlier run of it left. One file per bucket and task that has
        rows of it; a bucket is dealt to one task, and holds no key twice unless ``rows`` does."""
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket(F.col(self.key)))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch_id={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with ``batch_id`` and ``bucket``."""
        whole = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return spark.read.schema(whole).option("basePath", self.path).parquet(self.path)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most ``buckets`` numbers come to the driver."""
        known = keys.where(F.col(self.key).isNotNull())
        return sorted(r[0] for r in known.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """Stored rows of the buckets that ``keys`` fall into, from batches before ``before``. Other buckets are not read."""
        rows = self.read(keys.sparkSession)
        return rows.where(F.col("bucket").isin(self.buckets_of(keys)) & (F.col("batch_id") < before))

    def compact(self, spark: SparkSession, to: KeyedTable, upto: int, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write the rows of batches up to ``upto``, merged, as the seed of ``to``, and the later batches as they are.
        The stream goes on with ``to`` when it is started anew."""
        rows = self.read(spark)
        to.write(merge(rows.where(F.col("batch_id") <= upto)), SEED)
        later = [r[0] for r in rows.where(F.col("batch_id") > upto).select("batch_id").distinct().collect()]
        for batch in later:
            to.write(rows.where(F.col("batch_id") == batch), batch)
