"""Merges into stored tables of vertices and edges, with counters taken by the write job itself."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Counters:
    """What one write did: rows that are new, rows of which a property changed, and property values set."""

    created: int
    updated: int
    properties_set: int


def merge_write(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], partition: str) -> Counters:
    """Upsert ``changes`` by their keys into the Parquet table at ``path``, partitioned by ``partition``, and count.

    A null property leaves the stored value; of several changes of a key the last in the
    order of its properties is taken. ``partition`` belongs to the keys. Only partitions
    that changes touch are read and written: rows are joined with those partitions' rows,
    and dynamic partition overwrite puts the result in their place when the job commits,
    so a failed write leaves the table as it was. The counters are observed by the job
    that writes: no second pass, and no count that a retried task could double.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys {', '.join(keys)}")
    if changes.isEmpty():
        return Counters(0, 0, 0)
    properties = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*properties)).alias("new")) if properties else changes.select(*keys).distinct().withColumn("new", F.struct(F.lit(1)))
    last = last.withColumn("__there", F.lit(True))
    stored = _read(spark, path, changes)
    touched = stored.join(changes.select(partition).distinct(), partition, "left_semi")
    old = touched.select(*keys, F.struct(*(F.col(c) for c in properties or keys)).alias("old"))
    both = old.join(last, list(keys), "full_outer")
    created, changed = F.col("old").isNull(), F.lit(0)
    for c in properties:
        changed = changed + F.when(F.col(f"new.{c}").isNotNull() & ~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")), 1).otherwise(0)
    rows = both.withColumns({"__created": created & F.col("__there"), "__set": F.when(F.col("__there"), changed).otherwise(0)})
    seen = Observation()
    rows = rows.observe(
        seen, F.count_if("__created").alias("created"), F.count_if(~F.col("__created") & (F.col("__set") > 0)).alias("updated"), F.coalesce(F.sum("__set"), F.lit(0)).alias("properties_set")
    )
    out = rows.select(*keys, *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in properties))
    columns = [c for c in out.columns if c != partition] + [partition]
    out.select(columns).repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    found = seen.get
    return Counters(found["created"] or 0, found["updated"] or 0, found["properties_set"] or 0)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table, or none of its rows where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(like.schema).parquet(path).select(like.columns)
    return spark.createDataFrame([], like.schema)
