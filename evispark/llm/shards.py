"""Documents dealt into shards of bounded size, stored once, to which each pass brings small tables.

A shard is a share of the rows with about as many bytes of text as asked. The table is
bucketed by shard, so a pass that cogroups it with another table by shard moves only the
other one: the texts are shuffled once, whatever the number of passes. Rows are dealt in
turn, so no key and no group of copies can fill a shard; a row longer than a shard has a
larger one. What a shard reports of its rows it adds up first, so a key of such reports
never has more rows than there are shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import shared_path


def sharded(docs: DataFrame, columns: list[Column], text: Column, shard_bytes: int) -> DataFrame:
    """The columns, ``text`` (null: empty), ``row`` (unique) and ``shard`` of all rows, stored in the shared folder.

    The table is registered in the session's catalog, as bucketing is known there only.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text.cast("string")))).first()[0] or 0
    shards = max(1, ceil(total / shard_bytes))
    own = F.monotonically_increasing_id()
    rows = docs.select(*columns, F.coalesce(text.cast("string"), F.lit("")).alias("text"), own.alias("row"), F.pmod(own, F.lit(shards)).cast("int").alias("shard"))
    name = f"evispark_shards_{uuid.uuid4().hex}"
    written = rows.repartition(shards, "shard").write.bucketBy(shards, "shard").option("compression", "zstd").option("path", shared_path(spark, "shards"))
    written.saveAsTable(name)
    freed(spark)
    return spark.table(name)


def with_side(rows: DataFrame, side: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each shard's rows and of those of the side table that carry its number; both have a column ``shard``."""
    return rows.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(fn, schema)


def per_shard(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of each shard's rows."""
    return rows.groupBy("shard").applyInArrow(fn, schema)


def freed(spark) -> None:
    """Let Spark delete the shuffle files of jobs that are over, which it does once their plans are collected as garbage.

    The session keeps the last plan, so an empty one takes its place first.
    """
    spark.range(1).count()
    spark._jvm.System.gc()


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)


def texts(table: pa.Table, column: str = "text"):
    """The texts as UTF-8 bytes, one after the other."""
    for chunk in table.column(column).chunks:
        yield from (x.as_buffer().to_pybytes() for x in chunk.cast(pa.binary()))
