"""Helpers that the operators share: shared storage, batched text mapping and splits by identifier."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts are handed to a task's function in pieces of about so many bytes.
PIECE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine is used in local mode only; on a
    cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/evispark-shared"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for this table; call it once nothing derives from it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_on_key(rows: DataFrame, one: DataFrame, key: str, total: int, share: int = 4096) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column ``n`` (dropped) says how many rows the key has.

    ``total`` is the number of rows. Keys with more than a ``share``-th of them are fewer
    than ``share``, so their side is broadcast and their rows stay where they are; the
    others meet by key. Every row is joined in one of the two ways.
    """
    hot, cold = one.filter(F.col("n") > total / share), one.filter(F.col("n") <= total / share).drop("n")
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot.drop("n")), key).unionByName(apart)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths + 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(
    docs: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Columns computed from the text of each row.

    ``make`` runs once a task and returns a function from a list of texts (None for
    null) to a dict of column values by the names in ``fields``. ``keep`` lists the
    columns carried over; all others are pruned before Python sees them. A kept column
    that has the name of a computed one gives way to it.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in new]
    carried = [c for c in keep if c != text_col]
    narrow = docs.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text_col}`").cast("string").alias("__text"))
    text_type = [T.StructField(text_col, T.StringType())] if text_col in keep else []
    schema = T.StructType([*(narrow.schema[c] for c in carried), *text_type, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    with_text = bool(text_type)

    def run(batches):
        fn = make()
        for batch in batches:
            for piece in pieces(batch, "__text"):
                text = piece.column("__text")
                found = fn(text.to_pylist())
                arrays = [piece.column(c) for c in carried] + [text] * with_text
                arrays += [pa.array(found[f.name], type=t) for f, t in zip(fields, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return narrow.mapInArrow(run, schema)


def filter_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, for whose text the function from ``make`` gives True."""

    def run(batches):
        fn = make()
        for batch in batches:
            for piece in pieces(batch, text_col):
                kept = piece.filter(pa.array(fn(piece.column(text_col).to_pylist()), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def fold(column: str, parts: int) -> F.Column:
    """crc32 of a column's text, modulo ``parts``; null where the column is null."""
    return F.crc32(F.col(column).cast("string")) % parts


def hash_share(column: str, salt: str) -> F.Column:
    """A number from 0 up to 1 by hash, for repeatable samples."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
