"""A stream of records that keeps each key's newest version and says what it takes back.

A batch's rows meet the stored version of their key. A newer one is sent on as an
``assert`` row, after a ``retract`` row with what it replaces; older and repeated versions
send nothing. So the sum of all changes is the table of newest versions, whatever the
order of arrival, and tables made from the changes can take rows back.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Holds one version a key; the greatest by ``versions`` and then by the other columns, nulls first, is the newest."""

    def __init__(self, columns: list[str], versions: list[str], held: StructType):
        self.columns, self.held = columns, held
        self.order = [columns.index(c) for c in [*versions, *(c for c in columns if c not in versions)]]
        self.whole = [i for i, f in enumerate(held.fields) if isinstance(f.dataType, IntegralType)]

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", self.held)

    def _rank(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.order)

    def _rows(self, frame: pd.DataFrame):
        clean = frame[self.columns].astype(object)
        for row in clean.where(clean.notna(), None).itertuples(index=False, name=None):
            row = list(row)
            for i in self.whole:  # a column with nulls comes as floating-point numbers
                row[i] = None if row[i] is None else int(row[i])
            yield tuple(row)

    def handleInputRows(self, key, rows, timer_values):
        old = tuple(self.newest.get()) if self.newest.exists() else None
        best = max([*([old] if old is not None else []), *(row for frame in rows for row in self._rows(frame))], key=self._rank)
        if best != old:
            self.newest.update(best)
            found = ([("retract", *old)] if old is not None else []) + [("assert", *best)]
            yield pd.DataFrame(found, columns=["change", *self.columns], dtype=object)

    def close(self) -> None:
        pass


def newest_changes(records: DataFrame, key: str, versions: Sequence[str]) -> DataFrame:
    """(change, columns of ``records``) from a stream; rows without a key are left out.

    Columns are strings, numbers or truth values; whole numbers beyond 2^53 lose their last
    digits in a batch that has nulls in their column. State is kept in the store that holds
    large states on disk, which the session is told to use.
    """
    records.sparkSession.conf.set(PROVIDER, ROCKS)
    schema = StructType([StructField("change", StringType()), *records.schema.fields])
    keyed = records.filter(F.col(key).isNotNull()).groupBy(key)
    return keyed.transformWithStateInPandas(Newest(records.columns, list(versions), StructType(records.schema.fields)), schema, "Append", "None")


def ingest_newest(records: DataFrame, key: str, versions: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of what is there when it starts, a folder a batch, and stops; a repeated batch replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return newest_changes(records, key, versions).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The table that all changes add up to: assertions that weren't taken back."""
    changes = spark.read.parquet(out).drop("batch")
    rest = [c for c in changes.columns if c != "change"]
    weight = F.sum(F.when(F.col("change") == "assert", 1).otherwise(-1))
    return changes.groupBy(*rest).agg(weight.alias("n")).filter("n > 0").drop("n")
