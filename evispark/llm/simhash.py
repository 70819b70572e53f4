"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit for each bit position that more than half of the hashes of the
text's three-word shingles set. Two fingerprints are linked when at most three bits
differ. Work goes over distinct fingerprints, so exact copies cost nothing.

Candidates: the 64 bits are cut into five blocks; two fingerprints within three bits
agree on two blocks at least, so each fingerprint is keyed by each of the ten pairs of
blocks, and keys that only one fingerprint has are dropped by a join with their counts.
A key with more fingerprints than ``cell`` is dealt into chunks, and every pair of
chunks is a cell of its own, so no task gets a whole large group. Within a cell the
fingerprints stand as bit planes and are compared as ``bit_slices`` says: carry-save
counters, and a fingerprint's block is abandoned once all its lanes have passed the radius.
A cell sends on at most one link a fingerprint (to the least of its local component),
never all pairs.

Defined cases: a null, empty or blank text has no words and fingerprint zero, linked like
any other; a text of one or two words has one shingle; repeated rows share a component;
a fingerprint that many rows share takes no task to itself; a null identifier takes part in links but is never the least; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm import near_copies
from evispark.llm.bit_slices import near_pairs
from evispark.llm.common import join_on_key, map_text, read_table, stored
from evispark.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SEED, RADIUS = 42, 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and width
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[a : a + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns and ``fp``: the fingerprint's bits as a signed long."""

    def make():
        def run(texts):
            return {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

        return run

    return map_text(docs, make, [T.StructField("fp", T.LongType())], keep, text_col)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, from links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = np.minimum(new, new[new])
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def local_links(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, least value of its local component) among values of equal group; ``group`` is sorted."""
    n = len(values)
    label = np.arange(n)
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    for a, b, x, y in near_pairs(values, group, radius):
        live = label[x] != label[y]
        if live.any():
            own = np.arange(a, b)
            label[a:b] = a + _least_labels(b - a, np.concatenate([own, x[live]]) - a, np.concatenate([label[a:b], y[live]]) - a)
    linked = label != np.arange(n)
    return values[linked], values[label[linked]]


def near_links(distinct: DataFrame, cell: int = 4096, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within the radius.

    ``distinct`` has one row a fingerprint, in column ``fp``. The five blocks find all
    pairs within three bits, so a greater radius is refused.
    """
    if not 0 <= radius <= len(BLOCKS) - 2:
        raise ValueError(f"blocks find pairs within {len(BLOCKS) - 2} bits")
    keys = F.array(*[_pair_key(i, x, y) for i, (x, y) in enumerate(PAIRS)])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    chunks = F.ceil(F.col("size") / F.lit(cell)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        join_on_key(keyed, sizes, "key", len(PAIRS) * distinct.count())
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .withColumn("cell", F.xxhash64("key", "i", "j"))
        .select("fp", "cell")
    )
    spread = dealt.repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(_compare_cells(radius), "a long, b long").distinct()


def _pair_key(number: int, x: int, y: int) -> F.Column:
    """The pair's number and the bits of its two blocks, in one long."""
    cut = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
    (fx, wx), (fy, wy) = BLOCKS[x], BLOCKS[y]
    return F.shiftleft(F.lit(number).cast("long"), 40).bitwiseOR(F.shiftleft(cut(fx, wx), 13)).bitwiseOR(cut(fy, wy))


def _compare_cells(radius: int):
    def run(batches):
        held_fp, held_cell = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(fp, cell):
            a, b = local_links(fp.view(np.uint64), cell, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            cell = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if whole:
                yield links(fp[:whole], cell[:whole])
            held_fp, held_cell = fp[whole:], cell[whole:]
        if len(held_fp):
            yield links(held_fp, held_cell)

    return run


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept columns, ``fp``, ``component`` (its least fingerprint), and ``component_id``: the least identifier reachable over links."""
    keep = [id_col] if keep is None else keep
    rows = stored(fingerprints(docs, keep, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    grouped = connected_components(near_links(distinct))
    member = distinct.join(grouped.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = member.join(least, "component").select("fp", "component", F.col("component_id").alias("linked_id"))
    own = F.when(F.col("component").isNull(), F.col("least_id")).otherwise(F.col("linked_id"))
    by_fp = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), own.alias("component_id"))
    return join_on_key(rows, stored(by_fp, "fingerprint-components"), "fp", rows.count())


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the least identifier.

    Near copies are those of ``near_copies``: a Jaccard similarity of 0.8 or more of
    five-word shingles, by bit-sliced comparison of five-word fingerprints and an exact
    check.
    Texts stay where they are: identifiers that occur once are kept by a semi-join with
    the components' least identifiers. Only rows whose identifier is null or repeated are
    compared by their content.
    """
    rows = stored(near_copies.near_copies(docs.select(id_col, text_col), id_col, text_col), "near-copies")
    repeated = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    winners = rows.filter(F.col(id_col) == F.col("component_id")).select(id_col)
    single = docs.join(winners.join(repeated, id_col, "left_anti"), id_col, "left_semi")
    odd = docs.filter(F.col(id_col).isNull()).unionByName(docs.join(repeated, id_col, "left_semi").select(docs.columns))
    of = rows.select(F.col("fp").alias("__fp"), F.col("component").alias("__component"), F.col("component_id").alias("__least")).distinct()
    marked = near_copies.set_keys(odd.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("text")), ["__row"])
    due = marked.withColumnRenamed("fp", "__fp").join(of, "__fp").filter(F.col(f"__row.{id_col}").eqNullSafe(F.col("__least")))
    order = F.struct(F.xxhash64(f"__row.{text_col}"), F.sha2(F.to_json("__row"), 256))  # rows with map columns have no order of their own
    one = due.groupBy("__component").agg(F.min_by("__row", order).alias("x")).select("x.*")
    return single.select(docs.columns).unionByName(one.select(docs.columns))


def op6_simhash(spark, sf_dir) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
