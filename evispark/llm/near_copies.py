"""Near copies: SimHash fingerprints compared in bit slices, confirmed by exact Jaccard similarity.

A text's set is that of the 64-bit hashes of its five-word shingles; two texts are
linked where their sets' Jaccard similarity is 0.8 or more. Three steps:

1. Sets meet in a cell where they share one of ``BANDS`` keys of ``ROWS`` minima each. At
   a similarity of exactly 0.8 a pair shares one with probability
   1 - (1 - 0.8^4)^14 = 0.9994, above it more often.
2. Within a cell the sets' SimHash fingerprints stand as bit planes and are compared by
   carry-save counters (``bit_slices``). Pairs beyond ``RADIUS`` bits go no
   further; at a similarity of 0.8 fingerprints differ in about 10 bits of 64, for the
   smallest sets in about 12. Sets that have no partner left in a cell leave it before any
   text is moved.
3. Each pair left is verified on the whole sets, save pairs that are in one component
   already.

Work goes over distinct sets. Groups of the same sets under several keys are compared
once. A group of more than ``cell`` sets is dealt into chunks, and every pair of chunks
is a cell of its own, so no task gets a whole large group; a cell sends on one link a
set at most.

Defined cases: null, empty and blank texts have the empty set and are copies of each
other; a text of up to five words has one shingle; a null identifier takes part in links
but is never the least; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.bit_slices import near_pairs
from evispark.llm.common import join_on_key, map_text, stored
from evispark.llm.components import connected_components

WIDTH, BANDS, ROWS = 5, 14, 4
RADIUS = 24  # bits of 64
SEED = 42
_draw = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
FLIP, FACTOR = _draw[0], _draw[1] | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - min(width, len(words)) + 1 if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def band_keys(found: np.ndarray) -> list[int]:
    """A key a band, of the set's minima under ``ROWS`` orders; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(found), 4096):
        mixed = (found[None, a : a + 4096] ^ FLIP) * FACTOR
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(31))) * FACTOR).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(found: np.ndarray) -> int:
    """SimHash fingerprint of a set of hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(found), 4096):
        ones += np.unpackbits(found[a : a + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def set_keys(docs: DataFrame, keep: list[str], text_col: str = "text", more: bool = False) -> DataFrame:
    """The kept columns and ``fp``, the key of the text's set; with ``more`` its band keys and ``bits``, its fingerprint."""
    fields = [T.StructField("fp", T.LongType())]
    if more:
        fields += [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.LongType())]

    def make():
        def run(texts):
            sets = [shingle_set(t) for t in texts]
            out = {"fp": [_signed(set_key(x)) for x in sets]}
            return out | {"bands": [band_keys(x) for x in sets], "bits": [majority(x) for x in sets]} if more else out

        return run

    return map_text(docs, make, fields, keep, text_col)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more, in whole numbers."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def local_links(keys: list[int], sets: list[np.ndarray], bits: list[int]) -> list[tuple[int, int]]:
    """Links (key, key of its component's root) among the sets of a cell."""
    order = sorted(range(len(keys)), key=lambda i: (len(sets[i]), keys[i]))
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    values = np.array([bits[i] for i in order], dtype=np.int64).view(np.uint64)
    for _, _, x, y in near_pairs(values, np.zeros(len(values), np.int64), RADIUS):
        for i, j in zip(x.tolist(), y.tolist()):
            i, j = order[i], order[j]
            a, b = find(i), find(j)
            if a != b and 5 * len(sets[i]) >= 4 * len(sets[j]) and similar(sets[i], sets[j]):
                root[b] = a
    return [(keys[i], keys[find(i)]) for i in range(len(keys)) if find(i) != i]


def _compare_cells(batches):
    held, cell = {}, None

    def links():
        found = local_links(list(held), [x for x, _ in held.values()], [b for _, b in held.values()])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for fp, bits, of, data in zip(*(batch.column(c) for c in ("fp", "bits", "cell", "text"))):
            if of.as_py() != cell:
                if len(held) > 1:
                    yield links()
                held, cell = {}, of.as_py()
            held[fp.as_py()] = shingle_set(data.as_py()), bits.as_py()
    if len(held) > 1:
        yield links()


def _with_partner(batches):
    """The rows (fp, bits, cell) that lie within the radius of another of their cell; rows come sorted by cell."""
    held = None

    def kept(rows):
        cell, values = rows.column("cell").to_numpy(), rows.column("bits").to_numpy().view(np.uint64)
        partner = np.zeros(len(cell), dtype=bool)
        for _, _, x, y in near_pairs(values, cell, RADIUS):
            partner[x] = partner[y] = True
        return rows.filter(pa.array(partner))

    for batch in batches:
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        cell = rows.column("cell").to_numpy()
        whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
        if whole:
            yield kept(rows.slice(0, whole))
        held = rows.slice(whole)
    if held is not None and held.num_rows:
        yield kept(held)


def near_cells(distinct: DataFrame, cell: int = 256) -> DataFrame:
    """The cells (fp, bits, cell) in which sets that share a band key meet another within the radius; ``distinct`` has fp, bits and bands."""
    keyed = distinct.select("fp", "bits", F.explode("bands").alias("key"))
    hashes = F.sum(F.xxhash64("fp").cast("decimal(38,0)"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), hashes.alias("of")).filter("size > 1")
    groups = sizes.groupBy("size", "of").agg(F.min("key").alias("key"))  # one key of those with the same sets
    groups = groups.select("key", F.col("size").alias("n"), F.ceil(F.col("size") / F.lit(cell)).cast("int").alias("chunks"))
    dealt = (
        join_on_key(keyed, groups, "key", BANDS * distinct.count())
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "bits", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_with_partner, "fp long, bits long, cell long")


def near_links(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) with the components of all verified candidate pairs; ``texts`` has one text (fp, text) of each set in the cells."""
    spread = cells.join(texts, "fp").select("fp", "bits", "cell", "text").repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(_compare_cells, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier, ``fp``, ``component`` (its least key) and ``component_id``: the least identifier reachable over links.

    Texts whose set shares no key with another are never moved; of the others one a set is.
    """
    rows = stored(set_keys(docs, [id_col], text_col, more=True), "set-keys")
    distinct = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.min("bands").alias("bands"), F.min("bits").alias("bits"), F.count("*").alias("n")), "distinct-sets")
    cells = stored(near_cells(distinct), "cells")
    due = cells.select("fp").distinct().join(distinct.select("fp", F.col("least_id").alias("__least")), "fp")
    texts = set_keys(docs, [id_col, text_col], text_col).join(due, "fp").filter(F.col(id_col).eqNullSafe(F.col("__least")))
    one = stored(texts.groupBy("fp").agg(F.first(text_col).alias("text")), "texts")
    grouped = connected_components(near_links(cells, one))
    member = distinct.select("fp", "n", "least_id").join(grouped.withColumnRenamed("node", "fp"), "fp", "left")
    member = member.withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = stored(member.join(least, "component").select("fp", "n", "component", "component_id"), "set-components")
    return join_on_key(rows.select(id_col, "fp"), of, "fp", rows.count())
