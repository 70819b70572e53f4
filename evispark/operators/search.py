"""Vector search, hybrid search, relevance-ranked text search and similarity joins."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 8192  # vectors of a cell, and queries of a block
AT_ONCE = 64  # queries whose cosines with a block are held at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(dot(F.col(column), F.col(column))))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    return F.when((norm_a == 0) | (norm_b == 0), 0.0).otherwise(dot(a, b) / (norm_a * norm_b))


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix, each scaled to a norm of 1, or 0 where it is 0."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm != 0)


def _best(cosine: np.ndarray, order: np.ndarray, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of cosines the places of its k best and their rounded values; equal ones by ``order``."""
    cosine[np.isnan(cosine)] = np.inf  # not-a-number is above all, as Spark sorts it
    n = cosine.shape[1]
    # rounding can't lift a cosine over one that is more than a digit of the sixth place above it
    bound = np.partition(cosine, n - k, axis=1)[:, n - k] - 2e-6 if k < n else np.full(len(cosine), -np.inf)
    out = []
    for row, low in zip(cosine, np.maximum(bound, least - 1e-6)):
        at = np.flatnonzero(row >= low)
        value = np.copysign(np.floor(np.abs(row[at]) * 1e6 + 0.5), row[at]) / 1e6 + 0.0
        kept = value >= least
        at, value = at[kept], value[kept]
        first = np.lexsort((order[at], -value))[:k]
        out.append((at[first], np.where(np.isinf(value[first]), np.nan, value[first])))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, others: bool = False) -> DataFrame:
    """The ``k`` nearest vectors of each query: (query_id, vec_id, similarity, place) and the other columns of both.

    Every vector of ``vectors`` (vec_id, embedding) meets every query (query_id, query).
    Vectors are dealt into cells and queries into blocks of bounded size; a cell and a block
    give a product of matrices in one task, and of that only the k best of each query are
    shuffled. The work is that of all pairs; what moves is a row for each query, cell and
    place, each vector once a block and each query once a cell. Similarities are rounded to
    six digits, and 0 where a norm is 0. ``others`` leaves out a query's own identifier.
    Rows without a vector, or with a null in it, have no similarity.
    """
    clean = lambda df, c: df.filter(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())).withColumn("__dims", F.size(c))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = vectors.count()
    cells, blocks = max(1, ceil(n / CELL), min(cores, ceil(n / 512))), max(1, ceil(queries.count() / CELL))
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    v = clean(vectors.drop("norm"), "embedding").withColumn("__cell", dealt("vec_id", cells)).withColumn("__block", every(blocks))
    q = clean(queries.drop("query_norm"), "query").withColumn("__block", dealt("query_id", blocks)).withColumn("__cell", every(cells))
    keys, tasks = ["__cell", "__block", "__dims"], min(cells * blocks, 16 * cores)
    if others:
        v, q = v.filter("vec_id IS NOT NULL"), q.filter("query_id IS NOT NULL")
    inner = {"embedding", "query", *keys}
    q_columns, v_columns = [c for c in q.columns if c not in inner], [c for c in v.columns if c not in inner]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for df, columns in ((q, q_columns), (v, v_columns)) for c in columns]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        who, which, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            x, y = _unit(left.column("query").combine_chunks()), _unit(right.column("embedding").combine_chunks())
            ids = right.column("vec_id").combine_chunks()
            order = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy()
            own, asked = ({}, []) if not others else (ids.to_pandas().groupby(ids.to_pandas()).indices, left.column("query_id").to_pylist())
            for a in range(0, len(x), AT_ONCE):
                cosine = x[a : a + AT_ONCE] @ y.T
                for i, (at, value) in enumerate(_best(cosine, order, k + max(map(len, own.values()), default=0) if others else k, least)):
                    if others:
                        kept = ~np.isin(at, own.get(asked[a + i], []))
                        at, value = at[kept][:k], value[kept][:k]
                    who.append(np.full(len(at), a + i))
                    which.append(at)
                    values.append(value)
        who, which = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
        return pa.table([*(left.column(c).take(who) for c in q_columns), *(right.column(c).take(which) for c in v_columns), pa.array(np.concatenate(values))], names=[*q_columns, *v_columns, "similarity"])

    met = q.repartition(tasks, *keys).groupBy(*keys).cogroup(v.repartition(tasks, *keys).groupBy(*keys))
    scored = met.applyInArrow(compare, ", ".join([*fields, "similarity double"]))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def rescaled(similarity: Column) -> Column:
    """A store's cosine score, from 0 to 1."""
    return (1 + similarity) / 2


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    Texts are split once. Terms that no query has count towards a document's length only:
    they become one row a document in the partial counts, before any shuffle. Statistics,
    document frequencies and scores all read that one small shuffle again.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    vocabulary = wanted.select("term", F.col("term").alias("known")).distinct()
    split = docs.select("doc_id", F.explode_outer(tokens("text")).alias("term")).join(vocabulary, "term", "left")
    counts = split.groupBy("doc_id", "known").agg(F.count("term").alias("tf"))
    lengths = counts.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    tf = counts.filter("known IS NOT NULL").withColumnRenamed("known", "term")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = wanted.join(tf.join(lengths, "doc_id"), "term").join(df, "term").crossJoin(F.broadcast(stats)).withColumn("part", part)
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")


def weighted_overlap(factors: dict[str, float]) -> Column:
    """Sum of weighted Jaccard similarities of a.<name> and b.<name>; a factor counts only when both sets have members."""
    out = F.lit(0.0)
    for name, w in factors.items():
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        out = out + F.when((F.size(a) > 0) & (F.size(b) > 0), w * jaccard(a, b)).otherwise(0.0)
    return out


def prefix_keys(least: float, most_pairs: int = 64) -> Column:
    """Keys on which sets (``items`` from rare to common, ``n`` of them) of a similarity of ``least`` or more meet; see ``similarity_join``."""
    # a hair's breadth of slack: the product may round to just above a whole number
    needed = F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int")
    front = lambda k: F.slice("items", F.lit(1), F.least(F.col("n"), F.col("n") - needed + k))
    ones = F.transform(front(1), lambda x: x.cast("string"))
    two = F.flatten(F.transform(front(2), lambda x, i: F.transform(F.slice(front(2), i + 2, F.size(front(2))), lambda y: F.concat_ws("|", x.cast("string"), y.cast("string")))))
    small, large = F.col("n") <= 1 / least**2 + 1e-9, F.col("n") > most_pairs * least
    none = F.array().cast("array<string>")
    return F.concat(F.when(small | large, ones).otherwise(none), F.when((needed >= 2) & (F.col("n") <= most_pairs), two).otherwise(none))


def similarity_join(sets: DataFrame, key: str, element: str, least: float, most_pairs: int = 64) -> DataFrame:
    """Pairs of keys whose element sets have a Jaccard similarity of ``least`` or more, by prefix filtering.

    ``sets`` has a row for each (key, element). Elements are ordered from rare to common.
    A set of n elements shares t = ceil(least * n) of them at least with any similar one,
    so two similar sets have one of their first n - t + 1 elements in common, and, if both
    need two, two of their first n - t + 2. Sets of up to ``most_pairs`` elements meet on
    such twos, which are much rarer than single elements; very small and large sets, and
    those that may be similar to them, meet on ones. Keys with equal sets are joined once:
    as one class, with the number of its members.
    """
    rows = sets.select(key, element).distinct()
    frequency = rows.groupBy(element).agg(F.count("*").alias("__df"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__df", F.col(element)))), lambda x: x[element])
    whole = rows.join(frequency, element).groupBy(key).agg(ordered.alias("items"))
    classes = whole.groupBy("items").agg(F.min(key).alias("id"), F.count("*").alias("n_members")).withColumn("n", F.size("items"))
    # identifiers and keys alone meet; sets are joined to the distinct candidates afterwards
    met = classes.select("id", "n", F.explode(prefix_keys(least, most_pairs)).alias("e"))
    a, b = met.alias("a"), met.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & (F.col("b.n") >= least * F.col("a.n")) & (F.col("a.n") >= least * F.col("b.n"))
    pairs = a.join(b, (F.col("a.e") == F.col("b.e")) & fits).select(F.col("a.id").alias("first"), F.col("b.id").alias("second")).distinct()
    side = lambda name, of: classes.select(F.col("id").alias(name), F.col("items").alias(f"items_{of}"), F.col("n").alias(f"size_{of}"), F.col("n_members").alias(f"n_{name}"))
    whole = pairs.join(side("first", "a"), "first").join(side("second", "b"), "second")
    common = F.size(F.array_intersect("items_a", "items_b"))
    similarity = common / (F.col("size_a") + F.col("size_b") - common).cast("double")
    found = whole.select("first", "second", "n_first", "n_second", similarity.alias("similarity"))
    return found.filter(F.col("similarity") >= least).withColumn("similarity", F.round("similarity", 6))


def nearest_cached(entries: DataFrame, probes: DataFrame, least: float) -> DataFrame:
    """For each probe the best entry of its own operation with a similarity strictly above ``least``."""
    p = probes.select("probe_id", "operation", F.col("embedding").alias("query"), F.col("norm").alias("query_norm"))
    sim = cosine(F.col("embedding"), F.col("query"), F.col("norm"), F.col("query_norm"))
    scored = entries.join(p, "operation").filter(F.col("entry_id") != F.col("probe_id")).withColumn("similarity", sim).filter(F.col("similarity") > least)
    best = F.max_by(F.struct("entry_id", "similarity"), F.struct("similarity", -F.col("entry_id")))
    return scored.groupBy("probe_id").agg(best.alias("x")).select("probe_id", "x.entry_id", F.round("x.similarity", 6).alias("similarity"))


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the k nearest that two rankings have in common, by query."""
    top = lambda df, name: df.filter(F.col("place") <= k).groupBy("query_id").agg(F.collect_set("vec_id").alias(name))
    return top(a, "x").join(top(b, "y"), "query_id").select("query_id", F.round(F.size(F.array_intersect("x", "y")) / F.lit(float(k)), 6).alias("overlap"))
