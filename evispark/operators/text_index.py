"""A stored inverted index for ranked text search, with the greatest score of each block of postings.

Documents are dealt into slices of about ``slice_docs`` by hash; the postings of one term
in one slice are a block, a row with the greatest weight that a document has there. So
blocks of different terms cover the same documents, and the sum of a query's block bounds
bounds every score in a slice: slices that can't reach the k-th best score found so far
aren't read. Blocks are bounded by the slice, whatever the frequency of a term.

Rows are partitioned by a hash of the term and sorted by it, so a query reads the folders
of its terms and, of these files, the row groups that hold them.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators.search import tokens
from evispark.sources.staging import staged, staging_dir
from evispark.sources.tables import spread

BUCKETS = 64
SLICE_DOCS = 1024
PROBED = 4  # slices of each query that are scored first
MOST_TERMS = 1000  # up to so many terms are pushed into the scan by name
ASKED = 1024  # all scores of a slice are made for up to about so many queries at once
SLACK = 2e-6  # scores are rounded to six digits


def schemas(doc_type: str) -> dict[str, str]:
    postings = f"term string, slice int, most double, n long, postings array<struct<doc_id: {doc_type}, weight: double>>, bucket int"
    return {"postings": postings, "terms": "term string, df long, bucket int"}


def slice_scores(blocks: pa.Table, chosen: pa.Table | None, k: int | None) -> pa.Table:
    """(query_id, doc_id, score) in one slice, of the ``chosen`` queries or of all; the ``k`` best of each, equal scores by doc_id, or all."""
    postings, asked = blocks.column("postings").combine_chunks(), blocks.column("asked").combine_chunks()
    docs, weight = postings.flatten().field("doc_id").dictionary_encode(), postings.flatten().field("weight").to_numpy(zero_copy_only=False)
    who = asked.flatten().field("query_id").dictionary_encode(null_encoding="encode")
    at, ends = docs.indices.to_numpy(zero_copy_only=False), np.cumsum(postings.value_lengths().to_numpy(zero_copy_only=False))
    block, idf = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False)), asked.flatten().field("idf").to_numpy(zero_copy_only=False)
    query = who.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(query, kind="stable")
    wanted = np.ones(len(who.dictionary), bool) if chosen is None else pc.is_in(who.dictionary, value_set=chosen.column("query_id").combine_chunks()).to_numpy(zero_copy_only=False)
    place = pc.rank(docs.dictionary, tiebreaker="dense").to_numpy()
    score, seen = np.zeros(len(docs.dictionary)), np.zeros(len(docs.dictionary), bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for own in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
        if not len(own) or not wanted[query[own[0]]]:
            continue
        score[:], seen[:] = 0, False
        for i in own:
            part = slice(ends[block[i] - 1] if block[i] else 0, ends[block[i]])
            score[at[part]] += idf[i] * weight[part]
            seen[at[part]] = True
        hits = np.flatnonzero(seen)
        value = np.floor(score[hits] * 1e6 + 0.5) / 1e6
        if k is not None:
            best = np.lexsort((place[hits], -value))[:k]
            hits, value = hits[best], value[best]
        found.append((np.full(len(hits), query[own[0]]), hits, value))
    rows, which, values = (np.concatenate(x) for x in zip(*found))
    return pa.table([who.dictionary.take(pa.array(rows)), docs.dictionary.take(pa.array(which)), pa.array(values)], names=["query_id", "doc_id", "score"])


class TextIndex:
    """An index in a folder: postings and terms by bucket, and one row of statistics, written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        stats = spark.read.parquet(f"{path}/stats").first()
        self.n_docs, self.mean_length, self.buckets = stats.n_docs, stats.mean_length, stats.buckets
        self.doc_type, self.schemas = stats.doc_type, schemas(stats.doc_type)

    @classmethod
    def build(cls, docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS, slice_docs: int = SLICE_DOCS) -> TextIndex:
        """Index (doc_id, text); rows of one doc_id are one document. Null and empty texts count as documents without terms."""
        spark = docs.sparkSession
        own = docs.select("doc_id", F.greatest(F.size(tokens("text")), F.lit(0)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("length"))
        n_docs, mean = own.agg(F.count("*"), F.avg("length")).first()
        slices = max(1, ceil(n_docs / slice_docs))
        tasks = max(ceil(slices / 4), min(slices, 2 * spark.sparkContext.defaultParallelism))
        # texts are shuffled by slice once; counts, lengths and blocks are then made where they lie
        texts = docs.filter("doc_id IS NOT NULL").select(F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), "doc_id", "text").repartition(tasks, "slice")
        whole = texts.groupBy("slice", "doc_id").agg(tokens(F.concat_ws("\n", F.collect_list("text"))).alias("terms"))
        split = whole.select("slice", "doc_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
        counts = split.groupBy("slice", "doc_id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
        rows = counts.select("slice", "doc_id", "term", weight.alias("weight"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        # a slice at most a row; no task gets a frequent term whole, as slices are spread too
        blocks = rows.groupBy("slice", "term").agg(F.max("weight").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id", "weight")).alias("postings")).select("term", "slice", "most", "n", "postings")
        spread = max(1, ceil(slices / 4096))
        dealt = blocks.select(bucket, "*").repartition(buckets * spread, "bucket", F.pmod("slice", F.lit(spread))).sortWithinPartitions("bucket", "term", "slice")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = spark.read.schema(schemas(kind)["postings"]).parquet(f"{path}/postings")
        terms = found.groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term")
        terms.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        stats = spark.createDataFrame([(n_docs, float(mean or 0), float(k1), float(b), buckets, kind)], "n_docs long, mean_length double, k1 double, b double, buckets int, doc_type string")
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls(spark, path)

    @classmethod
    def of(cls, docs: DataFrame) -> TextIndex:
        """The index of a table of files, built at its first use; other files, sizes or times make another index."""
        spark = docs.sparkSession
        seen = []
        for name in sorted(docs.inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
        path = f"{staging_dir(spark)}/text-index-{hashlib.sha256('|'.join(seen).encode()).hexdigest()[:24]}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return cls(spark, path)
        return cls.build(spread(docs.select("doc_id", "text")), path)

    def _wanted(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, idf) of the queries' known terms."""
        terms = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term")).distinct()
        df = self._pruned("terms", terms).select("term", "df")
        idf = F.log(1 + (F.lit(self.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(df, "term").select("query_id", "term", idf.alias("idf"))

    def _pruned(self, table: str, terms: DataFrame) -> DataFrame:
        """The rows of the terms' buckets, and of the terms alone where they are few."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        buckets = [r[0] for r in terms.select(bucket).distinct().collect()]  # as many as there are buckets at most
        rows = self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(buckets))
        names = [r.term for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        return rows.filter(F.col("term").isin(names)) if len(names) <= MOST_TERMS else rows

    def _scores(self, wanted: DataFrame, slices: DataFrame | None = None, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score) of the documents of the given slices (query_id, slice), or of all, that hold a term.

        A slice's blocks are brought together, each once with the queries that ask for its
        term, and all scores of the slice are added up there; with ``k`` only the best of
        each query and slice leave it. Postings don't multiply by queries.
        """
        groups = ["asking"] if slices is None else []
        asked = wanted.groupBy("term", *groups).agg(F.collect_list(F.struct("query_id", "idf")).alias("asked"))
        blocks = self._pruned("postings", wanted).select("term", "slice", "postings").join(asked, "term").drop("term")
        schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, doc_id {self.doc_type}, score double"
        if slices is None:
            return blocks.groupBy("slice", *groups).applyInArrow(lambda table: slice_scores(table, None, k), schema)
        blocks = blocks.join(slices.select("slice").distinct(), "slice", "left_semi")
        return blocks.groupBy("slice").cogroup(slices.groupBy("slice")).applyInArrow(lambda left, right: slice_scores(left, right, k), schema)

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of every document that shares a term with a query (query_id, text).

        Many queries are dealt into groups, so that what a task makes of a slice stays bounded.
        """
        wanted = staged(self._wanted(queries), "wanted-terms")
        groups = max(1, ceil(wanted.select("query_id").distinct().count() / ASKED))
        return self._scores(wanted.withColumn("asking", F.pmod(F.xxhash64("query_id"), F.lit(groups))))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, slice, bound): no document of the slice scores higher. No posting is read."""
        wanted = self._wanted(queries)
        return self._bounds(wanted)

    def _bounds(self, wanted: DataFrame) -> DataFrame:
        blocks = self._pruned("postings", wanted).select("term", "slice", "most")
        return blocks.join(wanted, "term").groupBy("query_id", "slice").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))

    def top(self, queries: DataFrame, k: int, probed: int = PROBED) -> DataFrame:
        """(query_id, doc_id, score, place): the ``k`` best documents of each query, equal scores by doc_id.

        The slices with the highest bounds are scored first; of the others only those
        whose bound reaches the k-th score found there. The result is exact.
        """
        wanted = staged(self._wanted(queries), "wanted-terms")
        bounds = staged(self._bounds(wanted), "slice-bounds")
        high = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice")
        first = bounds.withColumn("n", F.row_number().over(high)).filter(F.col("n") <= probed).select("query_id", "slice")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        placed = lambda df: df.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
        early = staged(placed(self._scores(wanted, first, k)), "first-scores")
        least = early.filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(first, ["query_id", "slice"], "left_anti").join(least, "query_id", "left")
        rest = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "slice")
        return placed(early.drop("place").unionByName(self._scores(wanted, rest, k)))
