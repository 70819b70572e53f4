"""An inverted-file index of vectors: lists around centroids, codes of what is left, and an exact look at the best.

Centroids and codebooks are fitted on at most ``sample`` vectors, drawn by a hash of their
identifiers; every vector is then indexed. A query looks at the lists whose centroids are
nearest, estimates each member's cosine from the centroid and the code, and computes it
exactly for the best estimates. How many lists that takes for the wanted recall is
measured on the sample at build time, against all pairs of a bounded draw of it.

Lists are folders, so a search reads those it looks at; a long list is dealt into cells.
Rows without an identifier or an embedding are left out; a vector of norm 0 has similarity
0 to all.
"""

from __future__ import annotations

import io
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, MOST_LISTS, CODE_BYTES = 20_000, 4096, 8
CELL = 50_000  # vectors compared in one task
TARGET, DRAWN = 0.97, 400  # share of true neighbours in the lists looked at; queries it is measured on
BLOCK = 256  # queries compared at once


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample; one that loses all its points takes a random point."""
    draw = np.random.default_rng(seed)
    centre = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centre))
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[draw.integers(0, len(x), len(centre))])
    return centre


def nearest_centre(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out, square = np.empty(len(x), dtype=np.int64), (centre * centre).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ centre.T - square).argmax(axis=1)
    return out


class Codes:
    """Centroids and, for each part of the dimensions, a codebook of what a centroid leaves over."""

    def __init__(self, centre: np.ndarray, books: list[np.ndarray]):
        self.centre, self.books = centre, books
        cuts = np.cumsum([0, *(b.shape[1] for b in books)])
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 7) -> Codes:
        x = unit(sample)
        centre = k_means(x, min(lists, len(x)), seed)
        left = x - centre[nearest_centre(x, centre)]
        parts = np.array_split(np.arange(x.shape[1]), min(CODE_BYTES, x.shape[1]))
        return cls(centre, [k_means(left[:, p], min(256, len(x)), seed + i) for i, p in enumerate(parts)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(x)
        own = nearest_centre(x, self.centre)
        left = x - self.centre[own]
        return own, np.stack([nearest_centre(left[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def order(self, q: np.ndarray) -> np.ndarray:
        """The lists, nearest first, for each query."""
        return np.argsort(-(unit(q) @ self.centre.T), axis=1, kind="stable")

    def estimates(self, q: np.ndarray, own: int, code: np.ndarray) -> np.ndarray:
        """Cosines of queries with the members of one list, from their codes."""
        q = unit(q)
        out = np.repeat((q @ self.centre[own])[:, None], len(code), axis=1)
        for i, (p, book) in enumerate(zip(self.parts, self.books)):
            out += (q[:, p] @ book.T)[:, code[:, i]]
        return out

    def looked_at(self, sample: np.ndarray, target: float = TARGET) -> int:
        """How many lists hold ``target`` of the ten nearest of drawn sample vectors among the sample."""
        x = unit(sample)
        q = x[np.random.default_rng(3).permutation(len(x))[:DRAWN]]
        own, rank = nearest_centre(x, self.centre), np.empty((len(q), len(self.centre)), dtype=np.int64)
        np.put_along_axis(rank, self.order(q), np.arange(len(self.centre))[None, :], axis=1)
        near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1:11]
        if not near.size:
            return len(self.centre)
        return int(np.quantile(np.take_along_axis(rank, own[near], axis=1), target, method="higher")) + 1

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centre=self.centre, **{f"book{i}": b for i, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        found = np.load(io.BytesIO(data))
        return cls(found["centre"], [found[f"book{i}"] for i in range(len(found.files) - 1)])


def _matrix(column) -> np.ndarray:
    """Rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/model").first()
        self.codes, self.probes = Codes.from_bytes(bytes(row.codes)), row.probes
        self.sizes = spark.read.parquet(f"{path}/sizes")  # a row a list

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> VectorIndex:
        """Index (vec_id, embedding); ``lists`` is the root of the number of vectors unless given, ``MOST_LISTS`` at most."""
        spark = vectors.sparkSession
        clean = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        total = clean.count()
        if not total:
            raise ValueError("there is no vector to index")
        share = min(1.0, 1.2 * sample / total)
        drawn = clean.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("embedding").limit(sample)
        seen = np.array([r.embedding for r in drawn.collect()], dtype=np.float64)
        codes = Codes.fit(seen, min(lists or max(1, round(sqrt(total))), MOST_LISTS))
        probes = codes.looked_at(seen[:5000], target)

        def encode(batches):
            for batch in batches:
                own, code = codes.encode(_matrix(batch.column("embedding")))
                binary = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vec_id"), binary, batch.column("embedding")], names=["list", "vec_id", "code", "embedding"])

        schema = f"list int, vec_id {clean.schema['vec_id'].dataType.simpleString()}, code binary, embedding array<float>"
        rows = clean.mapInArrow(encode, schema)
        files = max(1, ceil(total / (CELL * MOST_LISTS)))
        rows.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(files))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        sizes = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("cells"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
        spark.createDataFrame([(codes.to_bytes(), probes)], "codes binary, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, allowed: DataFrame | None = None, others: bool = False, looked: int | None = None) -> DataFrame:
        """(query_id, vec_id, similarity, place): the ``k`` nearest found of each query (query_id, query).

        ``allowed`` (vec_id) filters before anything is ranked, so k rows are found where
        there are as many. ``others`` leaves out the vector of the query's own identifier.
        ``looked`` is the number of estimates a cell and query that are computed exactly,
        20 k unless given; with all lists and all members looked at the result is exact.
        """
        codes, looked = self.codes, looked or 20 * k
        probes = min(probes or self.probes, len(codes.centre))
        clean = queries.filter("query_id IS NOT NULL AND query IS NOT NULL").select("query_id", F.col("query").cast("array<float>").alias("query"))
        kind = clean.schema["query_id"].dataType.simpleString()

        def spread(batches):
            for batch in batches:
                order = codes.order(_matrix(batch.column("query")))[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(order.reshape(-1).astype(np.int32)), batch.column("query_id").take(rows), batch.column("query").take(rows)], names=["list", "query_id", "query"])

        asked = clean.mapInArrow(spread, f"list int, query_id {kind}, query array<float>")
        wanted = [r[0] for r in asked.select("list").distinct().collect()]  # MOST_LISTS at most
        members = self.spark.read.parquet(f"{self.path}/lists").filter(F.col("list").isin(wanted))
        if allowed is not None:
            members = members.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
        cells = F.broadcast(self.sizes)  # a row a list, MOST_LISTS at most
        members = members.join(cells, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int").alias("cell"), "vec_id", "code", "embedding")
        asked = asked.join(cells, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "query_id", "query")
        vec_kind = members.schema["vec_id"].dataType.simpleString()

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(left.column("query_id").slice(0, 0).combine_chunks(), right.column("vec_id").slice(0, 0).combine_chunks(), np.zeros(0))]
            if left.num_rows and right.num_rows:
                q, v, own = _matrix(left.column("query")), _matrix(right.column("embedding")), right.column("list")[0].as_py()
                code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
                ids, vec_ids, length = left.column("query_id").combine_chunks(), right.column("vec_id").combine_chunks(), np.linalg.norm(v, axis=1)
                for a in range(0, len(q), BLOCK):
                    part = q[a : a + BLOCK]
                    if looked < len(v):
                        at = np.argpartition(-codes.estimates(part, own, code), looked - 1, axis=1)[:, :looked]
                    else:
                        at = np.repeat(np.arange(len(v))[None, :], len(part), axis=0)
                    scale = np.linalg.norm(part, axis=1)[:, None] * length[at]
                    exact = np.einsum("qd,qnd->qn", part, v[at])
                    cosine = np.divide(exact, scale, out=np.zeros_like(exact), where=scale > 0)
                    who = np.repeat(np.arange(a, a + len(part)), at.shape[1])
                    found.append((ids.take(pa.array(who)), vec_ids.take(pa.array(at.reshape(-1))), cosine.reshape(-1)))
            columns = list(zip(*found))
            return pa.table({"query_id": pa.chunked_array(columns[0]), "vec_id": pa.chunked_array(columns[1]), "similarity": np.concatenate(columns[2])})

        scored = asked.groupBy("list", "cell").cogroup(members.groupBy("list", "cell")).applyInArrow(compare, f"query_id {kind}, vec_id {vec_kind}, similarity double")
        scored = scored.withColumn("similarity", F.round("similarity", 6))
        scored = scored.filter("vec_id <> query_id") if others else scored
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("query_id", "vec_id", "similarity", "place")
