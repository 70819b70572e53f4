"""Queries over the stored text index and the inverted-file index of vectors, each beside its oracle where it is exact."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evispark.operators.text_index import TextIndex
from evispark.operators.vector_index import VectorIndex
from evispark.plans.search import ORACLE as SEARCH_SQL
from evispark.sources import tables as t
from evispark.sources.staging import staging_dir


def _texts(s, d):
    return t.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def text_top(s, d):
    """The ten best documents of every benchmark item."""
    return TextIndex.of(t.table(s, d, "documents")).top(_texts(s, d), 10).select("query_id", "doc_id", "score", "place")


def text_scores(s, d):
    """The scores of every benchmark item's documents, as ``text_bm25`` has them for some items, read from the index."""
    return TextIndex.of(t.table(s, d, "documents")).scores(_texts(s, d))


def _vectors(s, d):
    return VectorIndex.build(t.table(s, d, "embeddings"), f"{staging_dir(s)}/vectors-{uuid.uuid4().hex}")


def _asked(s, d):
    return t.table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vector_index_top(s, d):
    """The ten nearest of every hundredth vector among the lists that the wanted recall takes."""
    return _vectors(s, d).search(_asked(s, d), 10, others=True)


def vector_index_papers(s, d):
    """The ten nearest vectors of documents labelled good, filtered before the ranking, over all lists."""
    good = t.table(s, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    index = _vectors(s, d)
    return index.search(_asked(s, d), 10, probes=len(index.codes.centre), allowed=good, others=True, looked=1 << 30)


QUERIES = {
    "text_index_top": text_top,
    "text_index_scores": text_scores,
    "vector_index_top_k": vector_index_top,
    "vector_index_allowed": vector_index_papers,
}

_every = SEARCH_SQL["text_bm25"].replace("FROM benchmark WHERE item_id % 100 = 0", "FROM benchmark")
ORACLE = {
    "text_index_top": f"""WITH every AS ({_every}), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM every)
SELECT query_id, doc_id, score, place FROM placed WHERE place <= 10""",
    "text_index_scores": _every,
    "vector_index_allowed": """WITH good AS (SELECT DISTINCT doc_id AS vec_id FROM labels WHERE quality = 1),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, x.vec_id, round(CASE WHEN q.norm = 0 OR x.norm = 0 THEN CAST(0 AS DOUBLE) ELSE list_dot_product(q.e, x.e) / (q.norm * x.norm) END, 6) AS similarity
  FROM n q, n x SEMI JOIN good USING (vec_id) WHERE q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s)
SELECT query_id, vec_id, similarity, place FROM r WHERE place <= 10""",
}
