"""One function an action: what tools and services call. Each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import conflict, hierarchy, inference, search, synthesis
from evispark.operators.cache import QueryCache
from evispark.sources import tables as t


@dataclass
class EvidenceGraph:
    """The graph's tables under one folder, with a cache of results."""

    spark: SparkSession
    path: str
    cache: QueryCache = field(default_factory=QueryCache)

    def _cached(self, action: str, build: Callable[[], DataFrame], **parameters) -> DataFrame:
        return self.cache.get(action, parameters, build)

    def conflicts(self, intervention=None, outcome=None) -> DataFrame:
        def build():
            facts = t.evidence(self.spark, self.path)
            facts = facts if intervention is None else facts.filter(F.col("intervention") == intervention)
            return conflict.conflict_report(facts if outcome is None else facts.filter(F.col("outcome") == outcome))

        return self._cached("conflicts", build, intervention=intervention, outcome=outcome)

    def synthesize(self, intervention, outcome) -> DataFrame:
        facts = t.evidence(self.spark, self.path).filter((F.col("intervention") == intervention) & (F.col("outcome") == outcome))
        return synthesis.synthesize(facts, "effect")

    def hierarchy(self, name: str, direction: str = "both", depth: int = 3) -> DataFrame:
        up = hierarchy.closure(t.is_a(self.spark, self.path))
        higher = hierarchy.ancestors(up, name, depth).select(F.col("ancestor").alias("name"), "distance", F.lit("up").alias("side"))
        lower = hierarchy.descendants(up, name, depth).select(F.col("node").alias("name"), "distance", F.lit("down").alias("side"))
        if direction not in ("both", "up", "down"):
            raise ValueError("direction is both, up or down")
        return {"both": higher.unionByName(lower), "up": higher, "down": lower}[direction]

    def infer(self, rule: str) -> DataFrame:
        up = hierarchy.closure(t.is_a(self.spark, self.path))
        entity = F.concat(F.lit("S"), F.col("intervention").cast("string"))
        have = {
            "up": up,
            "is_a": t.is_a(self.spark, self.path),
            "intervention": t.intervention(self.spark, self.path),
            "investigates": t.investigates(self.spark, self.path),
            "papers": t.paper(self.spark, self.path),
            "treats": t.treats(self.spark, self.path).select(entity.alias("entity"), "pathology"),
            "facts": t.affects(self.spark, self.path).withColumn("entity", entity),
        }
        return inference.run_rule(rule, **have)

    def search_text(self, queries: DataFrame, most: int = 10) -> DataFrame:
        from evispark.operators.filters import best_per_group

        scored = search.bm25(t.table(self.spark, self.path, "documents"), queries)
        return best_per_group(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], most)

    def search_vectors(self, queries: DataFrame, most: int = 10) -> DataFrame:
        vectors = search.with_norm(t.table(self.spark, self.path, "embeddings"))
        q = search.with_norm(queries).select("query_id", F.col("embedding").alias("query"), F.col("norm").alias("query_norm"))
        return search.nearest(vectors, q, most)
