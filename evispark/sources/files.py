"""Reading and writing the graph's tables: records from JSON, exports, raw files and small stores."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER_RECORD = (
    "paper_id string, title string, authors array<string>, year int, journal string, doi string, pmid string, abstract string, sub_domain string, "
    "study_design string, evidence_level string, sample_size int, follow_up_months int, "
    "interventions array<string>, pathologies array<string>, anatomy_levels array<string>, "
    "outcomes array<struct<name: string, intervention: string, value: string, value_control: string, p_value: double, is_significant: boolean, direction: string>>"
)


class TextSource(Protocol):
    """What an outside source of papers provides: a table in the shape of PAPER_RECORD."""

    def fetch(self, spark: SparkSession, identifiers: list[str]) -> DataFrame: ...


def read_papers(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Structured papers from JSON lines (or whole JSON files); broken records are kept apart in ``_corrupt``."""
    reader = spark.read.schema(PAPER_RECORD + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline)
    return reader.json(path)


def graph_tables(papers: DataFrame) -> dict[str, DataFrame]:
    """Vertex and edge tables of structured papers. Blank names and identifiers count as missing."""
    p = papers.filter(F.coalesce(F.trim("paper_id"), F.lit("")) != "")
    named = lambda array, name: p.select("paper_id", F.explode(array).alias(name)).withColumn(name, F.trim(name)).filter(F.col(name) != "").distinct()
    facts = p.select("paper_id", "evidence_level", F.explode("outcomes").alias("o")).select(
        F.col("o.intervention").alias("intervention"), F.col("o.name").alias("outcome"), F.col("paper_id").alias("source_paper_id"), "evidence_level",
        "o.value", "o.value_control", "o.p_value", F.coalesce("o.is_significant", F.col("o.p_value") < 0.05).alias("is_significant"), "o.direction",
    )
    return {
        "paper": p.drop("outcomes", "interventions", "pathologies", "anatomy_levels", "_corrupt") if "_corrupt" in p.columns else p.drop("outcomes", "interventions", "pathologies", "anatomy_levels"),
        "investigates": named("interventions", "intervention"),
        "studies": named("pathologies", "pathology"),
        "involves": named("anatomy_levels", "anatomy"),
        "affects": facts,
    }


def export_documents(papers: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "paper_id") -> DataFrame:
    """One JSON text a paper with its children as arrays, in a defined order; children are gathered before the joins."""
    out = papers
    for name, (df, order) in children.items():
        rest = [c for c in df.columns if c != key and c != order]
        out = out.join(df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("json"))


def write_graph(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Parquet, one folder a table; large tables may be partitioned."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{path}/{name}")


def read_raw(spark: SparkSession, path: str, pattern: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of raw files, by a function from bytes to text that the caller supplies, as for PDF."""
    import pandas as pd

    convert = F.pandas_udf(lambda contents: pd.Series([to_text(bytes(c)) for c in contents]), "string")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", convert("content").alias("text"))


def search_query(base: str, year_from: int | None = None, year_to: int | None = None, kinds: list[str] | None = None) -> str:
    """A bibliographic query string with optional years and publication types."""
    parts = [base.strip()]
    if year_from is not None or year_to is not None:
        parts.append(f"{year_from or 1900}:{year_to or 3000}[pdat]")
    if kinds:
        parts.append("(" + " OR ".join(f'"{k}"[pt]' for k in kinds) + ")")
    return " AND ".join(p for p in parts if p)
