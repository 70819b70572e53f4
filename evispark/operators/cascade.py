"""Names to canonical names in seven stages, and aliases found in texts, by automata over all aliases.

An alias table is cut into parts of at most ``PART`` rows. Each part is collected, which
bounds what the driver and a worker hold, and compiled once a worker into an
Aho-Corasick automaton; names or texts stream through it. A table of more rows takes one
pass a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.normalize import exact_stage, first_match, fuzzy_stage, key, split_aliases, split_names, token_stage

PART = 100_000
#: Endings that a name may carry in Korean; the longest that fits is stripped.
PARTICLES = (
    "가", "이", "를", "을", "에", "의", "와", "과", "으로", "로", "에서", "에게", "한테", "께", "도", "만", "부터", "까지",
    "조차", "마저", "라도", "나마", "이나", "나", "든지", "이든지", "야", "이야",
)
SURE, LEAST_PARTIAL = 0.95, 0.5


def stripped(name: Column, particles: Sequence[str] = PARTICLES) -> Column:
    """The name without the longest of the particles that it ends with."""
    out = name
    for p in sorted(particles, key=len):
        out = F.when(name.endswith(p), F.substring(name, F.lit(1), F.length(name) - len(p))).otherwise(out)
    return out


def _parts(table: DataFrame, size: int) -> Iterator[list]:
    """The rows of a small table, at most about ``size`` at once."""
    parts = max(1, ceil(table.count() / size))
    dealt = table.withColumn("__part", F.pmod(F.xxhash64(*table.columns), F.lit(parts)))
    for i in range(parts):
        yield [tuple(r) for r in dealt.filter(F.col("__part") == i).drop("__part").collect()]


@lru_cache(maxsize=4)
def _automaton(patterns: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def contained(names: DataFrame, aliases: DataFrame, size: int = PART) -> DataFrame:
    """(k, ak) of distinct keys of names and aliases one of which holds the other, the shorter more than half as long."""
    keys = names.select("k").filter("k <> ''").distinct()

    def streamed(patterns: tuple[str, ...]) -> Callable:
        def run(batches):
            inside = _automaton(patterns)
            for batch in batches:
                own = batch.column("k").to_pylist()
                found = {(k, p) for k in own for _, p in inside.iter(k) if 2 * len(p) > len(k)}
                around = _automaton.__wrapped__(tuple(own))
                found |= {(k, p) for p in patterns for _, k in around.iter(p) if 2 * len(k) > len(p)}
                if found:
                    rows = sorted(found)
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)], names=["k", "ak"])

        return run

    rest = aliases.select("ak").filter("ak <> ''").distinct()
    found = [keys.mapInArrow(streamed(tuple(sorted(p for (p,) in part))), "k string, ak string") for part in _parts(rest, size) if part]
    return reduce(DataFrame.unionByName, found) if found else keys.select("k", F.col("k").alias("ak")).limit(0)


def cascade(names: DataFrame, aliases: DataFrame, least_overlap: float = 0.8, least_ratio: float = 0.85, particles: Sequence[str] = PARTICLES, size: int = PART) -> DataFrame:
    """(name, canonical, confidence, method) of each distinct name; ``aliases`` has (alias, canonical, ord).

    In this order, the first that fits: ``exact``; ``stripped``, exact without a particle
    (0.95); ``token``, equal words; ``word``, a canonical name among the name's words
    (0.95); ``fuzzy``; ``partial``, one holds the other, by the ratio of lengths (0.95 of
    it without a particle), above a half; ``none``. Null and blank names fit none.
    """
    n, a = split_names(names).filter("name IS NOT NULL"), split_aliases(aliases)
    bare = n.withColumn("k", stripped(F.col("k"), particles))
    stages, left = [], n

    def settle(method, found):
        nonlocal left
        stages.append(found.select("name", "x.canonical", "x.confidence", F.lit(method).alias("method")))
        left = left.join(found.select("name"), "name", "left_anti")

    settle("exact", exact_stage(n.filter("k <> ''"), a))
    changed = left.drop("k", "w").join(bare, "name").join(left.select("name", F.col("k").alias("whole")), "name").filter("k <> whole AND k <> ''")
    settle("stripped", first_match(changed.join(a, changed.k == a.ak).withColumn("confidence", F.lit(SURE)), ["ord"]))
    settle("token", token_stage(left, a, least_overlap))
    canon = aliases.groupBy("canonical").agg(F.min("ord").alias("ord")).withColumn("word", F.lower("canonical"))
    spoken = left.select("name", F.explode(F.array_distinct(F.split("k", r"[\s\-_/]+"))).alias("word")).filter("word <> ''")
    settle("word", first_match(spoken.join(canon, "word").withColumn("confidence", F.lit(SURE)), ["ord"]))
    settle("fuzzy", fuzzy_stage(left, a, least_ratio))
    plain = left.select("name", "k", F.lit(1.0).alias("weight"))
    other = plain.unionByName(bare.join(left.select("name"), "name", "left_semi").select("name", "k", F.lit(SURE).alias("weight"))).groupBy("name", "k").agg(F.max("weight").alias("weight"))
    met = other.join(contained(other, a, size), "k").join(a.select("ak", "canonical", "ord"), "ak")
    part = F.least(F.length("k"), F.length("ak")) / F.greatest(F.length("k"), F.length("ak"))
    met = met.withColumn("confidence", F.round(F.col("weight") * part, 6)).filter(F.col("confidence") > LEAST_PARTIAL)
    settle("partial", first_match(met, [-F.col("confidence"), F.col("ord")]))
    found = reduce(DataFrame.unionByName, stages)
    return names.select("name").distinct().join(found, "name", "left").withColumn("method", F.coalesce("method", F.lit("none")))


def found_aliases(texts: DataFrame, aliases: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = PART) -> DataFrame:
    """(id, canonical, n_mentions) of aliases of any length that texts hold as whole words, overlaps included.

    Words are runs of letters and digits, lower-cased by Spark, so punctuation between the
    words of an alias doesn't matter. An alias without a word is never found.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))
    lines = texts.select(F.col(id_col).alias("id"), spaced(F.coalesce(F.col(text_col), F.lit(""))).alias("line"))
    known = aliases.select(spaced(F.col("alias")).alias("pattern"), "canonical").filter("length(trim(pattern)) > 0").distinct()

    def streamed(patterns: tuple[str, ...]) -> Callable:
        def run(batches):
            inside = _automaton(patterns)
            for batch in batches:
                out: dict[tuple[int, str], int] = {}
                for i, line in enumerate(batch.column("line").to_pylist()):
                    for _, p in inside.iter(line):
                        out[i, p] = out.get((i, p), 0) + 1
                if out:
                    at = pa.array([i for i, _ in out])
                    columns = [batch.column("id").take(at), pa.array([p for _, p in out], pa.string()), pa.array(list(out.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "pattern", "n"])

        return run

    schema = f"id {lines.schema['id'].dataType.simpleString()}, pattern string, n long"
    found = [lines.mapInArrow(streamed(tuple(sorted(p for (p,) in part))), schema) for part in _parts(known.select("pattern").distinct(), size) if part]
    counted = reduce(DataFrame.unionByName, found) if found else lines.select("id", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("n")).limit(0)
    return counted.join(known, "pattern").groupBy(F.col("id").alias(id_col), "canonical").agg(F.sum("n").alias("n_mentions"))
