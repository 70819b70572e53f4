"""Queries of the name cascade and of aliases in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import cascade
from evispark.sources import tables as t


def aliases(s, d):
    """Every brand's and kind's words: a part's name stands for its first brand in order; kinds stand for themselves."""
    p = t.table(s, d, "part")
    names = p.filter("p_partkey % 5 = 0").groupBy(F.col("p_name").alias("alias")).agg(F.min("p_brand").alias("canonical"), F.min("p_partkey").alias("ord"))
    kinds = p.groupBy(F.col("p_type").alias("alias")).agg(F.min("p_type").alias("canonical"), (F.lit(1_000_000) + F.min("p_partkey")).alias("ord"))
    return names.unionByName(kinds)


def names(s, d):
    """Names of all parts as they are written: as such, turned round, with a particle, an error, a kind or other words about them."""
    p = t.table(s, d, "part")
    k, name, word = F.col("p_partkey"), F.col("p_name"), F.split("p_name", " ")
    shape = (
        F.when(k % 8 == 0, F.upper(name)).when(k % 8 == 1, F.concat(name, F.lit("에서"))).when(k % 8 == 2, F.concat_ws(" ", word[1], word[0]))
        .when(k % 8 == 3, F.concat_ws("-", F.lit("rare"), F.lower("p_type"), k.cast("string"))).when(k % 8 == 4, F.concat(F.lit("x"), name))
        .when(k % 8 == 5, F.concat_ws(" ", F.lit("very"), name, F.lit("kit"))).when(k % 8 == 6, word[1]).otherwise(F.concat_ws(" ", F.lit("item"), k.cast("string")))
    )
    return p.select(shape.alias("name"))


def phrases(s, d):
    """Aliases of one to six words: the first words of the benchmark's items."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return t.table(s, d, "benchmark").select(F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 6 + 1).cast("int")), " ").alias("alias"), F.concat(F.lit("I"), F.col("item_id").cast("string")).alias("canonical"))


QUERIES = {
    "text_cascade": lambda s, d: cascade.cascade(names(s, d), aliases(s, d)),
    "text_found_aliases": lambda s, d: cascade.found_aliases(t.table(s, d, "documents"), phrases(s, d)),
}

_words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
ORACLE = {
    "text_found_aliases": f"""WITH a AS (SELECT DISTINCT list_slice({_words.format("text")}, 1, item_id % 6 + 1) AS words, 'I' || item_id AS canonical FROM benchmark),
d AS (SELECT doc_id, {_words.format("text")} AS words FROM documents), sizes AS (SELECT DISTINCT len(words) AS k FROM a WHERE len(words) > 0),
places AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, sizes WHERE len(words) >= k),
grams AS (SELECT doc_id, list_slice(words, i, i + k - 1) AS words FROM places)
SELECT doc_id, canonical, count(*) AS n_mentions FROM grams JOIN a USING (words) GROUP BY 1, 2""",
}
