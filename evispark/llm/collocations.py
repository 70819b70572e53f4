"""Phrases of two or three words that occur more often than their parts suggest, per language.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces
into words; phrases are counted within pieces. The count of the words of a phrase is no
less than its own, so:

1. Words are counted, by shard first. Frequent words get dense numbers in the order of
   language and word: the sums of a range sort's partitions give each its place.
2. Each shard is told the numbers of the frequent words that occur in it, and nothing
   else; pieces break at all other words. N-grams of numbers are counted in the shard and
   packed into keys of 126 bits, 42 a word, in two longs.
3. Keys are range-partitioned by the share of n-grams expected before them: the running
   share of the first word's count, and within it that of the second. So a frequent word's
   n-grams spread over as many partitions as they need, and no sample is drawn. A
   partition is sorted by radix, 16 bits a pass, and equal keys are added up as runs.
4. Parts of candidates are looked up by number or by pair of numbers, where the rows are
   for numbers that many candidates share (``join_on_key``).

Scores are whole-number quotients of decimals of 38 digits; they are exact up to counts of
about 5 * 10^15.

Defined cases: null, empty and blank texts have no words; a null language is ``und``;
repeated rows count each time; an empty table, or one without a candidate, gives no row;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import discarded, join_on_key, read_table, stored
from evispark.llm.shards import freed, numbers, per_shard, sharded, texts, with_side

LEAST, TOP, SHARE = 10, 2000, 50
SHARD_BYTES = 8 << 20
PARTITION_ROWS = 4_000_000  # n-grams of a range partition, before shards add up
BITS = 42
BREAK = b"."
TABLE = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, lower-cased, with ``BREAK`` between pieces."""
    return text.lower().translate(TABLE).replace(b"\n", b" . ").split()


def _shard_words(rows: pa.Table) -> pa.Table:
    found: dict[str, Counter] = {}
    for text, lang in zip(texts(rows), rows.column("lang").to_pylist()):
        found.setdefault(lang, Counter()).update(tokens(text))
    langs, words, n = [], [], []
    for lang, counts in found.items():
        counts.pop(BREAK, None)
        langs += [lang] * len(counts)
        words += counts.keys()
        n += counts.values()
    shard = np.full(len(n), rows.column("shard")[0].as_py(), np.int32)
    return pa.table({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string()), "shard": shard, "n": pa.array(n, pa.int64())})


def numbered(frequent: DataFrame) -> DataFrame:
    """(lang, word, f, id, at, share): numbers from 1 in order of language and word; ``at`` is the share of all counts
    before the word and ``width`` its own; ``within`` the share of its language's counts before it."""
    keys = ["lang", "word"]
    in_order = frequent.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(in_order.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "frequent-words")
    parts = rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("f").alias("sum"), F.min("seq").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition of the sort
    base = parts.select("part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("so_far", F.coalesce(F.sum("f").over(inside), F.lit(0))).join(F.broadcast(base), "part")
    placed = stored(placed.select("lang", "word", "f", (F.col("seq") + F.col("shift") + 1).alias("id"), (F.col("so_far") + F.col("base")).alias("before")), "numbered-words")
    langs = placed.groupBy("lang").agg(F.count("*").alias("n"), F.min("before").alias("start"), F.sum("f").alias("all"))
    total, count = placed.agg(F.sum("f"), F.count("*")).first()
    met = join_on_key(placed, langs, "lang", count)
    share = lambda part, whole: F.col(part) / F.lit(float(whole or 1))
    within = (F.col("before") - F.col("start")) / F.col("all")
    return met.select("lang", "word", "f", "id", share("before", total).alias("at"), share("f", total).alias("width"), within.alias("within"))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by unsigned columns, the first the most significant: a stable pass for each 16 bits that differ."""
    order = None
    for column in reversed(columns):
        differ = int(np.bitwise_or.reduce(column ^ column[:1])) if len(column) else 0
        for shift in range(0, 8 * column.itemsize, 16):
            if differ >> shift & 0xFFFF:
                digit = (column >> column.dtype.type(shift)).astype(np.uint16)
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(len(columns[0])) if order is None else order


def run_lengths(columns: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of unsigned columns, in order, and how often each occurs or the sum of its weights."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(order)]])) if weight is None else np.add.reduceat(weight[order], at)
    return [c[at] for c in columns], n.astype(np.int64)


def pack(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers of ``BITS`` bits in two longs; the order of keys is that of the numbers."""
    half = np.uint64(BITS // 2)
    return first << half | second >> half, (second & np.uint64((1 << BITS // 2) - 1)) << np.uint64(BITS) | third


def unpack(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    half, mask = np.uint64(BITS // 2), np.uint64((1 << BITS // 2) - 1)
    return hi >> half, (hi & mask) << half | lo >> np.uint64(BITS), lo & np.uint64((1 << BITS) - 1)


def _shard_ngrams(parts: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        words, langs = side.column("word").cast(pa.binary()).to_pylist(), side.column("lang").to_pylist()
        local: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(zip(langs, words), start=1):
            local.setdefault(lang, {})[word] = i
        ids = np.concatenate([[0], numbers(side, "id")]).astype(np.uint64)
        at, width, within = (np.concatenate([[0.0], numbers(side, c).astype(float)]) for c in ("at", "width", "within"))
        found = [np.zeros(1, np.uint32)]
        for text, lang in zip(texts(rows), rows.column("lang").to_pylist()):
            get = local.get(lang, {}).get
            found.append(np.array([get(t, 0) for t in tokens(text)] + [0], dtype=np.uint32))
        line = np.concatenate(found)
        pair = (line[:-1] > 0) & (line[1:] > 0)
        triple = pair[:-1] & pair[1:]
        two, n_two = run_lengths([line[:-1][pair], line[1:][pair]])
        three, n_three = run_lengths([line[:-2][triple], line[1:-1][triple], line[2:][triple]])
        first, second = np.concatenate([two[0], three[0]]), np.concatenate([two[1], three[1]])
        third = np.concatenate([np.zeros(len(two[0]), np.uint32), three[2]])
        hi, lo = pack(ids[first], ids[second], ids[third])
        place = at[first] + width[first] * within[second]
        part = np.minimum((place * parts).astype(np.int32), parts - 1)
        return pa.table({"part": part, "hi": hi.view(np.int64), "lo": lo.view(np.int64), "n": np.concatenate([n_two, n_three])})

    return run


def _count_runs(least: int):
    def run(batches):
        held = [np.zeros((3, 0), np.int64)]
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("hi", "lo", "n")]))
        hi, lo, n = np.concatenate(held, axis=1)
        (hi, lo), n = run_lengths([hi.view(np.uint64), lo.view(np.uint64)], n)
        often = n >= least
        if often.any():
            columns = [x.astype(np.int64) for x in unpack(hi[often], lo[often])] + [n[often]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id1", "id2", "id3", "a"])

    return run


def looked_up(rows: DataFrame, key: Column, table: DataFrame, total: int) -> DataFrame:
    """Rows with the columns that ``table`` has for their key, in column ``key``; rows without a match go.

    Stored, as the next look-up reads its rows several times.
    """
    keyed = rows.withColumn("key", key)
    one = table.join(keyed.groupBy("key").agg(F.count("*").alias("n")), "key")
    return stored(join_on_key(keyed, one, "key", total).drop("key"), "looked-up")


def _score(a: str, left: str, right: str) -> Column:
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * {wide(a)} * {wide(a)}) DIV ({wide(left)} * {wide(right)})").cast("long")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, shard_bytes: int = SHARD_BYTES, partition_rows: int = PARTITION_ROWS):
    """(id1, id2, id3, a) of all phrases of two words (id3 = 0) or three that occur ``least`` times; the numbered words; (lang, n)."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = sharded(docs, [lang.alias("lang")], F.col(f"`{text_col}`"), shard_bytes).select("shard", "lang", "text")
    words = stored(per_shard(rows, _shard_words, "lang string, word string, shard int, n long"), "words")
    n = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    known = stored(numbered(frequent), "dictionary")
    freed(docs.sparkSession)
    total = n.agg(F.sum("n")).first()[0] or 0
    parts = max(1, ceil(2 * total / partition_rows))
    side = words.select("shard", "lang", "word").join(known, ["lang", "word"]).select("shard", "lang", "word", "id", "at", "width", "within")
    grams = with_side(rows, side, _shard_ngrams(parts), "part int, hi long, lo long, n long")
    counted = grams.repartitionById(parts, "part").select("hi", "lo", "n").mapInArrow(_count_runs(least), "id1 long, id2 long, id3 long, a long")
    counted = stored(counted, "phrases")
    discarded(words)
    freed(docs.sparkSession)
    return counted, known, n


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, share: int = SHARE, **sizes) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of two words goes if a phrase of three words with it inside occurs in at
    least ``share`` per cent of its places.
    """
    counted, known, n = phrases(docs, lang_col, text_col, least, **sizes)
    total = counted.count()
    word = lambda i: known.select(F.col("id").alias("key"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
    named = looked_up(looked_up(counted, F.col("id1"), word(1), total), F.col("id2"), word(2), total)
    twos = named.filter("id3 = 0")
    pair = twos.select(F.struct("id1", "id2").alias("key"), "a")  # candidates, many fewer than the n-grams
    threes = looked_up(named.filter("id3 > 0"), F.col("id3"), word(3), total)
    threes = looked_up(threes, F.struct("id1", "id2"), pair.withColumnRenamed("a", "a12"), total)
    threes = looked_up(threes, F.struct(F.col("id2").alias("id1"), F.col("id3").alias("id2")), pair.withColumnRenamed("a", "a23"), total)
    inside = threes.select("id1", "id2", "a").unionByName(threes.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a"))
    longest = inside.groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    twos = twos.join(longest, ["id1", "id2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    columns = ("lang", "phrase", "a", "l", "r", "score")
    two = twos.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    cuts = threes.withColumns({"s1": _score("a", "f1", "a23"), "s2": _score("a", "a12", "f3")})
    late = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(late, F.col(x)).otherwise(F.col(y))
    three = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("a12", "f1").alias("l"), pick("f3", "a23").alias("r"), pick("s2", "s1").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = two.select(*columns).unionByName(three.select(*columns)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir) -> DataFrame:
    """The collocations of all documents by language."""
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer o ON c.k = 2 AND o.lang = c.lang AND o.part = c.phrase
  WHERE o.a IS NULL OR 100 * o.a < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
