"""Key phrases and descriptions of all documents, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import describe
from evispark.sources import tables as t


def _docs(s, d):
    return t.spread(t.table(s, d, "documents").select("doc_id", "text", "source"))


def key_phrases(s, d):
    return describe.key_phrases(_docs(s, d))


def descriptions(s, d):
    """Every document's description, lists as joined strings and counts."""
    found = describe.describe(_docs(s, d))
    n = lambda c: F.size(c).alias(f"n_{c}")
    return found.select("doc_id", "summary", "title", F.array_join("key_phrases", "|").alias("key_phrases"), n("p_values"), n("effect_sizes"), n("intervals"), n("sample_sizes"), "content_type", "is_key_finding")


QUERIES = {"text_key_phrases": key_phrases, "text_descriptions": descriptions}

_PHRASES = r"""d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[.,;:!?()\n\r]+'), lambda x: trim(x) <> '') AS sentences FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(unnest(sentences)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM d),
o AS (
  SELECT doc_id, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT doc_id, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) FROM w
  UNION ALL SELECT doc_id, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) FROM w),
c AS (SELECT doc_id, k, phrase, count(*) AS tf FROM o GROUP BY ALL),
f AS (SELECT phrase, count(*) AS df FROM c GROUP BY phrase),
s AS (SELECT doc_id, phrase, round(tf * k * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS score FROM c JOIN f USING (phrase) WHERE tf > 1 OR k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS place FROM s WHERE score > 0),
top AS (SELECT doc_id, phrase, score, place FROM r WHERE place <= 10)"""
ORACLE = {
    "text_key_phrases": f"WITH {_PHRASES} SELECT doc_id, phrase, score, place FROM top",
    "text_descriptions": rf"""WITH {_PHRASES},
keys AS (SELECT doc_id, list(phrase ORDER BY place) AS keys FROM top GROUP BY doc_id),
whole AS (SELECT d.*, coalesce(keys, CAST([] AS VARCHAR[])) AS keys FROM d LEFT JOIN keys USING (doc_id)),
e AS (SELECT doc_id, keys, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS i FROM whole),
h AS (SELECT doc_id, i, trim(sentence) AS sentence, list_filter(regexp_split_to_array(lower(sentence), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws, keys FROM e),
g AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_filter(keys, lambda k: contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || k || ' '))) DESC, i) AS place FROM h WHERE len(ws) > 0),
n AS (
  SELECT *, len(regexp_extract_all(text, '[pP]\s*[<=]\s*0?\.?\d+')) AS n_p_values,
    len(regexp_extract_all(text, '(?i)\(([A-Z][a-z]+ et al\.?,? \d{{4}})\)')) + len(regexp_extract_all(text, '\[[\d,\s]+\]')) + len(regexp_extract_all(text, '(?i)according to .+? \(\d{{4}}\)'))
      + len(regexp_extract_all(text, '(?i)previous studies? (have |has )?(shown|demonstrated|reported)|prior research|it has been (shown|reported|demonstrated)')) AS citing,
    len(regexp_extract_all(text, '(?i)\b(we found|this study|our (study|results|findings|data|analysis)|in our (cohort|sample|population))\b')) AS own FROM whole)
SELECT n.doc_id, CASE WHEN trim(split_part(text, '.', 1)) <> '' THEN split_part(text, '.', 1) || '.' ELSE substring(text, 1, 200) END AS summary,
  array_to_string(regexp_split_to_array(sentence, '\s+')[1:15], ' ') AS title, array_to_string(keys, '|') AS key_phrases,
  n_p_values, len(regexp_extract_all(text, '(HR|OR|RR|d)\s*[=:]\s*\d+\.?\d*')) AS n_effect_sizes,
  len(regexp_extract_all(text, '(95%?\s*)?CI[:\s]*[\[(]?\d+\.?\d*\s*[-–to]+\s*\d+\.?\d*[\])]?')) AS n_intervals,
  len(regexp_extract_all(text, '[nN]\s*[=:]\s*\d+')) AS n_sample_sizes,
  CASE WHEN own > citing THEN 'original' WHEN citing > 2 THEN 'citation' ELSE 'background' END AS content_type, false AS is_key_finding
FROM n LEFT JOIN (SELECT * FROM g WHERE place = 1) t USING (doc_id)""",
}
