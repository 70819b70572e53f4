"""Citations matched to papers, beside the oracle that compares every citation with every paper.

A paper is a document: its first words are the title, the order of its number gives the year
and the customer and nation that stand for authors. Every document is cited once, by a
reference that garbles or lacks some of these.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import linkage
from evispark.sources import tables as t


def papers(s, d):
    o, c, n = t.table(s, d, "orders"), t.table(s, d, "customer"), t.table(s, d, "nation")
    who = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    record = who.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), F.array("c_name", "n_name").alias("authors"))
    k = F.col("paper_id")
    title = F.array_join(F.slice(F.split("text", " ", 13), 1, 12), " ")
    docs = t.table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 11 != 3, title).alias("title"))
    return docs.join(record, "paper_id").withColumn("identifier", F.when(k % 5 == 0, F.concat(F.lit("Id:"), k.cast("string"))))


def citations(s, d):
    k = F.col("paper_id")
    words = F.split("title", " ")
    title = F.array_join(F.concat(F.slice(words, 3, 12), F.slice(words, 1, 1)), " ")
    author = F.when(k % 4 == 1, F.concat(F.lit("#"), F.substring(F.element_at("authors", 1), 10, 9))).otherwise(F.upper(F.element_at("authors", 1)))
    return papers(s, d).select(
        k.alias("citation_id"),
        F.when(k % 10 == 0, F.concat(F.lit(" ID:"), k.cast("string"))).alias("identifier"),
        F.when(k % 13 != 5, F.when(k % 6 == 2, F.array(author, F.lit("nobody"))).otherwise(F.array(author))).alias("authors"),
        F.when(k % 17 != 6, F.col("year") + F.when(k % 3 == 1, 1).otherwise(0)).alias("year"),
        F.when(k % 7 != 1, title).alias("title"),
    )


def matched(s, d):
    return linkage.match_citations(citations(s, d), papers(s, d))


QUERIES = {"join_citation_linkage": matched}

_words = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')))"
ORACLE = {
    "join_citation_linkage": f"""WITH p AS (
  SELECT doc_id AS paper_id, CASE WHEN doc_id % 11 <> 3 THEN array_to_string(string_split(text, ' ')[1:12], ' ') END AS title,
    CAST(year(o_orderdate) AS INT) AS year, [c_name, n_name] AS authors, CASE WHEN doc_id % 5 = 0 THEN 'Id:' || doc_id END AS identifier
  FROM documents JOIN orders ON o_orderkey = doc_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
c AS (
  SELECT paper_id AS citation_id, CASE WHEN paper_id % 10 = 0 THEN ' ID:' || paper_id END AS identifier,
    CASE WHEN paper_id % 4 = 1 THEN '#' || substr(authors[1], 10, 9) ELSE upper(authors[1]) END AS author,
    CASE WHEN paper_id % 13 = 5 THEN CAST([] AS VARCHAR[]) WHEN paper_id % 6 = 2 THEN [lower(author), 'nobody'] ELSE [lower(author)] END AS authors,
    CASE WHEN paper_id % 17 <> 6 THEN year + CASE WHEN paper_id % 3 = 1 THEN 1 ELSE 0 END END AS year,
    CASE WHEN paper_id % 7 <> 1 THEN array_to_string(list_concat(string_split(title, ' ')[3:14], string_split(title, ' ')[1:1]), ' ') END AS title FROM p),
pw AS (SELECT paper_id, lower(trim(identifier)) AS identifier, list_transform(authors, lambda x: lower(x)) AS authors, year, {_words.format('title')} AS words FROM p),
cw AS (SELECT citation_id, lower(trim(identifier)) AS identifier, authors, year, {_words.format('title')} AS words FROM c),
m AS (
  SELECT citation_id, paper_id, pw.words AS paper_words, cw.words AS words, cw.year AS year, pw.year AS paper_year, cw.authors AS authors, pw.authors AS paper_authors,
    coalesce(cw.identifier = pw.identifier, false) AS named, len(list_intersect(cw.words, pw.words)) AS common,
    common / greatest(len(cw.words) + len(pw.words) - common, 1) AS similarity FROM cw, pw),
s AS (
  SELECT *, CASE WHEN year = paper_year THEN 0.4::DOUBLE WHEN abs(year - paper_year) = 1 THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS of_year,
    len(list_filter(authors, lambda a: contains(paper_authors[1], a) OR contains(paper_authors[2], a))) * 0.6::DOUBLE / greatest(len(authors), 1) AS of_authors,
    CASE WHEN year IS NULL THEN 0::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN len(authors) = 0 THEN 0::DOUBLE ELSE 0.6::DOUBLE END AS most,
    CASE WHEN named THEN 1
      WHEN len(authors) > 0 AND year = paper_year AND contains(array_to_string(paper_authors, ' '), authors[1]) AND (similarity > 0.6 OR len(words) = 0 OR len(paper_words) = 0) THEN 2
      WHEN similarity > 0.6 AND (year IS NULL OR abs(year - paper_year) <= 1) THEN 3 END AS way FROM m),
r AS (
  SELECT *, CASE WHEN most > 0 THEN round((of_year + of_authors) / most, 6) ELSE 0.5 END AS confidence FROM s WHERE way IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY way, confidence DESC, round(similarity, 6) DESC, paper_id) AS place FROM r)
SELECT citation_id, paper_id, ['identifier', 'author', 'title'][way] AS method, confidence, round(similarity, 6) AS similarity FROM w WHERE place = 1""",
}
