"""Record linkage: the paper that a citation means, found by several blocking keys and scored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.search import prefix_keys
from evispark.sources.staging import staged

LEAST = 0.6  # titles are alike above this similarity of their words
YEAR, AUTHORS = 0.4, 0.6  # weights of the year and of the authors; a year off by one counts half
GRAM = 8  # letters of the pieces on which authors meet; with fewer, ever more papers of a year share one
HOT = 1000  # papers are looked up by an author who has up to so many records; by title and author for others


def _low(c: str | Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low != "", low)


def _authors(c: str) -> Column:
    """Lower-cased names without null or blank ones; no list: none."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def title_words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def grams(text: Column, sizes: list[int]) -> Column:
    """All distinct pieces of the given lengths of a text."""
    one = lambda q: F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(one(q) for q in sizes)))


def _classes(rows: DataFrame, key: str) -> DataFrame:
    """Records of equal authors, year and title words as one, named by their smallest key."""
    return rows.groupBy("authors", "year", "words").agg(F.min(key).alias(key)).withColumn("n", F.size("words")).withColumn("names", F.concat_ws(" ", "authors"))


def _alike_titles(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """(cited_set, paper_set) of distinct sets of title words (id, words) that are alike: prefix filter over words from rare to common, on both tables."""
    both = cited.select(F.lit(0).alias("side"), "id", "words").unionByName(papers.select(F.lit(1).alias("side"), "id", "words"))
    words = both.select("side", "id", F.explode("words").alias("word"))
    frequency = words.groupBy("word").agg(F.count("*").alias("df"))
    ordered = words.join(frequency, "word").groupBy("side", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x.word).alias("items"))
    met = ordered.withColumn("n", F.size("items")).select("side", "id", "n", F.explode(prefix_keys(LEAST)).alias("e"))
    left = met.filter("side = 0").select("e", F.col("id").alias("cited_set"), F.col("n").alias("n_cited"))
    right = met.filter("side = 1").select("e", F.col("id").alias("paper_set"), "n")
    fits = (F.col("n") >= LEAST * F.col("n_cited")) & (F.col("n_cited") >= LEAST * F.col("n"))
    pairs = left.join(right, "e").filter(fits).select("cited_set", "paper_set").distinct()
    own, other = cited.select(F.col("id").alias("cited_set"), "words"), papers.select(F.col("id").alias("paper_set"), F.col("words").alias("paper_words"))
    return pairs.join(own, "cited_set").join(other, "paper_set").filter(_similarity("words", "paper_words") > LEAST).select("cited_set", "paper_set")


def _author_names(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """(author, names, n): a citation's author, and the joined authors of ``n`` records of papers that hold it.

    An author meets papers on the piece of its name that is rarest among theirs; a name
    shorter than a piece is a piece itself.
    """
    who = cited.select(F.explode("authors").alias("author")).distinct()
    sizes = sorted(r.size for r in who.select(F.least(F.length("author"), F.lit(GRAM)).alias("size")).distinct().collect()) or [GRAM]  # up to GRAM numbers
    names = papers.filter("size(authors) > 0").groupBy("names").agg(F.count("*").alias("n"))
    have = names.select("names", "n", F.explode(grams(F.col("names"), sizes)).alias("gram"))
    frequency = have.groupBy("gram").agg(F.count("*").alias("df"))
    pieces = F.when(F.length("author") < GRAM, F.array("author")).otherwise(grams(F.col("author"), [GRAM]))
    rare = who.select("author", F.explode(pieces).alias("gram")).join(frequency, "gram").groupBy("author").agg(F.min(F.struct("df", "gram")).alias("x")).select("author", "x.gram")
    rare = staged(rare, "rare-pieces")
    # pieces of most names that are no author's rarest would go to one task each; they are fewer than a thousandth of all
    idle = F.broadcast(frequency.filter(F.col("df") > HOT).select("gram").join(rare, "gram", "left_anti"))
    return rare.join(have.join(idle, "gram", "left_anti"), "gram").filter(F.contains("names", F.col("author"))).select("author", "names", "n")


def _near(year: str, paper_year: str) -> Column:
    """Years at most one apart, or one unknown."""
    return F.coalesce(F.abs(F.col(year) - F.col(paper_year)) <= 1, F.lit(True))


def _by_title(cited: DataFrame, papers: DataFrame, hot: DataFrame) -> DataFrame:
    """(citation_id, paper_id) whose titles are alike: of each set of title words and year near enough the first paper, and all papers with a ``hot`` author of the citation.

    Without an author in common only year, title and number tell papers apart, so the first stands for all.
    """
    first = lambda rows, key: rows.filter("n > 0").groupBy("words").agg(F.min(key).alias("id"))
    own, other = staged(first(cited, "citation_id"), "cited-titles"), staged(first(papers, "paper_id"), "titles")
    alike = _alike_titles(own, other)
    placed = papers.join(other, "words").select(F.col("id").alias("paper_set"), F.col("year").alias("paper_year"), "names", "paper_id")
    asked = staged(cited.join(own, "words").select("citation_id", "year", "authors", F.col("id").alias("cited_set")).join(alike, "cited_set"), "alike-titles")
    stand = placed.groupBy("paper_set", "paper_year").agg(F.min("paper_id").alias("paper_id"))
    some = asked.join(stand, "paper_set").filter(_near("year", "paper_year")).select("citation_id", "paper_id")
    known = placed.join(hot.select("author", "names"), "names").select("paper_set", "author", "paper_year", "paper_id")
    by_hot = asked.select("citation_id", "year", "paper_set", F.explode("authors").alias("author")).join(known, ["paper_set", "author"]).filter(_near("year", "paper_year"))
    return some.unionByName(by_hot.select("citation_id", "paper_id")).distinct()


def _without_title(cited: DataFrame, papers: DataFrame, hot: DataFrame) -> DataFrame:
    """(citation_id, paper_id) of one year where either lacks a title and the first author, a ``hot`` one, is among the paper's."""
    first = cited.filter("size(authors) > 0 AND year IS NOT NULL").select("citation_id", "year", F.col("n").alias("n_cited"), F.element_at("authors", 1).alias("author"))
    have = papers.join(hot.select("author", "names"), "names").select("author", "year", "n", "paper_id")
    both = [first.filter("n_cited = 0").join(have, ["author", "year"]), first.filter("n_cited > 0").join(have.filter("n = 0"), ["author", "year"])]
    return both[0].unionByName(both[1]).select("citation_id", "paper_id").distinct()


def _similarity(words: str, paper_words: str) -> Column:
    common = F.size(F.array_intersect(words, paper_words))
    return F.round(common / F.greatest(F.size(words) + F.size(paper_words) - common, F.lit(1)), 6)


def confidence(authors: Column, year: Column, paper_authors: Column, paper_year: Column) -> Column:
    """Year and authors that agree, by weight, over what the citation gives; 0.5 where it gives neither."""
    off = F.abs(year - paper_year)
    of_year = F.when(off == 0, YEAR).when(off == 1, YEAR / 2).otherwise(0.0)
    hits = F.size(F.filter(authors, lambda a: F.exists(paper_authors, lambda p: F.contains(p, a))))
    of_authors = AUTHORS * hits / F.greatest(F.size(authors), F.lit(1))
    most = F.when(year.isNotNull(), YEAR).otherwise(0.0) + F.when(F.size(authors) > 0, AUTHORS).otherwise(0.0)
    return F.when(most > 0, F.round((of_year + of_authors) / most, 6)).otherwise(0.5)


def match_citations(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """The paper of each citation: (citation_id, paper_id, method, confidence, similarity); citations without one are left out.

    ``citations`` (citation_id) and ``papers`` (paper_id) have identifier, authors (list of
    names), year and title; any may be null, and both keys are unique. In this order counts:

    * ``identifier``: equal identifiers, case and outer blanks aside; of papers that share one, the first;
    * ``author``: the same year, the first author within the paper's authors, and titles alike
      (more than ``LEAST`` of their words shared), or one without a title;
    * ``title``: titles alike, and years at most one apart or one unknown.

    Then the higher confidence wins, the higher similarity, the smaller paper_id. Equal
    records are compared once. Papers that hold one of a citation's authors are looked at
    first; only citations that a paper without these could still match better go on to those
    of like titles. Authors of more than ``HOT`` records are met within like titles only.
    Only keys and identifiers travel until the pairs are distinct.
    """
    shape = lambda rows, key: staged(rows.select(key, _low("identifier").alias("key"), _authors("authors").alias("authors"), F.col("year").cast("int").alias("year"), F.array_sort(title_words("title")).alias("words")), "records")
    given, own = shape(citations, "citation_id"), shape(papers, "paper_id")
    known = own.filter("key IS NOT NULL").groupBy("key").agg(F.min("paper_id").alias("paper_id"))
    sure = given.filter("key IS NOT NULL").join(known, "key").select("citation_id", "paper_id")
    rest = given.join(sure, "citation_id", "left_anti")
    cited, have = staged(_classes(rest, "citation_id"), "cited"), staged(_classes(own, "paper_id"), "citable")  # each read several times
    names = staged(_author_names(cited, have), "author-names")
    hot = names.groupBy("author").agg(F.sum("n").alias("records")).filter(F.col("records") > HOT).select("author")
    many, few = names.join(hot, "author"), names.join(hot, "author", "left_anti")
    asked = cited.select("citation_id", F.col("year").alias("asked"), F.explode("authors").alias("author")).join(few, "author")
    met = asked.join(have, "names").filter(_near("asked", "year")).select("citation_id", "paper_id").distinct()
    early = staged(_best(met, cited, have), "first-matches")
    # a paper without an author of the citation has its year at most, and isn't matched by author
    most = F.when(F.col("year").isNotNull(), YEAR / (YEAR + AUTHORS)).otherwise(0.0)
    frequent = cited.select("citation_id", F.explode("authors").alias("author")).join(hot, "author").select("citation_id").distinct()
    settled = early.join(cited.filter("size(authors) > 0"), "citation_id").filter((F.col("x.method") == "author") | (-F.col("x.c") > F.round(most, 6))).select("citation_id")
    open_ = staged(cited.join(settled.join(frequent, "citation_id", "left_anti"), "citation_id", "left_anti"), "open-citations")
    late = _by_title(open_, have, many).unionByName(_without_title(open_, have, many)).distinct()
    found = early.unionByName(_best(late, open_, have)).groupBy("citation_id").agg(F.min("x").alias("x"))
    won = found.select(F.col("citation_id").alias("class_id"), "x.paper_id", "x.method", (-F.col("x.c")).alias("confidence"), (-F.col("x.s")).alias("similarity"))
    same = ["authors", "year", "words"]
    members = rest.alias("m").join(cited.withColumnRenamed("citation_id", "class_id").alias("k"), [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in same]).select("citation_id", "class_id")
    told = _scored(sure, given, own).select("citation_id", "paper_id", F.lit("identifier").alias("method"), "confidence", "similarity")
    return told.unionByName(members.join(won, "class_id").drop("class_id"))


def _best(pairs: DataFrame, cited: DataFrame, papers: DataFrame) -> DataFrame:
    """(citation_id, x) of each citation that a paper of its pairs matches, ``x`` being the best: method, confidence and similarity with less for more, paper_id."""
    alike = F.col("similarity") > LEAST
    by_author = (F.col("year") == F.col("paper_year")) & F.contains(F.concat_ws(" ", "paper_authors"), F.element_at("authors", 1)) & (alike | (F.size("words") == 0) | (F.size("paper_words") == 0))
    method = F.when(F.when(F.size("authors") > 0, by_author).otherwise(False), "author").when(alike & _near("year", "paper_year"), "title")
    found = _scored(pairs, cited, papers).withColumn("method", method).filter("method IS NOT NULL")
    return found.groupBy("citation_id").agg(F.min(F.struct("method", (-F.col("confidence")).alias("c"), (-F.col("similarity")).alias("s"), "paper_id")).alias("x"))


def _scored(pairs: DataFrame, cited: DataFrame, papers: DataFrame) -> DataFrame:
    """Pairs with both records, their confidence and the similarity of their titles."""
    other = papers.select("paper_id", F.col("authors").alias("paper_authors"), F.col("year").alias("paper_year"), F.col("words").alias("paper_words"))
    rows = pairs.join(cited.select("citation_id", "authors", "year", "words"), "citation_id").join(other, "paper_id")
    return rows.withColumn("similarity", _similarity("words", "paper_words")).withColumn("confidence", confidence(F.col("authors"), F.col("year"), F.col("paper_authors"), F.col("paper_year")))
