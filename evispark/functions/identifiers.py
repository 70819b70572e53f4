"""Identifiers, spans and names in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"(10\.\d{4,9}/[-._;()/:a-z0-9]+)"
URL_KINDS = [("patent", r"patents?\."), ("preprint", r"arxiv|biorxiv|medrxiv"), ("pubmed", r"pubmed|ncbi\."), ("news", r"news|times|post"), ("encyclopedia", r"wiki")]


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def doi(text: Column) -> Column:
    """The first DOI, lower-cased, without a closing dot, comma, semicolon or parenthesis."""
    return _empty_to_null(F.regexp_replace(F.regexp_extract(F.lower(text), DOI, 1), r"[.,;)]+$", ""))


def pmid(text: Column) -> Column:
    return _empty_to_null(F.regexp_extract(text, r"(?i)pmid:?\s*(\d{1,8})", 1))


def isbn(text: Column) -> Column:
    return _empty_to_null(F.regexp_replace(F.regexp_extract(text, r"(?i)isbn[-:\s0-9]*?((?:97[89][- ]?)?(?:\d[- ]?){9}[\dx])", 1), r"[- ]", ""))


def year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)


def document_kind(url: Column) -> Column:
    out = F.lit("webpage")
    for label, pattern in reversed(URL_KINDS):
        out = F.when(F.lower(url).rlike(pattern), label).otherwise(out)
    return out


def title_of(html: Column) -> Column:
    return _empty_to_null(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def embedding_input(text: Column, most: int = 30_000) -> Column:
    """What an embedding model is given: white space collapsed, cut at ``most`` characters as the model's input is."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def last_name(author: Column) -> Column:
    """The part before a comma, else the last word that isn't initials."""
    words = F.filter(F.split(F.trim(author), r"\s+"), lambda w: ~w.rlike(r"^[A-Z]{1,3}\.?$"))
    return F.when(author.contains(","), F.trim(F.split(author, ",")[0])).otherwise(F.coalesce(F.element_at(words, -1), author))


def segments(text: Column) -> Column:
    """A spinal range as its segments: L3-5 gives L3-4 and L4-5; anything else gives itself."""
    part = lambda i: F.regexp_extract(text, r"^([CTLS])(\d+)-\1?(\d+)$", i)
    low, high = part(2).try_cast("int"), part(3).try_cast("int")
    each = F.transform(F.sequence(low, high - 1), lambda i: F.concat(part(1), i.cast("string"), F.lit("-"), (i + 1).cast("string")))
    return F.when((part(1) != "") & (low < high), each).otherwise(F.array(text))


def region(text: Column) -> Column:
    """Lumbar, cervical, thoracic or sacral, the first that the text speaks of."""
    low = F.lower(text)
    return F.when(low.rlike(r"lumbar|\bl\d"), "lumbar").when(low.rlike(r"cervical|\bc\d"), "cervical").when(low.rlike(r"thoracic|\bt\d"), "thoracic").when(low.rlike(r"sacral|\bs\d"), "sacral")


def entity_name(text: Column) -> Column:
    """Trimmed; the first letter capitalised unless the whole is in capitals."""
    t = F.trim(text)
    return F.when(t == F.upper(t), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two titles, punctuation aside."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def lucene_escape(text: Column) -> Column:
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")
