"""Extraction of statistics, citations and study elements with their places in the text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NUMBER = r"(\d+(?:\.\d+)?)"
_BOUNDS = rf"(?:\s*[(,]?\s*(?:95\s*%\s*)?CI[\s:,=]*{_NUMBER}\s*(?:-|–|to)\s*{_NUMBER})?"
KINDS = {
    "hazard_ratio": re.compile(rf"\b(?:a?HR|hazard ratio)\s*[=:]?\s*{_NUMBER}{_BOUNDS}", re.I),
    "odds_ratio": re.compile(rf"\b(?:a?OR|odds ratio)\s*[=:]?\s*{_NUMBER}{_BOUNDS}"),
    "relative_risk": re.compile(rf"\b(?:RR|relative risk|risk ratio)\s*[=:]?\s*{_NUMBER}{_BOUNDS}", re.I),
    "percentage": re.compile(rf"{_NUMBER}\s*%(?!\s*CI)"),
}
P_VALUE = re.compile(r"\bp\s*(?:-?\s*value)?\s*([=<>])\s*(0?\.\d+|[01](?:\.\d+)?)", re.I)
LINK = 100  # characters between a statistic and the p-value that goes with it

CITATION = re.compile(
    r"\[(?P<number>\d+(?:\s*[,-]\s*\d+)*)\]"
    r"|\((?P<paren>[A-Z][\w'-]+(?:\s+(?:et al\.?|and\s+[A-Z][\w'-]+))?,?\s+(?:19|20)\d{2}[a-z]?)\)"
    r"|(?P<narrative>[A-Z][\w'-]+(?:\s+et al\.?|\s+and\s+[A-Z][\w'-]+)?\s+\((?:19|20)\d{2}[a-z]?\))"
)
PICO = {
    "population": re.compile(r"\b(\d+\s+(?:adult\s+|elderly\s+)?(?:patients|participants|subjects|adults|women|men|children)(?:\s+with\s+[\w -]{3,60}?)?)(?=[.,;]|\s+(?:were|who|underwent)\b|$)", re.I),
    "intervention": re.compile(r"\b(?:underwent|treated with|received|assigned to)\s+([\w -]{3,60}?)(?=[.,;]|\s+(?:or|versus|vs|and|for|compared)\b|$)", re.I),
    "comparison": re.compile(r"\b(?:compared (?:with|to)|versus|vs\.?)\s+([\w -]{3,60}?)(?=[.,;]|\s+(?:in|for|on)\b|$)", re.I),
    "outcome": re.compile(r"\b(?:primary outcome(?: measure)? was|outcomes? included|improved|reduced)\s+([\w -]{3,60}?)(?=[.,;]|$)", re.I),
}
MOST = {"population": 5, "intervention": 5, "comparison": 3, "outcome": 5}


def statistics(text: str | None) -> list[dict]:
    """Statistics in order of place: kind, value, interval, linked p-value, direction, significance."""
    text = text or ""
    ps = [(m.start(), m.end(), m[1], float(m[2])) for m in P_VALUE.finditer(text)]
    found: dict[tuple[int, int], dict] = {}
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text):
            if any(s <= m.start() < e for s, e in found):
                continue
            low, high = (float(m[2]), float(m[3])) if kind != "percentage" and m[2] else (None, None)
            near = [(min(abs(s - m.end()), abs(m.start() - e)), p) for s, e, _, p in ps]
            distance, p = min(near, default=(LINK, None))
            p = p if distance < LINK else None
            value = float(m[1])
            direction = None if kind == "percentage" else "decreased" if value < 1 else "increased" if value > 1 else "neutral"
            by_interval = None if low is None else not low <= 1 <= high
            found[m.span()] = {"kind": kind, "value": value, "low": low, "high": high, "p_value": p, "direction": direction, "significant": p < 0.05 if p is not None else by_interval, "start": m.start(), "end": m.end()}
    return [found[k] for k in sorted(found)]


def citations(text: str | None) -> list[dict]:
    """Citation markers with authors and year where the marker has them, and the text around."""
    text, out = text or "", []
    for m in CITATION.finditer(text):
        style = m.lastgroup
        year = re.search(r"(19|20)\d{2}", m[0]) if style != "number" else None
        author = re.match(r"\(?([A-Z][\w'-]+)", m[0]) if style != "number" else None
        out.append({"style": style, "marker": m[0], "author": author[1] if author else None, "year": int(year[0]) if year else None, "start": m.start(), "end": m.end(), "context": text[max(0, m.start() - 50) : m.end() + 50]})
    return out


def study_elements(text: str | None) -> list[dict]:
    """Population, intervention, comparison and outcome phrases, a few of each kind, without repeats."""
    text, out = text or "", []
    for kind, pattern in PICO.items():
        seen: set[str] = set()
        for m in pattern.finditer(text):
            phrase = re.sub(r"\s+", " ", m[1]).strip()
            if phrase.lower() not in seen and len(seen) < MOST[kind]:
                seen.add(phrase.lower())
                out.append({"kind": kind, "phrase": phrase, "start": m.start(1), "end": m.end(1)})
    return out


STATISTICS = "kind string, value double, low double, high double, p_value double, direction string, significant boolean, start int, end int"
CITATIONS = "style string, marker string, author string, year int, start int, end int, context string"
ELEMENTS = "kind string, phrase string, start int, end int"


def extract(docs: DataFrame, fn: Callable[[str | None], list[dict]], ddl: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each thing found in each text, batch-wise in Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [{id_col: i} | x for i, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()) for x in fn(text)]
            for a in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[a : a + 5000], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
