"""Rule-based classification of texts as column expressions.

Rules are (label, pattern, weight) in order; the score of a label is the weighted number
of matches of its patterns, and ties go to the label that comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, float]

# What papers and questions are recognised by.
SECTIONS: list[Rule] = [
    ("abstract", r"\b(?:abstract|summary|background|objective)\b", 1.0),
    ("introduction", r"\b(?:introduction|rationale|aim)\b", 1.0),
    ("methods", r"\b(?:methods?|materials|participants|inclusion|randomi[sz]ed)\b", 1.0),
    ("results", r"\b(?:results?|findings|outcomes?|significant)\b", 1.0),
    ("discussion", r"\b(?:discussion|limitations?|implications)\b", 1.0),
    ("conclusion", r"\b(?:conclusions?|conclude|in summary)\b", 1.0),
]
TIERS = {"abstract": 1, "results": 1, "conclusion": 1}
SUB_DOMAINS: list[Rule] = [
    ("Degenerative", r"\b(?:stenosis|disc herniation|spondylolisthesis|degenerative)\b", 1.0),
    ("Deformity", r"\b(?:scoliosis|kyphosis|deformity|ais|asd)\b", 1.0),
    ("Trauma", r"\b(?:fracture|trauma|injury|burst)\b", 1.0),
    ("Tumor", r"\b(?:tumou?r|metasta\w+|cancer)\b", 1.0),
    ("Basic Science", r"\b(?:in vitro|animal model|cell|biomechanic\w*)\b", 1.0),
]
# Designs by the names that they go by, hyphens and underscores read as spaces. Phrases are looked for before single words.
DESIGN_PHRASES = {
    "other": ["non randomized", "non randomised", "nonrandomized", "nonrandomised"],
    "meta-analysis": ["meta analysis", "metaanalysis"],
    "systematic-review": ["systematic review"],
    "RCT": ["randomized", "randomised", "rct"],
    "prospective-cohort": ["prospective cohort"],
    "retrospective-cohort": ["retrospective cohort"],
    "case-control": ["case control"],
    "cross-sectional": ["cross sectional"],
    "case-series": ["case series"],
    "case-report": ["case report"],
}
DESIGN_WORDS = {"retrospective": "retrospective-cohort", "prospective": "prospective-cohort", "cohort": "retrospective-cohort", "expert opinion": "expert-opinion", "editorial": "expert-opinion"}
# Whole names and abbreviations that stand for a design.
DESIGN_ALIASES = {
    "ma": "meta-analysis", "sr": "systematic-review", "trial": "RCT", "controlled trial": "RCT", "observational": "retrospective-cohort", "longitudinal": "prospective-cohort",
    "survey": "cross-sectional", "case study": "case-report", "commentary": "expert-opinion", "letter": "expert-opinion", "narrative review": "expert-opinion",
}
QUERY_TYPES: list[tuple[str, str]] = [
    ("comparative", r"\bvs\b|\bversus\b|\bcompar(?:e|ison)\b|\bdifference between\b"),
    ("evidence", r"\bevidence (?:for|of)\b|\bproven to\b|\bstatistically significant\b|\bp-value\b"),
    ("factual", r"\bhow (?:much|many|high|low)\b|\b\w+ rate\b|\bpercentage of\b"),
    ("procedural", r"\bhow to\b|\bsteps? (?:of|for|to)\b|\btechnique (?:for|of)\b|\bprocedure\b"),
]
COMMENTS: list[tuple[str, str]] = [
    ("statistics", r"statistic|p-value|sample size|confidence interval"),
    ("data", r"\bdata\b|table|figure"),
    ("writing", r"grammar|typo|wording|unclear"),
    ("major", r"major|must|fundamental"),
]
LEVEL_BY_DESIGN = {
    "meta-analysis": "1a", "systematic-review": "1a", "RCT": "1b", "prospective-cohort": "2b", "retrospective-cohort": "3",
    "case-control": "3", "cross-sectional": "4", "case-series": "4", "case-report": "5", "expert-opinion": "5",
}


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern occurs in a lower-cased text."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def scores(text: Column, rules: Sequence[Rule]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for label, pattern, weight in rules:
        part = matches(text, pattern) * F.lit(float(weight))
        out[label] = out[label] + part if label in out else part
    return out


def best(text: Column, rules: Sequence[Rule], default: str) -> Column:
    """Struct: the label of the highest score, and its share of all scores; the default at score zero."""
    by = scores(text, rules)
    total = sum(by.values(), F.lit(0.0))
    top = F.greatest(*by.values()) if len(by) > 1 else next(iter(by.values()))
    label = F.lit(default)
    for name in reversed(list(by)):
        label = F.when((by[name] == top) & (top > 0), name).otherwise(label)
    return F.struct(label.alias("label"), F.round(F.when(total > 0, top / total).otherwise(0.0), 6).alias("confidence"))


def first(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that occurs."""
    out = F.lit(default)
    for label, pattern in reversed(list(rules)):
        out = F.when(F.lower(text).rlike(pattern), label).otherwise(out)
    return out


def study_design(text: Column) -> Column:
    """Canonical study design: a whole name or abbreviation, else a phrase, else a word; empty for an empty text, other where nothing fits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[-_\s]+", " "))
    out = F.when(F.coalesce(plain, F.lit("")) == "", "")
    for name, label in DESIGN_ALIASES.items():
        out = out.when(plain == name, label)
    for label, names in DESIGN_PHRASES.items():
        out = out.when(plain.rlike("|".join(names)), label)
    for name, label in DESIGN_WORDS.items():
        out = out.when(F.contains(plain, F.lit(name)), label)
    return out.otherwise("other")


def level_of_design(design: Column) -> Column:
    out = F.lit("5")
    for name, level in LEVEL_BY_DESIGN.items():
        out = F.when(design == name, level).otherwise(out)
    return out


def section(text: Column, position: Column) -> Column:
    """Struct section, tier and confidence: keyword scores, with a bonus where the place in the document fits."""
    ranges = {"abstract": (0.0, 0.1), "introduction": (0.05, 0.25), "methods": (0.15, 0.45), "results": (0.35, 0.75), "discussion": (0.55, 0.9), "conclusion": (0.8, 1.0)}
    by = scores(text, SECTIONS)
    total = F.greatest(sum(by.values(), F.lit(0.0)), F.lit(1.0))
    mixed = {n: 0.8 * c / total + 0.2 * F.when(position.between(*ranges[n]), 1.0).otherwise(0.0) for n, c in by.items()}
    top = F.greatest(*mixed.values())
    label = F.lit("other")
    for name in reversed(list(mixed)):
        label = F.when((mixed[name] == top) & (top >= 0.3), name).otherwise(label)
    tier = F.when(label.isin(*TIERS), 1).otherwise(2)
    return F.struct(label.alias("section"), tier.alias("tier"), F.round(top, 6).alias("confidence"))
