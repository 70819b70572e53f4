"""Clinical recommendation: rules, evidence and fit for each patient and candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.levels import CLINICAL, weight

#: Comparison operators that rules may use.
OPERATORS = {"eq": lambda a, b: a == b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b}


def matched_rules(patients: DataFrame, rules: DataFrame, traits: list[str]) -> DataFrame:
    """(patient_id, intervention, kind, factor) for every rule whose condition the patient meets.

    ``rules`` has (intervention, trait, op, value, kind, factor). Traits become rows, so a
    rule meets patients in an equi-join on the trait's name.
    """
    rows = patients.select("patient_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, traits)), F.array(*(F.col(t).cast("double") for t in traits)))).alias("trait", "have"))
    met = F.lit(False)
    for name, test in OPERATORS.items():
        met = met | ((F.col("op") == name) & test(F.col("have"), F.col("value")))
    return rows.join(rules, "trait").filter(met).select("patient_id", "intervention", "kind", "factor")


def evidence_scores(facts: DataFrame) -> DataFrame:
    """Mean level weight of an intervention's findings, times 1.3 where significant, each at most 1."""
    score = F.least(F.lit(1.0), weight("evidence_level", CLINICAL, 0.1) * F.when(F.col("is_significant"), 1.3).otherwise(1.0))
    return facts.groupBy("intervention").agg(F.avg(score).alias("evidence_score"))


def recommend(candidates: DataFrame, matched: DataFrame, evidence: DataFrame, fit: DataFrame) -> DataFrame:
    """(patient_id, intervention, score, verdict): 0 and contraindicated at an absolute rule, alternative at a relative one.

    ``candidates`` has (patient_id, intervention, first_line); safety is one over the
    product of risk factors; without evidence the evidence score is 0.3.
    """
    product = F.exp(F.sum(F.when(F.col("kind") == "risk", F.log("factor")).otherwise(0.0)))
    flags = matched.groupBy("patient_id", "intervention").agg(
        F.count_if(F.col("kind") == "absolute").alias("n_absolute"), F.count_if(F.col("kind") == "relative").alias("n_relative"), product.alias("risk")
    )
    x = candidates.join(flags, ["patient_id", "intervention"], "left").join(evidence, "intervention", "left").join(fit, ["patient_id", "intervention"], "left")
    n_abs, n_rel = F.coalesce("n_absolute", F.lit(0)), F.coalesce("n_relative", F.lit(0))
    base = 0.4 * F.coalesce("evidence_score", F.lit(0.3)) + 0.3 / F.coalesce("risk", F.lit(1.0)) + 0.3 * F.coalesce("fit_score", F.lit(0.5))
    score = F.when(n_abs > 0, 0.0).otherwise(base * F.when(F.col("first_line"), 1.2).otherwise(1.0) * F.pow(F.lit(0.9), n_rel))
    verdict = F.when(n_abs > 0, "contraindicated").when(n_rel > 0, "alternative").otherwise("recommended")
    return x.select("patient_id", "intervention", F.round(score, 6).alias("score"), verdict.alias("verdict"))
