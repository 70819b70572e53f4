"""Rounding of doubles equals the SQL's, also just beside a half."""

import math

import duckdb

from evispark.functions.numeric import rounded
from evispark.plans import graph
from pyspark.sql import functions as F


def near_halves():
    halves = [k / 9600 for k in range(3, 800, 6)]  # means of 96 hundredths between two sixth digits
    return [s * y for x in halves for s in (1, -1) for y in (x, math.nextafter(x, 0), math.nextafter(x, 1))]


def test_rounded_equals_the_sql(spark):
    values = near_halves()
    con = duckdb.connect()
    con.execute("CREATE TABLE v (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute("SELECT round(x, 6) FROM v ORDER BY i").fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i")
    got = rows.select(rounded(F.col("x"), 6).alias("got"), F.round("x", 6).alias("text")).collect()
    assert [r.got for r in got] == want
    assert [r.text for r in got] != want  # the digits of the decimal text would say otherwise
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), 6).alias("x")).first().x is None


def test_recommendation_rounds_its_means_so(spark, monkeypatch):
    con = duckdb.connect()
    value = next(x for x in near_halves() if x > 0 and con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] != spark.range(1).select(F.round(F.lit(x), 6)).first()[0])
    want = con.execute("SELECT round(?::DOUBLE, 6)", [value]).fetchone()[0]
    facts = spark.createDataFrame([(1, "A", value)], "intervention long, outcome string, p_value double").withColumn("is_significant", F.col("p_value") < 0.05)
    monkeypatch.setattr(graph.t, "affects", lambda s, d: facts)
    assert graph.recommendation(spark, "").first().mean_p == want
