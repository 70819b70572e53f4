"""Every query that has an oracle gives the oracle's rows on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from evispark.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = oracle.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_queries_without_an_oracle_are_tested_by_brute_force():
    """These have tests of their own in test_text_queries.py, test_vector_index.py and test_cascade.py."""
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"text_chunks", "text_section_chunks", "text_tiered_chunks", "text_paragraph_chunks", "text_normalize_fuzzy", "text_normalize_candidates", "vector_index_top_k", "text_cascade"}


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry_module.queries())
