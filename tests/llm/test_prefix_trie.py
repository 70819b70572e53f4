"""The trie of conversations' prefixes against its SQL and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from evispark.llm import prefix_trie as trie
from evispark.llm.prefix_trie import OP13_SQL, as_given, op13_prefix_trie, placed_turns, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children[path]]
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        sums[path] = (sum(x for x, _ in below) or 1, own + sum(x for _, x in below))
    out = []
    for path, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children[path]), *sums[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        hundred = c - c % 100 if c >= 0 else c + (-c) % 100
        out[c] = convs.get(hundred, [])[:h] + own[h:]
    return out


def random_rows(seed, n=300):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        c = draw.choice([0, 1, 2, 3, 99, 100, 105, 199, 250, 251, 777, -5, -100, -150, None])
        rows.append((c, draw.choice([None, 0, 1, 2, 3, 4, 4, 9]), draw.choice([None, "user", "a"]), draw.choice([None, "", "x", "yé", "ǆǆ\U0001f600"])))
    for c in range(300, 360):  # few different turns, so prefixes are shared, and repeated conversations
        for turn in range(draw.randrange(1, 9)):
            rows.append((c, turn, "user", draw.choice("pq")))
    return rows


@pytest.mark.parametrize("seed, block", [(1, None), (2, 2), (3, 1)])
def test_equals_brute_force(spark, seed, block):
    rows = random_rows(seed)
    turns = placed_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    for make, want in ((as_given, brute(ordered(rows))), (rebuilt, brute(brute_rebuilt(ordered(rows))))):
        found = prefix_trie(make(turns), block)
        assert found.columns == COLUMNS
        assert sorted(map(tuple, found.collect())) == want


def test_a_long_conversation_and_a_wide_node(spark):
    """Conversations longer than a block, and a node that most conversations share and end at."""
    rows = [(1, t, "u", f"turn {t}") for t in range(700)] + [(2, t, "u", f"turn {t}") for t in range(650)] + [(c, 0, "u", "turn 0") for c in range(3, 400)]
    found = prefix_trie(as_given(placed_turns(spark.createDataFrame(rows, SCHEMA))), 64)
    assert sorted(map(tuple, found.collect())) == brute(ordered(rows))


def test_op13_equals_its_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_prefix_trie(spark, sf)
    assert got.columns == COLUMNS
    mine = sorted(map(tuple, got.collect()))
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    assert mine == brute(brute_rebuilt(ordered(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert mine == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall())


def test_sql_on_hard_rows():
    rows = random_rows(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()) == brute(brute_rebuilt(ordered(rows)))


def test_empty_table_and_other_columns(spark):
    assert prefix_trie(rebuilt(placed_turns(spark.createDataFrame([], SCHEMA)))).count() == 0
    docs = spark.createDataFrame([(7, 0, "u", "hi", 5, "x")], SCHEMA + ", pos int, depth string")
    assert [tuple(r)[:2] for r in prefix_trie(as_given(placed_turns(docs))).orderBy("depth").collect()] == [(7, 0), (7, 1)]


def test_scan_equals_running_sums(spark):
    from pyspark.sql import functions as F

    rows = [(k, p, (p * 7 + k) % 5) for k in range(3) for p in range(0, 40 * (k + 1), k + 1)]
    frame = spark.createDataFrame(rows, "k long, p long, v long")
    for backwards in (False, True):
        got = {(r.k, r.p): r.s for r in trie.scan(frame, ["k"], "p", {"s": (F.sum, "v", lambda a, b: a + b)}, 8, backwards).collect()}
        assert got == {(k, p): sum(v for x, q, v in rows if x == k and (q >= p if backwards else q <= p)) for k, p, _ in rows}
