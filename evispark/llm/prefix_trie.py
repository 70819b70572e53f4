"""A trie of conversations' prefixes, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns; conversations that start with it are its
members. The largest child of a node, by members, continues the node's path; every other
child starts a path of its own, so a walk from the root crosses at most log2 of the number
of conversations paths. Paths hang on paths: from the deepest level up, the totals of a
level are added to the nodes that its paths hang on, one round a level, and a suffix sum
along each path's array then gives every node's subtree.

A sequence is known by two 64-bit numbers, the exclusive or of hashes of its turns with
their places; so prefixes are running aggregates. These go over blocks of ``BLOCK`` places
and then over blocks, as do the suffix sums: a conversation or a path of any length is no
single task's. Turns are numbered by a range sort and the counts of its partitions. Nodes
that many conversations share are joined where the rows are (``join_on_key``). A node is
named by its least member and its depth.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null
role or text is empty; null turns come first, equal turns are ordered by role and text;
repeated rows are turns of their own; an empty table has no conversation and gives no
row; other columns are ignored. Only the hash of the members that end at one node is made
in one task, as the digest of one string can't be split; it streams and holds one number.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import discarded, join_on_key, read_table, stored

BLOCK = 4096
HEAD = 5  # turns that a conversation takes from another at most
EMPTY = hashlib.sha256(b"").hexdigest()


def scan(rows: DataFrame, keys: list[str], place: str, of: dict[str, tuple], block: int | None = None, backwards: bool = False) -> DataFrame:
    """Running aggregates by place within keys, this place included.

    ``of`` maps a new column to (aggregate, column, function that combines two values).
    Places of a key are distinct. Blocks are aggregated first, then the blocks before each.
    """
    step = F.floor(F.col(place) / F.lit(block or BLOCK))
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    inside = Window.partitionBy(*keys, "__block").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order("__block")).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("__block", step)
    totals = cut.groupBy(*keys, "__block").agg(*(fn(c).alias(f"__{name}") for name, (fn, c, _) in of.items()))
    carry = totals.select(*keys, "__block", F.lit(True).alias("__carried"), F.row_number().over(Window.partitionBy(*keys).orderBy(order("__block"))).alias("__n"), *(fn(f"__{name}").over(before).alias(f"__{name}") for name, (fn, _, _) in of.items()))
    local = cut.withColumns({name: fn(c).over(inside) for name, (fn, c, _) in of.items()})
    met = local.join(carry.filter("__n > 1").drop("__n"), [*keys, "__block"], "left")
    whole = {name: F.when(F.col("__carried"), both(F.col(name), F.col(f"__{name}"))).otherwise(F.col(name)) for name, (_, _, both) in of.items()}
    return met.withColumns(whole).drop("__block", "__carried", *(f"__{name}" for name in of))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, a, b, n_chars): each turn's place, two hashes and code points; texts go no further than the sort."""
    clean = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    keys = ["conv_id", "turn", "role", "text"]
    in_order = clean.repartitionByRange(*keys).sortWithinPartitions(*keys)
    turns = stored(
        in_order.select(
            "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"),
            F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.length("text").cast("long").alias("n_chars"),
        ),
        "turns",
    )
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return turns.join(offset, ["conv_id", "part"]).select("conv_id", (F.col("seq") + F.col("offset")).alias("pos"), "a", "b", "n_chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, n_chars, last): conversations that start with turns of the first of their hundred.

    Conversation c takes the first h = crc32(c) mod 6 turns of conversation c - c mod 100,
    then its own turns after its first h. Depth 0 is the root, which each has.
    """
    turns = stored(turns, "placed-turns")
    total = turns.count()
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    convs = n.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("hundred"))
    lengths = n.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("hundred"), F.least("n", F.lit(HEAD)).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(lengths, "hundred", "left").select("conv_id", "n", "h", "hundred", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("end"))
    convs = stored(convs, "conversations")
    head = turns.filter(f"conv_id % 100 = 0 AND pos < {HEAD}").withColumnRenamed("conv_id", "hundred")
    first = convs.join(head, "hundred").filter("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "n_chars", "end")
    own = join_on_key(turns, convs.select("conv_id", "n", "h", "taken", "end"), "conv_id", total).filter("pos >= h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "a", "b", "n_chars", "end")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("n_chars"), "end")
    return root.unionByName(first).unionByName(own).withColumn("last", F.col("depth") == F.col("end")).drop("end")


def as_given(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, n_chars, last) of the conversations as they are."""
    turns = stored(turns, "placed-turns")
    ends = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    root = ends.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("n_chars"), F.lit(False).alias("last"))
    marked = join_on_key(turns, ends.withColumn("end", F.col("n")), "conv_id", turns.count())
    return root.unionByName(marked.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "n_chars", (F.col("pos") + 1 == F.col("end")).alias("last")))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _ends(batches):
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member), sorted."""
    node, digest = None, None

    def row(node, digest):
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for *of, member in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "member"))):
            if of != node:
                if node is not None:
                    yield row(node, digest)
                node, digest = of, hashlib.sha256(b"%d" % member)
            else:
                digest.update(b",%d" % member)
    if node is not None:
        yield row(node, digest)


def _nodes(keyed: DataFrame) -> DataFrame:
    """A row a node: its numbers, least member ``rep``, members, children, and whether it starts a path."""
    node = keyed.groupBy("depth", "g1", "g2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    node = stored(node, "trie-nodes")
    size = F.struct("n_convs", F.bitwise_not("rep").alias("order"), "g1", "g2")
    below = node.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    below = stored(below.agg(F.count("*").alias("n_children"), F.max(size).alias("heavy")), "trie-children")
    heavy = below.select((F.col("depth") + 1).alias("depth"), "heavy.g1", "heavy.g2", F.lit(0).alias("light"))
    keys = ["depth", "g1", "g2"]
    return node.join(below.drop("heavy"), keys, "left").join(heavy, keys, "left").fillna({"n_children": 0, "light": 1})


def _hung(paths: DataFrame, level: int) -> DataFrame:
    """Leaves and saved code points that the light paths add to the nodes they hang on, from the deepest level up."""
    found, inbox = [], None
    for at in range(level, 0, -1):
        here = paths.filter(F.col("level") == at)
        if inbox is not None:
            here = here.join(inbox, ["top_depth", "top"], "left").fillna({"more_leaves": 0, "more_saved": 0})
            here = here.withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
        here = stored(here.select("parent", "parent_depth", "parent_top", "parent_top_depth", "leaves", "saved"), "trie-round")
        inbox = here.groupBy(F.col("parent_top_depth").alias("top_depth"), F.col("parent_top").alias("top")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        found.append(here.select("parent", "parent_depth", "leaves", "saved"))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(F.col("parent").alias("rep"), F.col("parent_depth").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))


def prefix_trie(rows: DataFrame, block: int | None = None) -> DataFrame:
    """A row a node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has conv_id, depth (0 for the root, then without gaps), a, b, n_chars and last.
    """
    term = {"t1": F.xxhash64("depth", "a", "b"), "t2": F.xxhash64("b", F.lit(3), "depth", "a")}
    keyed = scan(rows.withColumns(term), ["conv_id"], "depth", {"g1": (F.bit_xor, "t1", _xor), "g2": (F.bit_xor, "t2", _xor)}, block)
    keyed = stored(keyed.select("conv_id", "depth", "n_chars", "last", "g1", "g2", _xor(F.col("g1"), F.col("t1")).alias("p1"), _xor(F.col("g2"), F.col("t2")).alias("p2")), "trie-rows")
    total = keyed.count()
    nodes = stored(_nodes(keyed), "trie-flags")
    flags = nodes.select(F.struct("depth", "g1", "g2").alias("node"), F.col("n_convs").alias("n"), "rep", "light")
    met = join_on_key(keyed.select("conv_id", "depth", "last", F.struct("depth", "g1", "g2").alias("node")), flags, "node", total)
    top = F.when(F.col("light") == 1, F.struct("depth", F.col("rep").alias("top")))
    marked = met.select("conv_id", "depth", "last", "rep", "light", top.alias("start"))
    marked = stored(scan(marked, ["conv_id"], "depth", {"path": (F.max, "start", F.greatest), "level": (F.sum, "light", _plus)}, block).drop("start", "light"), "trie-marked")
    own = marked.filter("conv_id = rep").select("rep", "depth", F.col("path.depth").alias("top_depth"), F.col("path.top").alias("top"), F.col("level") - 1)
    own = own.toDF("rep", "depth", "top_depth", "top", "level")
    parents = marked.select(F.col("conv_id").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    table = own.join(nodes.select("rep", "depth", "n_convs", "n_chars", "n_children"), ["rep", "depth"]).join(parents, ["rep", "depth"], "left")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    table = stored(table.withColumns({"leaf": leaf, "own_saved": (F.col("n_convs") - 1) * F.col("n_chars")}), "trie")
    level = table.agg(F.max("level")).first()[0] or 0
    if level:
        sums = table.groupBy("top_depth", "top", "level").agg(F.sum("leaf").alias("leaves"), F.sum("own_saved").alias("saved"))
        tops = table.filter("depth = top_depth AND depth > 0").select("top_depth", "top", F.struct("parent", (F.col("depth") - 1).alias("depth")).alias("node"))
        holders = table.filter("n_children > 0").select(F.struct(F.col("rep").alias("parent"), "depth").alias("node"), F.col("n_children").alias("n"), F.col("top").alias("parent_top"), F.col("top_depth").alias("parent_top_depth"))
        at = join_on_key(tops, holders, "node", tops.count()).select("top_depth", "top", F.col("node.parent").alias("parent"), F.col("node.depth").alias("parent_depth"), "parent_top", "parent_top_depth")
        hung = _hung(stored(sums.filter("level > 0").join(at, ["top_depth", "top"]), "trie-paths"), level)
        table = table.join(hung, ["rep", "depth"], "left").fillna({"hung_leaves": 0, "hung_saved": 0})
        table = table.withColumns({"leaf": F.col("leaf") + F.col("hung_leaves"), "own_saved": F.col("own_saved") + F.col("hung_saved")})
    summed = scan(table, ["top_depth", "top"], "depth", {"n_leaves": (F.sum, "leaf", _plus), "saved_tokens": (F.sum, "own_saved", _plus)}, block, backwards=True)
    ending = marked.filter("last").select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ending = ending.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member").mapInArrow(_ends, "conv_id long, depth long, ends_sha256 string")
    out = summed.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.join(ending, ["conv_id", "depth"], "left").fillna({"ends_sha256": EMPTY})


def op13_prefix_trie(spark, sf_dir) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(placed_turns(read_table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8),
crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM own
  UNION ALL
  SELECT conv_id, s, k + 1, xor(c >> 8, l[(xor(c, ascii(s[k + 1])) & 255) + 1]) FROM crc, crc_table WHERE k < length(s)),
conv AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crc WHERE k = length(s)),
taken AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos < c.h),
turns AS (
  SELECT conv_id, 0 AS part, pos, role, text FROM taken
  UNION ALL
  SELECT o.conv_id, 1, o.pos, o.role, o.text FROM own o JOIN conv c USING (conv_id) WHERE o.pos >= c.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(r := role, t := text)) OVER w AS path, length(text) AS n_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM conv),
ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
marked AS (SELECT p.*, p.depth = e.depth AS last FROM paths p JOIN ends e USING (conv_id)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_chars) AS n_chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM marked GROUP BY path, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (conv_id, depth)),
below AS (
  SELECT path[1:k] AS path, k AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.depth = n.depth AND b.path = n.path
"""
