"""The evidence graph as DataFrames: vertex, edge and fact tables projected from the star-schema tables.

Every function takes (spark, sf_dir) and returns one table with an explicit column list,
so that scans read only what an operator needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators.maintain import backfill_treats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores where a table has fewer parts than there are cores, as a file of one row group has; larger tables stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


PARTS = 16  # parts in which a table is dealt for each that Spark reads it in


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many parts to deal rows made from a table: in proportion to it, so that a part and the memory of its task stay small.

    What Spark reads at once is bounded (128 MB unless set otherwise), while the parts of a
    shuffle are as many for a small table as for a large one, or merged into few.
    """
    return PARTS * table(spark, sf_dir, name).rdd.getNumPartitions()


def choose(column: str, pairs: dict[str, str | float | int], default=None) -> Column:
    """CASE column WHEN key THEN value ... ELSE default."""
    out = None
    for key, value in pairs.items():
        out = F.when(F.col(column) == key, F.lit(value)) if out is None else out.when(F.col(column) == key, F.lit(value))
    return out.otherwise(F.lit(default))


LEVEL_BY_PRIORITY = {"1-URGENT": "1a", "2-HIGH": "1b", "3-MEDIUM": "2b", "4-NOT SPECIFIED": "3", "5-LOW": "5"}
DIRECTION_BY_FLAG = {"A": "improved", "R": "worsened"}


def paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers: orders with their customer's segment as the sub-domain."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("paper_id"),
        F.year("o_orderdate").alias("year"),
        choose("o_orderpriority", LEVEL_BY_PRIORITY, "5").alias("evidence_level"),
        F.col("c_mktsegment").alias("sub_domain"),
        F.col("o_custkey").alias("owner"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("sample_size"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_nationkey").alias("pathology_key"),
    )


def affects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts: intervention changes outcome, as a paper's line reports. Key: paper and line."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("intervention"),
        F.col("p_type").alias("outcome"),
        F.col("l_orderkey").alias("source_paper_id"),
        F.col("l_linenumber").alias("line"),
        F.coalesce(choose("l_returnflag", DIRECTION_BY_FLAG), F.lit("unchanged")).alias("direction"),
        F.col("l_tax").alias("p_value"),
        (F.col("l_tax") < 0.05).alias("is_significant"),
        F.col("l_quantity").alias("effect"),
        F.col("l_discount").alias("rate"),
        F.col("l_extendedprice").alias("final"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their own paper's level, year and size."""
    a, p = affects(spark, sf_dir), paper(spark, sf_dir)
    return a.join(p, a.source_paper_id == p.paper_id)


def intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("intervention"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("category"), F.col("s_acctbal").alias("balance"))


def pathology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pathology_key"), F.col("n_name").alias("pathology"), F.col("n_regionkey").alias("region_key"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper to pathology: the nation of the order's customer."""
    return paper(spark, sf_dir).join(pathology(spark, sf_dir), "pathology_key").select("paper_id", "pathology")


def investigates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper to intervention, once each."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("intervention")).distinct()


def treats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervention to pathology with the number of papers that hold both and aren't reviews."""
    return backfill_treats(investigates(spark, sf_dir), studies(spark, sf_dir)).drop("first_paper")


def is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child to parent: supplier to nation to region to the root."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    rows = s.select(name("S", "s_suppkey").alias("child"), name("N", "s_nationkey").alias("parent"))
    rows = rows.unionByName(n.select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent")))
    return rows.unionByName(r.select(name("R", "r_regionkey").alias("child"), F.lit("ROOT").alias("parent")))


#: The same tables for the oracle, as common table expressions.
CTE = {
    "paper": """paper AS (SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderpriority WHEN '1-URGENT' THEN '1a' WHEN '2-HIGH' THEN '1b' WHEN '3-MEDIUM' THEN '2b' WHEN '4-NOT SPECIFIED' THEN '3' ELSE '5' END AS evidence_level,
  c_mktsegment AS sub_domain, o_custkey AS owner, CAST(floor(o_totalprice / 1000) AS INTEGER) AS sample_size, o_orderstatus AS status, c_nationkey AS pathology_key
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "affects": """affects AS (SELECT l_suppkey AS intervention, p_type AS outcome, l_orderkey AS source_paper_id, l_linenumber AS line,
  CASE l_returnflag WHEN 'A' THEN 'improved' WHEN 'R' THEN 'worsened' ELSE 'unchanged' END AS direction,
  l_tax AS p_value, l_tax < CAST(0.05 AS DOUBLE) AS is_significant, l_quantity AS effect, l_discount AS rate, l_extendedprice AS final
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "evidence": "evidence AS (SELECT * FROM affects JOIN paper ON source_paper_id = paper_id)",
    "intervention": "intervention AS (SELECT s_suppkey AS intervention, s_name AS name, s_nationkey AS category, s_acctbal AS balance FROM supplier)",
    "pathology": "pathology AS (SELECT n_nationkey AS pathology_key, n_name AS pathology, n_regionkey AS region_key FROM nation)",
    "studies": "studies AS (SELECT paper_id, pathology FROM paper JOIN pathology USING (pathology_key))",
    "investigates": "investigates AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS intervention FROM lineitem)",
    "treats": """treats AS (SELECT intervention, pathology, count(*) AS paper_count FROM investigates JOIN studies USING (paper_id) WHERE paper_id NOT IN
  (SELECT paper_id FROM investigates GROUP BY 1 HAVING count(*) >= 4 INTERSECT SELECT paper_id FROM studies GROUP BY 1 HAVING count(*) >= 4) GROUP BY 1, 2)""",
    "is_a": """is_a AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region)""",
    "up": """up AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM is_a
  UNION ALL SELECT u.node, e.parent, u.distance + 1 FROM up u JOIN is_a e ON u.ancestor = e.child WHERE u.distance < 5)""",
}
NEEDS = {
    "evidence": ("affects", "paper"),
    "studies": ("paper", "pathology"),
    "treats": ("investigates", "studies"),
    "up": ("is_a",),
}


def with_tables(*names: str, then: str) -> str:
    """Oracle text: the named tables, and those they need, before a query."""
    order: list[str] = []

    def add(name):
        for below in NEEDS.get(name, ()):
            add(below)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    recursive = "RECURSIVE " if "up" in order else ""
    return f"WITH {recursive}" + ",\n".join(CTE[n] for n in order) + "\n" + then
