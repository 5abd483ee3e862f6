"""The relations, as projections of the star schema and the text tables: the same operators, with an SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def components(spark: SparkSession, sf_dir: str, *, externals: bool = False) -> DataFrame:
    """Regions, nations below them, customers and suppliers below these; parts are externals. id, name, kind, path, parent."""
    t = lambda n: table(spark, sf_dir, n)
    null = F.lit(None).cast("string")
    r, n = t("region"), t("nation")
    rows = r.select(named("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("package").alias("kind"), named("r", "r_regionkey").alias("path"), null.alias("parent"))
    n_path = F.concat(named("r", "n_regionkey"), F.lit("/"), named("n", "n_nationkey"))
    rows = rows.unionByName(n.select(named("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("module").alias("kind"), n_path.alias("path"), named("R", "n_regionkey").alias("parent")))
    dim = F.broadcast(n)  # 25 nations
    for name, key, nation, label, p in (("customer", "c_custkey", "c_nationkey", "c_name", "C"), ("supplier", "s_suppkey", "s_nationkey", "s_name", "S")):
        leaf = t(name).join(dim, F.col(nation) == F.col("n_nationkey"))
        rows = rows.unionByName(leaf.select(named(p, key).alias("id"), F.col(label).alias("name"), F.lit("module").alias("kind"), F.concat(n_path, F.lit("/"), named(p.lower(), key)).alias("path"), named("N", nation).alias("parent")))
    if externals:
        rows = rows.unionByName(t("part").select(named("P", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("external").alias("kind"), null.alias("path"), null.alias("parent")))
    return rows


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per line item: a customer's component takes from a supplier's. (file, line) is not unique, as with statements."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        named("C", "o_custkey").alias("src"),
        named("S", "l_suppkey").alias("dst"),
        F.lit("imports").alias("kind"),
        named("o", "l_orderkey").alias("file"),
        F.col("l_linenumber").alias("line"),
        named("p", "l_partkey").alias("target"),
        (F.col("l_returnflag") == "R").alias("test"),
        ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")).alias("type_only"),
        F.lit(False).alias("server_reference"),
        F.when(F.col("l_discount") > 0.05, "local").otherwise("module").alias("scope"),
    )


EVIDENCE_SQL = """ev AS (
  SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, 'imports' AS kind, 'o' || l_orderkey AS file, l_linenumber AS line, 'p' || l_partkey AS target,
    l_returnflag = 'R' AS test, l_linestatus = 'O' AND l_returnflag = 'A' AS type_only, CASE WHEN l_discount > 0.05 THEN 'local' ELSE 'module' END AS scope
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

COMPONENTS_SQL = """comp AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'package' AS kind, 'r' || r_regionkey AS path, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'module', 'r' || n_regionkey || '/n' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'module', 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, 'N' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'module', 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey, 'N' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""

#: Nation and region of a leaf, to fold by.
FOLD_SQL = """leaf AS (
  SELECT 'C' || c_custkey AS id, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that take from nations through a few urgent, large orders: src, dst, file, line, target, scope, test, type_only."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 and l_returnflag = 'N' and l_linestatus = 'O'")
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    return e.select(named("N", "c_nationkey").alias("src"), named("N", "s_nationkey").alias("dst"), named("o", "l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), named("o", "l_partkey").alias("target"), F.when(F.col("l_discount") > 0.05, "local").otherwise("module").alias("scope"), F.lit(False).alias("test"), F.lit(False).alias("type_only"))


def sparse_sql() -> str:
    return f"""sp AS (
  SELECT 'N' || c_nationkey AS src, 'N' || s_nationkey AS dst, 'o' || l_orderkey AS file, l_linenumber AS line, 'o' || l_partkey AS target, CASE WHEN l_discount > 0.05 THEN 'local' ELSE 'module' END AS scope
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 49 AND l_returnflag = 'N' AND l_linestatus = 'O' AND o_orderpriority = '1-URGENT' AND c_nationkey <> s_nationkey
)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit, its time the order's date; those without a specified priority are merges."""
    o = table(spark, sf_dir, "orders")
    merge = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return o.select(named("o", "o_orderkey").alias("id"), F.when(merge, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("parents"), F.unix_timestamp("o_orderdate").alias("time"), (F.col("o_orderkey") % 97 == 0).alias("boundary"), F.lit(0).cast("long").alias("omitted"), F.col("o_orderkey").alias("pos"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parts of an order are the files that it changes."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return li.select(named("o", "l_orderkey").alias("commit"), named("p", "l_partkey").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("renamed_from"), F.lit(None).cast("int").alias("similarity"))


HISTORY_SQL = """ch AS (SELECT DISTINCT 'o' || l_orderkey AS commit, 'p' || l_partkey AS path FROM lineitem),
size AS (SELECT commit, count(*) AS n FROM ch GROUP BY 1),
cl AS (
  SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'merge' WHEN o_orderkey % 97 = 0 THEN 'boundary' WHEN coalesce(n, 0) > 6 THEN 'large' ELSE 'counted' END AS class
  FROM orders LEFT JOIN size ON size.commit = 'o' || o_orderkey
)"""
