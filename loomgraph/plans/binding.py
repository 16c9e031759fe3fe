"""A property graph over the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(*parts: str | F.Column) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def nation_id() -> F.Column:
    return _id("R", F.col("n_regionkey"), ".N", F.col("n_nationkey"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are modules, nations classes, customers methods, suppliers functions, parts blocks.

    For tests: lines are numbered within a nation, so that at any scale as many tasks number them as there are nations.
    """
    t = lambda n: table(spark, sf_dir, n)
    region, nation = t("region"), t("nation")
    place = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_regionkey", "n_name", _id(F.col("r_name"), "/", F.col("n_name")).alias("file_path")))
    line = lambda part, key, base: (F.row_number().over(Window.partitionBy(part).orderBy(key)) * 10 + base).cast("int")
    parts = [
        region.select(_id("R", F.col("r_regionkey")).alias("id"), F.lit("module").alias("type"), F.col("r_name").alias("name"), F.col("r_name").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")),
        place.select(nation_id().alias("id"), F.lit("class").alias("type"), F.col("n_name").alias("name"), "file_path", F.lit(1).alias("start_line"), F.lit(100_000_000).alias("end_line")),
    ]
    for kind, name, key, nat, label, letter, base in (("method", "customer", "c_custkey", "c_nationkey", "c_name", "C", 0), ("function", "supplier", "s_suppkey", "s_nationkey", "s_name", "S", 50_000_000)):
        df = t(name).withColumn("start_line", line(nat, key, base)).join(place, F.col(nat) == F.col("n_nationkey"))
        parts.append(df.select(_id(nation_id(), f".{letter}", F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("name"), "file_path", "start_line", (F.col("start_line") + 9).alias("end_line")))
    part = t("part")
    parts.append(part.select(_id("P.", F.col("p_brand"), ".P", F.col("p_partkey")).alias("id"), F.lit("block").alias("type"), F.col("p_name").alias("name"), _id("parts/", F.col("p_brand")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains: down the hierarchy; calls: customer to supplier by orders; imports: a nation's two strongest partners; uses: supplier to part."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    place = F.broadcast(nation.select("n_nationkey", nation_id().alias("nation"), _id("R", F.col("n_regionkey")).alias("region")))
    customer = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("nation").alias("c_nation"), _id(F.col("nation"), ".C", F.col("c_custkey")).alias("c_id"))
    supplier = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("nation").alias("s_nation"), F.col("n_nationkey").alias("s_nk"), _id(F.col("nation"), ".S", F.col("s_suppkey")).alias("s_id"))
    part = t("part").select("p_partkey", _id("P.", F.col("p_brand"), ".P", F.col("p_partkey")).alias("p_id"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    sales = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")
    source = F.when(F.col("l_linestatus") == "O", "static").otherwise("runtime").alias("source")

    def fixed(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        return df.select(F.col(a).alias("from_node"), F.col(b).alias("to_node"), F.lit(kind).alias("type"), F.lit("resolved").alias("confidence"), F.lit("static").alias("source"), F.lit(0).cast("long").alias("seq"))

    calls = sales.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    flag = F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "inferred").otherwise("external")
    calls = calls.select(F.col("c_id").alias("from_node"), F.col("s_id").alias("to_node"), F.lit("calls").alias("type"), flag.alias("confidence"), source, seq)
    uses = lines.filter("l_returnflag = 'R'").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    status = F.when(F.col("l_linestatus") == "F", "unresolved").otherwise("resolved")
    uses = uses.select(F.col("s_id").alias("from_node"), F.col("p_id").alias("to_node"), F.lit("uses").alias("type"), status.alias("confidence"), source, seq)
    money = sales.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nation != s_nation")
    money = money.groupBy("c_nation", "s_nation", "s_nk").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    top = money.withColumn("r", F.row_number().over(Window.partitionBy("c_nation").orderBy(F.desc("revenue"), "s_nk"))).filter("r <= 2")
    out = fixed(place, "region", "nation", "contains").unionByName(fixed(customer, "c_nation", "c_id", "contains")).unionByName(fixed(supplier, "s_nation", "s_id", "contains"))
    return out.unionByName(calls).unionByName(fixed(top, "c_nation", "s_nation", "imports")).unionByName(uses)


#: The same relations for the oracle.
SQL = """
g_place AS (SELECT n_nationkey, n_regionkey, n_name, 'R' || n_regionkey || '.N' || n_nationkey AS nation, 'R' || n_regionkey AS region, r_name || '/' || n_name AS file_path
            FROM nation JOIN region ON n_regionkey = r_regionkey),
g_nodes AS (
  SELECT 'R' || r_regionkey AS id, 'module' AS type, r_name AS name, r_name AS file_path, 1::INTEGER AS start_line, 1::INTEGER AS end_line FROM region
  UNION ALL SELECT nation, 'class', n_name, file_path, 1::INTEGER, 100000000::INTEGER FROM g_place
  UNION ALL SELECT nation || '.C' || c_custkey, 'method', c_name, file_path, s::INTEGER, (s + 9)::INTEGER
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 10 AS s FROM customer) JOIN g_place ON c_nationkey = n_nationkey
  UNION ALL SELECT nation || '.S' || s_suppkey, 'function', s_name, file_path, s::INTEGER, (s + 9)::INTEGER
    FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) * 10 + 50000000 AS s FROM supplier) JOIN g_place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'P.' || p_brand || '.P' || p_partkey, 'block', p_name, 'parts/' || p_brand, 1::INTEGER, 1::INTEGER FROM part),
g_cust AS (SELECT c_custkey, nation AS c_nation, nation || '.C' || c_custkey AS c_id FROM customer JOIN g_place ON c_nationkey = n_nationkey),
g_supp AS (SELECT s_suppkey, n_nationkey AS s_nk, nation AS s_nation, nation || '.S' || s_suppkey AS s_id FROM supplier JOIN g_place ON s_nationkey = n_nationkey),
g_money AS (SELECT c_nation, s_nation, s_nk, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN g_cust ON o_custkey = c_custkey JOIN g_supp ON l_suppkey = s_suppkey
            WHERE c_nation <> s_nation GROUP BY ALL),
g_edges AS (
  SELECT region AS from_node, nation AS to_node, 'contains' AS type, 'resolved' AS confidence, 'static' AS source, 0::BIGINT AS seq FROM g_place
  UNION ALL SELECT c_nation, c_id, 'contains', 'resolved', 'static', 0 FROM g_cust
  UNION ALL SELECT s_nation, s_id, 'contains', 'resolved', 'static', 0 FROM g_supp
  UNION ALL SELECT c_id, s_id, 'calls', CASE l_returnflag WHEN 'R' THEN 'resolved' WHEN 'A' THEN 'inferred' ELSE 'external' END,
                   CASE l_linestatus WHEN 'O' THEN 'static' ELSE 'runtime' END, l_orderkey * 8 + l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN g_cust ON o_custkey = c_custkey JOIN g_supp ON l_suppkey = s_suppkey
  UNION ALL SELECT c_nation, s_nation, 'imports', 'resolved', 'static', 0
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nation ORDER BY revenue DESC, s_nk) AS r FROM g_money) WHERE r <= 2
  UNION ALL SELECT s_id, 'P.' || p_brand || '.P' || p_partkey, 'uses', CASE l_linestatus WHEN 'F' THEN 'unresolved' ELSE 'resolved' END,
                   CASE l_linestatus WHEN 'O' THEN 'static' ELSE 'runtime' END, l_orderkey * 8 + l_linenumber
    FROM lineitem JOIN g_supp ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
g_flat AS (SELECT from_node, to_node, type, confidence, source, seq FROM
  (SELECT *, row_number() OVER (PARTITION BY from_node, to_node ORDER BY seq DESC, type DESC, confidence DESC, source DESC) AS r FROM g_edges) WHERE r = 1)
"""
