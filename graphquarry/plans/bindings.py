"""The test tables as a trade graph and as text collections.

Regions are namespaces, nations types, suppliers methods, customers functions,
parts fields. A line item is a use: its order's customer calls its supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import dealt, if_small, parts_for

NATION, SUPPLIER, CUSTOMER, PART = 1000, 1_000_000_000, 2_000_000_000, 3_000_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _long(x) -> "F.Column":
    return F.col(x).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    place = nation.join(if_small(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "n_regionkey", F.concat("r_name", F.lit("."), "n_name").alias("place"))
    row = lambda df, id, kind, name, qualified, parent: df.select(id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), parent.alias("parent_id"))
    supplier = read(spark, sf_dir, "supplier").join(if_small(place), F.col("s_nationkey") == F.col("n_nationkey"))
    customer = read(spark, sf_dir, "customer").join(if_small(place), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("long")
    return (
        row(region, _long("r_regionkey"), "namespace", F.col("r_name"), F.col("r_name"), none)
        .union(row(place, _long("n_nationkey") + NATION, "class", F.col("n_name"), F.col("place"), _long("n_regionkey")))
        .union(row(supplier, _long("s_suppkey") + SUPPLIER, "method", F.col("s_name"), F.concat("place", F.lit("."), "s_name"), _long("s_nationkey") + NATION))
        .union(row(customer, _long("c_custkey") + CUSTOMER, "function", F.col("c_name"), F.concat("place", F.lit("."), "c_name"), _long("c_nationkey") + NATION))
        .union(row(read(spark, sf_dir, "part"), _long("p_partkey") + PART, "field", F.col("p_name"), F.concat("p_brand", F.lit("."), "p_name"), none))
    )


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, line)``."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if parts := parts_for(items):  # sorts of a task stay as small, however many rows there are
        items, orders = dealt(items, "l_orderkey", parts=parts), dealt(orders, "o_orderkey", parts=parts)
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((_long("o_custkey") + CUSTOMER).alias("src"), (_long("l_suppkey") + SUPPLIER).alias("dst"), F.col("l_linenumber").alias("line"))


NODES_SQL = f"""
place AS (SELECT n_nationkey, n_name, n_regionkey, r_name || '.' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'namespace' AS kind, r_name AS name, r_name AS qualified_name, CAST(NULL AS BIGINT) AS parent_id FROM region
  UNION ALL SELECT n_nationkey + {NATION}, 'class', n_name, place, n_regionkey FROM place
  UNION ALL SELECT s_suppkey + {SUPPLIER}, 'method', s_name, place || '.' || s_name, s_nationkey + {NATION} FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT c_custkey + {CUSTOMER}, 'function', c_name, place || '.' || c_name, c_nationkey + {NATION} FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT p_partkey + {PART}, 'field', p_name, p_brand || '.' || p_name, NULL FROM part)"""
USES_SQL = f"""
uses AS (SELECT o_custkey + {CUSTOMER} AS src, l_suppkey + {SUPPLIER} AS dst, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def nation_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses between nations."""
    from ..operators.graph import weighted

    parent = nodes(spark, sf_dir).filter("kind in ('method', 'function')").select("id", "parent_id")
    pairs = weighted(uses(spark, sf_dir))
    named = pairs.join(parent.toDF("src", "a"), "src").join(parent.toDF("dst", "b"), "dst")
    return named.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("n").alias("n"))


NATION_USES_SQL = f"""
pairs AS (SELECT src, dst, count(*) AS n FROM uses GROUP BY ALL),
nation_uses AS (SELECT a.parent_id AS src, b.parent_id AS dst, CAST(sum(n) AS BIGINT) AS n FROM pairs JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)``: customers with their suppliers, and suppliers with their parts."""
    sold = read(spark, sf_dir, "lineitem").select((_long("l_suppkey") + SUPPLIER).alias("src"), (_long("l_partkey") + PART).alias("dst"))
    return uses(spark, sf_dir).select("src", "dst").union(sold).distinct()


TRADE_SQL = f"""
trade AS (SELECT src, dst FROM uses UNION SELECT l_suppkey + {SUPPLIER}, l_partkey + {PART} FROM lineitem)"""

#: Ranks over ``nodes`` and ``uses``. Only customers use and only suppliers are used, so each round is two numbers: the rank of what nothing uses, and the mass of what uses nothing.
RANKS_SQL = f"""
pairs AS (SELECT src, dst, sqrt(count(*)) AS w FROM uses GROUP BY ALL), outs AS (SELECT src, sum(w) AS o FROM pairs GROUP BY src),
gets AS (SELECT dst, sum(w / o) AS g FROM pairs JOIN outs USING (src) GROUP BY dst), size AS (SELECT count(*) AS n, (SELECT count(*) FROM outs) AS users FROM nodes),
rounds(k, c, d, before) AS (SELECT 0, 1.0::DOUBLE / n, (n - users)::DOUBLE / n, 0.0::DOUBLE FROM size
  UNION ALL SELECT k + 1, 0.15 / n + 0.85 * d / n, (n - users) * (0.15 / n + 0.85 * d / n) + 0.85 * c * users, c FROM rounds, size WHERE k < 150),
ranks AS (SELECT id, c + 0.85 * before * coalesce(g, 0) AS rank FROM nodes LEFT JOIN gets ON dst = id, rounds WHERE k = 150)"""
