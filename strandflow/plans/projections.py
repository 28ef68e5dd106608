"""Sequences, alignments, trees and paths projected from the driver's tables, whole; each with its SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FROM, _TO = " eaoiunrtslc.-", "NACGTACGTACGTA"
_GAP_FROM, _GAP_TO = " eaoiunrtslc", "-ACGTACGTACG"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.translate(F.coalesce("text", F.lit("")), _FROM, _TO)
    return docs.select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("name"), text.alias("seq"))


SEQS = f"seqs AS (SELECT doc_id AS seq_id, 'S' || doc_id AS name, translate(coalesce(text, ''), '{_FROM}', '{_TO}') AS seq FROM documents)"


def short_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("seq_id"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("name"), F.translate("text", _FROM, _TO).alias("seq"))


SHORT = f"short AS (SELECT item_id AS seq_id, 'B' || item_id AS name, translate(text, '{_FROM}', '{_TO}') AS seq FROM benchmark)"


def new_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("seq_id"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("name"), F.translate("url", _FROM, _TO).alias("seq"))


NEW = f"fresh AS (SELECT page_id AS seq_id, 'P' || page_id AS name, translate(url, '{_FROM}', '{_TO}') AS seq FROM pages)"


def msa(spark: SparkSession, sf_dir: str, column: str = "p_name", node: str = "p_brand") -> DataFrame:
    part = _table(spark, sf_dir, "part")
    width = part.agg(F.max(F.length(column)).alias("width"))
    text = F.translate(column, _GAP_FROM, _GAP_TO)
    rows = part.join(F.broadcast(width)).withColumn("_text", text)  # one row
    node_column = F.col(node) if node in part.columns else F.lit(node)
    return rows.select(node_column.alias("node"), F.col("p_partkey").alias("row_id"), F.expr("rpad(_text, width, '-')").alias("aligned"), (1 + F.col("p_size") % 7).cast("double").alias("weight"))


def msa_sql(name: str = "msa", column: str = "p_name", node: str = "p_brand") -> str:
    return f"""{name} AS (
  SELECT {node} AS node, p_partkey AS row_id, rpad(translate({column}, '{_GAP_FROM}', '{_GAP_TO}'), (SELECT max(length({column})) FROM part)::INTEGER, '-') AS aligned,
    (1 + p_size % 7)::DOUBLE AS weight FROM part)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, and customers and suppliers as leaves; some lengths are 0."""

    def rows(table: str, key: str, name: str, parent, length, leaf: bool) -> DataFrame:
        return _table(spark, sf_dir, table).select(
            F.concat(F.lit(name), F.col(key).cast("string")).alias("node_id"), parent.alias("parent_id"), F.col(key).cast("long").alias("child_ord"), length.cast("double").alias("branch_length"), F.lit(leaf).alias("is_leaf")
        )

    def nation(column: str):
        return F.concat(F.lit("node_n"), F.col(column).cast("string"))

    root = spark.range(1).select(F.lit("node_root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("child_ord"), F.lit(0.0).alias("branch_length"), F.lit(False).alias("is_leaf"))
    out = root.unionByName(rows("region", "r_regionkey", "node_r", F.lit("node_root"), 1 + F.col("r_regionkey") % 7, False))
    out = out.unionByName(rows("nation", "n_nationkey", "node_n", F.concat(F.lit("node_r"), F.col("n_regionkey").cast("string")), 1 + F.col("n_nationkey") % 7, False))
    out = out.unionByName(rows("customer", "c_custkey", "C", nation("c_nationkey"), F.col("c_custkey") % 7, True))
    return out.unionByName(rows("supplier", "s_suppkey", "S", nation("s_nationkey"), F.col("s_suppkey") % 7, True))


NODES = """nodes AS (
  SELECT 'node_root' AS node_id, NULL::VARCHAR AS parent_id, 0::BIGINT AS child_ord, 0.0::DOUBLE AS branch_length, false AS is_leaf
  UNION ALL SELECT 'node_r' || r_regionkey, 'node_root', r_regionkey, (1 + r_regionkey % 7)::DOUBLE, false FROM region
  UNION ALL SELECT 'node_n' || n_nationkey, 'node_r' || n_regionkey, n_nationkey, (1 + n_nationkey % 7)::DOUBLE, false FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'node_n' || c_nationkey, c_custkey, (c_custkey % 7)::DOUBLE, true FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'node_n' || s_nationkey, s_suppkey, (s_suppkey % 7)::DOUBLE, true FROM supplier),
up AS (
  SELECT node_id, node_id AS anc_id, 0 AS dist FROM nodes
  UNION ALL SELECT u.node_id, n.parent_id, u.dist + 1 FROM up u JOIN nodes n ON n.node_id = u.anc_id WHERE n.parent_id IS NOT NULL),
leafs AS (SELECT a.anc_id AS node_id, count(*) AS num_leaves FROM up a JOIN nodes n ON n.node_id = a.node_id AND n.is_leaf GROUP BY a.anc_id),
fixed AS (
  SELECT node_id, parent_id, child_ord, is_leaf, CASE WHEN parent_id IS NULL THEN 0.0 WHEN branch_length > 0 THEN branch_length
    ELSE coalesce((SELECT min(branch_length) FROM nodes WHERE parent_id IS NOT NULL AND branch_length > 0), 1.0) END AS branch_length FROM nodes)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each order: a step for each of its lines."""
    lines = _table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.select(F.col("l_orderkey").alias("pair_id"), (F.row_number().over(order) - 1).cast("long").alias("k"), (F.col("l_partkey") % 3).cast("int").alias("step"))


STEPS = """steps AS (
  SELECT l_orderkey AS pair_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k, (l_partkey % 3)::INTEGER AS step FROM lineitem)"""
