"""Queries of the general problems: hierarchies (p3) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import cycles, descendants, full_paths
from ..operators.orphans import orphan_references, orphan_report
from ..tables import blank_to_null, table, utc_month
from .registry import Registry

REGISTRY = Registry()

_TREE_SQL = """
WITH RECURSIVE n AS (
  SELECT id, min(nullif(parent, '')) AS parent, coalesce(min(qualified_name), '') AS label
  FROM symbols WHERE id <> '' GROUP BY id),
v AS (SELECT n.id, n.label, p.id AS parent FROM n LEFT JOIN n p ON n.parent = p.id),
t(id, root, depth, path) AS (
  SELECT id, id, 0, label FROM v WHERE parent IS NULL
  UNION ALL
  SELECT v.id, t.root, t.depth + 1, t.path || ' > ' || v.label FROM v JOIN t ON v.parent = t.id),
"""

_CYCLE_SQL = """
off AS (SELECT v.* FROM v ANTI JOIN t ON v.id = t.id),
w(start, id, hops) AS (
  SELECT id, parent, 1 FROM off
  UNION ALL
  SELECT w.start, o.parent, w.hops + 1 FROM w JOIN off o ON w.id = o.id WHERE w.id <> w.start AND w.hops < 500),
c AS (SELECT DISTINCT start AS id FROM w WHERE id = start),
u(start, id, hops) AS (
  SELECT c.id, c.id, 0 FROM c
  UNION ALL
  SELECT u.start, o.parent, u.hops + 1 FROM u JOIN off o ON u.id = o.id WHERE u.hops < 500 AND (u.hops = 0 OR u.id <> u.start))
"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("id", "parent", "qualified_name")


@REGISTRY.query("p3_found", _TREE_SQL + _CYCLE_SQL + "SELECT start AS symbol_id, min(id) AS cycle_id FROM u GROUP BY start")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols on a cycle of parents, with the smallest id on it."""
    return cycles(_symbols(spark, sf_dir), "id", "parent").select(F.col("id").alias("symbol_id"), "cycle_id")


@REGISTRY.query(
    "p3_paths",
    _TREE_SQL
    + _CYCLE_SQL
    + """
SELECT v.id AS symbol_id, CASE WHEN t.id IS NOT NULL THEN 'tree' WHEN c.id IS NOT NULL THEN 'cycle' ELSE 'below' END AS state,
  CAST(t.depth AS INTEGER) AS depth, t.root, t.path
FROM v LEFT JOIN t ON v.id = t.id LEFT JOIN c ON v.id = c.id""",
)
def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of qualified names from the root, depth and root of every symbol; its place where it has none."""
    rows = full_paths(_symbols(spark, sf_dir), "id", "parent", "qualified_name")
    return rows.select(F.col("id").alias("symbol_id"), "state", "depth", "root", F.array_join("path", " > ").alias("path"))


@REGISTRY.query(
    "p3_descendants",
    _TREE_SQL
    + """
d(ancestor, descendant, distance) AS (
  SELECT v.parent, v.id, 1 FROM v JOIN t ON v.id = t.id WHERE v.parent IS NOT NULL
  UNION ALL
  SELECT v.parent, d.descendant, d.distance + 1 FROM d JOIN v ON d.ancestor = v.id WHERE v.parent IS NOT NULL)
SELECT ancestor, descendant, CAST(distance AS INTEGER) AS distance FROM d""",
)
def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every symbol, as pairs with their distance."""
    return descendants(full_paths(_symbols(spark, sf_dir), "id", "parent", "qualified_name"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "symbols").select("id")
    files = table(spark, sf_dir, "files").select("path")
    month = lambda c: F.coalesce(utc_month(c), F.lit("unknown")).alias("period")
    vectors = table(spark, sf_dir, "symbol_embeddings").select(F.lit("symbol_embeddings").alias("table_name"), blank_to_null(F.col("symbol_id")).alias("ref_key"), month(F.col("embedded_at")))
    calls = table(spark, sf_dir, "runtime_calls").select(F.lit("runtime_calls").alias("table_name"), blank_to_null(F.col("symbol_id")).alias("ref_key"), month(F.col("last_seen").try_cast("timestamp")))
    deltas = (
        table(spark, sf_dir, "branch_deltas")
        .where(F.lower("action").isin("modify", "delete"))
        .select(F.lit("branch_deltas").alias("table_name"), blank_to_null(F.col("file")).alias("ref_key"), month(F.timestamp_micros((F.col("file_mtime_ns") / 1000).cast("bigint"))))
    )
    return orphan_references(vectors.unionByName(calls), ["ref_key"], symbols, ["id"]).unionByName(orphan_references(deltas, ["ref_key"], files, ["path"]))


_ORPHAN_SQL = """
WITH r AS (
  SELECT 'symbol_embeddings' AS table_name, symbol_id AS ref_key, strftime(embedded_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM symbol_embeddings
  WHERE symbol_id <> '' AND symbol_id NOT IN (SELECT id FROM symbols WHERE id IS NOT NULL)
  UNION ALL
  SELECT 'runtime_calls', symbol_id, left(last_seen, 7) FROM runtime_calls
  WHERE symbol_id <> '' AND symbol_id NOT IN (SELECT id FROM symbols WHERE id IS NOT NULL)
  UNION ALL
  SELECT 'branch_deltas', file, strftime(make_timestamp_ns(file_mtime_ns), '%Y-%m') FROM branch_deltas
  WHERE lower(action) IN ('modify', 'delete') AND file <> '' AND file NOT IN (SELECT path FROM files WHERE path IS NOT NULL)),
o AS (SELECT DISTINCT table_name, ref_key, coalesce(period, 'unknown') AS period FROM r)
"""


@REGISTRY.query("p6_found", _ORPHAN_SQL + "SELECT * FROM o")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to symbols and files that do not exist, by table and month."""
    return _orphans(spark, sf_dir)


@REGISTRY.query("p6_report", _ORPHAN_SQL + "SELECT table_name, period, count(*) AS orphans FROM o GROUP BY ALL")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of orphan keys per table and month."""
    return orphan_report(_orphans(spark, sf_dir), ["table_name", "period"])
