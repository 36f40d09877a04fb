"""The contract with the driver, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry


def views(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def test_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "p3_found", "p6_found", "graph_khop", "point_resolution", "tool_latency", "branch_overlay", "delete_safety", "similar_symbols", "session_budget", "call_graph", "class_hierarchy", "code_pagerank", "symbol_search", "fused_edges", "dead_code", "repo_map", "call_hierarchy", "task_context", "pooled_vectors", "contract_stability"])
def test_against_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    found = views(sf).sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(found.columns)
    order = [found.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
