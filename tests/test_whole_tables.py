"""Whole-table operators take every row of their tables."""

from lodestrata.plans import reports


def test_snapshot_diff_and_upsert_take_all_rows(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("files", [("larch/a.py", "1"), ("larch/b.py", "1"), ("x/c.py", "1")], "path string, hash string")
    put("branch_deltas", [("larch/a.py", "1"), ("x/c.py", "2")], "file string, file_hash string")
    put("runtime_calls", [("s", "otel", 2, 5.0, "2025"), ("s", "sql_log", 3, 1.0, "2024"), ("t", "stack_log", 1, None, "2023")], "symbol_id string, source string, count long, p95_ms double, first_seen string")
    put("fused_results", [("q", "s", 7.0)], "query_id string, symbol_id string, score double")
    assert sorted(tuple(r) for r in reports.snapshot_diff(spark, str(tmp_path)).collect()) == [("larch/a.py", "unchanged"), ("larch/b.py", "removed"), ("x/c.py", "changed")]
    got = sorted(tuple(r) for r in reports.runtime_upsert(spark, str(tmp_path)).collect())
    assert got == [("s", "otel", 3, 7.0, "2025"), ("s", "sql_log", 3, 1.0, "2024"), ("t", "stack_log", 1, None, "2023")]
