import gzip
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.redact import PATTERNS, SECRETS, redact, with_redaction
from lodestrata.sources import extract as X
from lodestrata.sources import scan, store
from lodestrata.sources import telemetry as T
from lodestrata.streaming import ingest as I


def test_scan_and_admission(spark, tmp_path):
    for name, text in {"src/a.py": "x", "src/b.min.js": "y", "node_modules/z.js": "z", "img.png": "p", "notes.xyz": "n", "id_rsa": "k", "src/big.go": "g" * 900}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = scan.scan_tree(spark, f"file:{tmp_path}").withColumn("why", scan.admission(F.col("path"), F.col("size_bytes"), ["*.js", "!keep.js"], 500))
    got = {r["path"]: r["why"] for r in rows.collect()}
    assert got == {"src/a.py": None, "src/b.min.js": "ignored", "node_modules/z.js": "skipped_dir", "id_rsa": "secret", "img.png": "binary", "notes.xyz": "unknown_language", "src/big.go": "too_large"}
    assert [r["path"] for r in scan.scan_paths(spark, f"file:{tmp_path}", ["src/a.py"]).collect()] == ["src/a.py"]
    assert {r["reason"]: r["files"] for r in scan.skip_counts(rows, "why").collect()}["read"] == 1


def test_traces(spark, tmp_path):
    attr = lambda k, **v: {"key": k, "value": v}
    span = {"name": "s", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3500000", "attributes": [attr("code.filepath", stringValue="a.py"), attr("code.lineno", intValue="7"), attr("code.function", stringValue="f"), attr("code.function", stringValue="g")]}
    bad = {"name": "t", "startTimeUnixNano": "x", "attributes": []}
    lines = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, bad]}]}]}), "{broken", ""]
    with gzip.open(tmp_path / "t.json.gz", "wt") as out:
        out.write("\n".join(lines))
    got = {r["name"]: tuple(r)[1:] for r in T.spans(T.read_traces(spark, f"file:{tmp_path}/t.json.gz")).collect()}
    assert got == {"s": ("a.py", 7, "g", 2.5), "t": (None, None, None, None)}


def test_sql_logs(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Query,Calls,Total_Time\n"select a, b from x.t1 join ""T2"" on t1.id = t2.k where c = 1",3,4.5\n,1,1\n')
    row = T.read_sql_stats(spark, f"file:{tmp_path}/s.csv").first()
    assert (row["calls"], row["total_ms"], row["mean_ms"]) == (3, 4.5, None)
    q = spark.createDataFrame([(row["query"],)], "q string")
    assert q.select(T.sql_tables(F.col("q"))).first()[0] == ["t1", "t2"] and set(q.select(T.sql_columns(F.col("q"))).first()[0]) == {"a", "b", "id", "k", "c"}
    (tmp_path / "s.jsonl").write_text('# log\n{"sql": "select 1", "duration_ms": "2.5", "calls": 2}\n{bad\n\n{"query": "x"}\n')
    assert sorted((r["query"], r["calls"], r["duration_ms"]) for r in T.read_sql_lines(spark, f"file:{tmp_path}/s.jsonl").collect()) == [("select 1", 2, 2.5), ("x", 1, None)]
    t = spark.createDataFrame([("select * from {{ ref('a') }} {# no #} where {% if x %} d = {{ v }} {% endif %}",)], "q string")
    assert t.select(T.strip_templates(F.col("q"))).first()[0].split() == "select * from a where d = NULL".split()


def test_stack_frames(spark):
    text = 'Traceback:\n  File "a/b.py", line 12, in run\n    x()\nException in thread\n\tat com.x.Y.go(Y.java:33)\n    at async load (lib/z.js:4:9)\n'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = {(r["runtime"], r["file"], r["line"], r["function"]) for r in T.stack_frames(df, "id", "text").collect()}
    assert got == {("python", "a/b.py", 12, "run"), ("jvm", "Y.java", 33, "com.x.Y.go"), ("node", "lib/z.js", 4, "load")}


def test_redaction(spark):
    df = spark.createDataFrame([("select 'it''s' from t where id = 42 and ip = '1.2.3.4' -- me@x.org 10.0.0.1",), (None,), ("'" * 4001 + "x" * 100_000,)], "t string")
    rows = with_redaction(df, "t").collect()
    assert rows[0]["t"] == "select [REDACTED:sql_string_literal] from t where id = [REDACTED:sql_numeric_param] and ip = [REDACTED:sql_string_literal] -- [REDACTED:email_address] [REDACTED:ipv4_address]"
    assert rows[0]["fired"] == {"sql_string_literal": 2, "sql_numeric_param": 1, "email_address": 1, "ipv4_address": 1} and rows[1]["t"] is None and rows[1]["fired"] == {}
    secret = spark.createDataFrame([("api_key = 'abcdefghijkl123'",)], "t string").select(redact(F.col("t"), SECRETS)).first()[0]
    assert secret == "api_key = '[REDACTED:assigned_secret]'" and len(PATTERNS) == 6


def test_extraction(spark):
    code = "import os\nfrom a.b import c\nclass A:\n    def f(self):\n        for i in x:\n            eval(i)\n        return g()\n\ndef g():\n    return 'sk-1'\ndef cut(:\n"
    df = spark.createDataFrame([("m.py", code), ("n.py", None), ("e.py", "")], "path string, content string")
    nodes = X.python_nodes(df)
    got = {(r["kind"], r["name"], r["line"]) for r in nodes.collect()}
    assert {("class", "A", 3), ("method", "f", 4), ("call", "eval", 6), ("function", "g", 9), ("string", "sk-1", 10), ("loop", "For", 5)} <= got
    assert [r["line"] for r in nodes.where(X.node_filter("call:eval")).collect()] == [6] and nodes.where(X.node_filter("string:/^sk-/")).count() == 1 and nodes.where(X.node_filter("lines:>=4")).count() == 1
    assert {(r["caller"], r["callee"]) for r in X.call_owners(nodes).collect()} == {("f", "eval"), ("f", "g")}
    symbols = spark.createDataFrame([("m.py::A", "m.py", 3, 7), ("m.py::f", "m.py", 4, None)], "id string, file string, line int, end_line int")
    assert {r["name"]: r["symbol"] for r in X.enclosing(nodes.where("kind = 'call'"), symbols).collect()} == {"eval": "m.py::f", "g": "m.py::f"}
    assert df.where("path = 'm.py'").select(X.imported(F.col("content"), "python")).first()[0] == ["os", "a.b"]
    with pytest.raises(ValueError):
        X.node_filter("what:x")
    s = spark.createDataFrame([("p", "q", "function", 1), ("p", "q", "function", 5)], "path string, qualified_name string, kind string, line int")
    assert sorted(r["id"] for r in X.overload_ids(s).collect()) == ["p::q#function", "p::q#function~1"]
    go = spark.createDataFrame([("a.go", "package x\nfunc (t *T) Run(a int) error {\n}\ntype T struct {\n")], "path string, content string")
    assert {(r["kind"], r["name"], r["line"]) for r in X.declared(go, "go").collect()} == {("function", "Run", 2), ("type", "T", 4)}
    v = spark.createDataFrame([("hello",), ("",)], "t string").select(X.hashed_vector(F.col("t"), 8)).collect()
    assert abs(sum(x * x for x in v[0][0]) - 1) < 1e-9


def test_store(spark, tmp_path):
    a, b = f"file:{tmp_path}/a", f"file:{tmp_path}/b"
    cols = "path string, v int"
    store.write_full(spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], cols), a)
    store.save_incremental(spark, a, spark.createDataFrame([("y", 9), ("n", 4)], cols), spark.createDataFrame([("z",)], "path string"), "path", b)
    assert sorted(map(tuple, store.read_store(spark, b).collect())) == [("n", 4), ("x", 1), ("y", 9)]
    store.append_events(spark.createDataFrame([("q", [str(i) for i in range(60)])], "query string, returned_ids array<string>"), f"file:{tmp_path}/e")
    e = spark.read.parquet(f"file:{tmp_path}/e").first()
    assert len(e["returned_ids"]) == 50 and len(e["query_hash"]) == 16
    lines = sorted(r[0] for r in store.compact_lines(spark.createDataFrame([("a/b.py", 1), ("a/b.py", 2)], "path string, n2 int"), "path").collect())
    assert lines == ["1\t1", "1\t2", "@1=a/b.py"]


def test_call_ingest_is_not_merged_twice(spark, tmp_path):
    schema = "pid bigint, file string, line int, name string, calls bigint, duration_ms double"
    source = tmp_path / "in"
    source.mkdir()
    symbols = spark.createDataFrame([("s1", "f.py", "f", 1, 9), ("s2", "f.py", "g", 10, 20)], "id string, file string, name string, line int, end_line int")
    sink = I.CallIngest(symbols, f"file:{tmp_path}/state", "otel", lambda: "2025-01-01T00:00:00Z")
    for n, lines in enumerate([[(1, 5, 2, 1.0), (2, 12, 1, 4.0)], [(3, 6, 3, 9.0), (4, 99, 1, 1.0)]]):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"pid": p, "file": "f.py", "line": at, "name": "x", "calls": c, "duration_ms": d}) for p, at, c, d in lines))
        sink.start(I.file_stream(spark, f"file:{source}", schema), f"file:{tmp_path}/ck").awaitTermination()
    got = {r["symbol_id"]: (r["count"], r["p50_ms"]) for r in sink.state(spark).collect()}
    assert got == {"s1": (5, 9.0), "s2": (1, 4.0)}
    sink(spark.read.schema(schema).json(f"file:{source}/1.json"), 1)
    assert {r["symbol_id"]: r["count"] for r in sink.state(spark).collect()} == {"s1": 5, "s2": 1}


def test_streamed_sessions_and_debounce(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = ["2025-01-01T00:00:00Z", "2025-01-01T00:00:30Z", "2025-01-01T00:02:00Z", "2025-01-01T03:00:00Z"]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"u": "a", "ts": t, "n": i + 1}) for i, t in enumerate(at)))
    stream = I.file_stream(spark, f"file:{tmp_path}/in", "u string, ts timestamp, n int")
    I.session_totals(stream, "u", "ts", "31 seconds", "1 minute", "n").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"file:{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["total"] for r in spark.sql("select * from sessions").collect()) == [3, 3]
    seen = []
    I.debounced(stream, lambda df: seen.extend(r["n"] for r in df.collect()), "u", "ts", f"file:{tmp_path}/c2").awaitTermination()
    assert seen == [4]
