import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scores as S
from lodestrata.functions import text as T
from lodestrata.functions.tokenize import text_tokens
from lodestrata.operators import ranking as R

WORDS = ["parseConfig", "updateDbConn", "testing test", "configs", "init_ctx", "running", "a", "HTTPServer2", "passes", "boxes", None, ""]


def test_both_tokenizers_agree(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = df.select("w", T.tokens("w").alias("t")).collect()
    assert all(sorted(r["t"]) == sorted(text_tokens(r["w"])) for r in got)
    assert sorted(text_tokens("testing test")) == ["test", "test", "testing"] and sorted(text_tokens("test testing")) == ["test", "testing"]


def test_bm25_against_a_plain_version(spark):
    rng = random.Random(1)
    vocab = ["parse", "config", "node", "walk", "tree", "running"]
    rows = [(f"d{i}", " ".join(rng.choices(vocab, k=rng.randint(0, 6))), rng.choices(vocab, k=2) if i % 5 else None, None, "", " ".join(rng.choices(vocab, k=3))) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, name string, keywords array<string>, signature string, summary string, docstring string")
    bags = {}
    for i, name, kw, sig, sm, doc in rows:
        bags[i] = text_tokens(name) * 3 + [k.lower() for k in kw or []] * 2 + text_tokens(sig) * 2 + text_tokens(sm) + text_tokens(doc)
    n, avg = len(bags), sum(len(set(b)) for b in bags.values()) / len(bags)
    want = {}
    for i, b in bags.items():
        total = 0.0
        for t in ("parse", "tree"):
            d = sum(t in x for x in bags.values())
            if t in b:
                tf = b.count(t)
                total += math.log((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(set(b)) / avg))
        if total:
            want[i] = total
    got = {r["id"]: r["lexical"] for r in R.bm25(df, ["parse", "tree", "parse"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert R.bm25(df.limit(0), ["parse"]).count() == 0


def test_identity_and_similarity(spark):
    df = spark.createDataFrame([("get_sym", "a::get_sym"), ("get_symbol", "x"), ("other", "a/get_sym/b"), ("no", None), (None, None)], "n string, k string")
    assert [r[0] for r in df.select(S.identity_score(F.col("n"), F.col("k"), "get_sym", "get_sym")).collect()] == [50.0, 30.0, 20.0, 0.0, 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([0.0], [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_fusion_keeps_contributions(spark):
    ch = spark.createDataFrame([("a", "x", 1, 1.0), ("a", "y", 3, 2.0), ("b", "x", 2, 1.0)], "id string, channel string, rank int, weight double")
    got = {r["id"]: r for r in R.fuse_channels(ch, "id").collect()}
    assert abs(got["a"]["score"] - (1 / 61 + 2 / 63)) < 1e-8 and set(got["a"]["contributions"]) == {"x", "y"} and abs(got["b"]["score"] - 1 / 62) < 1e-8


def test_packing_is_greedy_with_skips(spark):
    rows = [("q", f"i{n}", f"f{n % 2}", 10.0 - n, size) for n, size in enumerate([50, 60, 30, 10, 5, 5, 5, 5])]
    got = [(r["place"], r["id"]) for r in R.pack_budget(spark.createDataFrame(rows, "g string, id string, file string, score double, size int"), "g", "id", "file", "score", "size", 100).orderBy("place").collect()]

    def plain():
        pool, left, taken, out = [r[1:] for r in rows], 100, {}, []
        while pool:
            best = max(range(len(pool)), key=lambda i: (pool[i][2] * 0.5 ** taken.get(pool[i][1], 0), -i))
            i, f, _, size = pool.pop(best)
            if taken.get(f, 0) < 3 and size <= left:
                taken[f], left = taken.get(f, 0) + 1, left - size
                out.append((len(out) + 1, i))
        return out

    assert got == plain()


def test_ranking_quality(spark):
    p = spark.createDataFrame([("q1", ["a", "b", "a", "c"]), ("q2", [])], "q string, ids array<string>")
    rel = spark.createDataFrame([("q1", "b"), ("q1", "z"), ("q2", "a"), ("q3", "a")], "q string, id string")
    got = {r["q"]: (r["ndcg"], r["mrr"], r["recall"]) for r in R.ranking_quality(p, rel, "q", "id").collect()}
    assert got["q1"] == (round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6), 0.5, 0.5) and got["q2"] == got["q3"] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("text", "want"), [("a/./b/../c.py", "a/c.py"), ("../x", "../x"), ("a//b/", "a/b"), ("./a", "a"), ("a/../../b", "../b")])
def test_paths(spark, text, want):
    assert spark.createDataFrame([(text,)], "p string").select(T.normal_path(F.col("p"))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("src/my-widget.test.js",)], "p string")
    p = F.col("p")
    got = df.select(T.basename(p), T.dirname(p), T.file_stem(p), T.kebab_to_pascal(F.lit("my-big-box")), T.is_test_file(p), T.glob_match(p, "*.test.js"), T.whole_word_count(F.lit("a.b ab a"), "a")).first()
    assert tuple(got) == ("my-widget.test.js", "src", "my-widget.test", "MyBigBox", True, True, 2)
    for bad in ("x" * 300, "(a+)+", "("):
        with pytest.raises(Exception):
            T.check_pattern(bad)


def test_packing_tries_every_row(spark):
    rows = [("q", f"i{i:05}", f"f{i}", 5000.0 - i, 101 if i % 2 else 90) for i in range(3000)] + [("q", "last", "f0", 0.5, 10)]
    got = R.pack_budget(spark.createDataFrame(rows, "g string, id string, file string, score double, size int"), "g", "id", "file", "score", "size", 100)
    assert sorted((r["place"], r["id"], r["effective"]) for r in got.collect()) == [(1, "i00000", 5000.0), (2, "last", 0.25)]


def test_packing_in_chunks_is_the_same_as_at_once(spark):
    rng = random.Random(3)
    rows = [(g, f"i{n:03}", f"f{rng.randint(0, 6)}", float(rng.randint(0, 12)), rng.randint(0, 60)) for g in "ab" for n in range(150)]
    rows += [("a", "none", "f1", None, 5), ("a", "wide", "f1", 50.0, 500), ("b", "null", "f2", 9.0, None), ("c", "big", "f", 1.0, 101)]
    df = spark.createDataFrame(rows, "g string, id string, file string, score double, size int")

    def plain(group):
        pool = sorted((r[1:] for r in rows if r[0] == group and r[3] is not None and r[4] is not None), key=lambda r: (-r[2], r[0]))
        left, taken, out = 100, {}, []
        while pool:
            best = min(range(len(pool)), key=lambda i: (-pool[i][2] * 0.5 ** taken.get(pool[i][1], 0), i))
            i, f, s, size = pool.pop(best)
            if taken.get(f, 0) < 3 and size <= left:
                out.append((len(out) + 1, i, s * 0.5 ** taken.get(f, 0)))
                taken[f], left = taken.get(f, 0) + 1, left - size
        return out

    for chunk in (7, 40, 1000):
        got = R.pack_budget(df, "g", "id", "file", "score", "size", 100, chunk=chunk).collect()
        for g in "abc":
            assert sorted((r["place"], r["id"], r["effective"]) for r in got if r["g"] == g) == plain(g), (chunk, g)
    assert R.pack_budget(df.limit(0), "g", "id", "file", "score", "size", 100).count() == 0


def test_channels_are_ranked_by_ranges(spark):
    rng = random.Random(5)
    a = [(f"k{i:03}", float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(a, "id string, v double").repartition(7)
    other = spark.createDataFrame([("x", 3), ("y", 3), ("z", 0)], "id string, n int")
    got = {(r["channel"], r["id"]): (r["rank"], r["weight"]) for r in R.rank_channels([(df, "v", "main", 1.0), (other, "n", "few", 2.0)], "id").collect()}
    order = sorted((x for x in a if x[1] > 0), key=lambda x: (-x[1], x[0]))
    assert got == {("main", k): (i, 1.0) for i, (k, _) in enumerate(order, 1)} | {("few", "x"): (1, 2.0), ("few", "y"): (2, 2.0)}


def test_a_budget_is_filled_up_to_the_first_that_does_not_fit(spark):
    rows = [("g", i, 1.0 / (1 + i), s) for i, s in enumerate([4, 0, 5, 0, 3, 0, 1])] + [("h", 0, 1.0, 0), ("k", 0, 1.0, 11), ("k", 1, 0.5, 0)]
    got = R.fill_budget(spark.createDataFrame(rows, "g string, i int, rank double, size int"), "g", ["-rank", "i"], "size", 10)
    assert sorted((r["g"], r["i"]) for r in got.collect()) == [("g", 0), ("g", 1), ("g", 2), ("g", 3), ("h", 0)]
