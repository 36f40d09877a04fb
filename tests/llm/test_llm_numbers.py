"""Percentiles, fusion, distinctive terms and mixes against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import distinctive as T
from lodestrata.llm import fusion as R
from lodestrata.llm import mixture as M
from lodestrata.llm import quantiles as Q


def rank_value(values, p):
    return sorted(values)[math.ceil(p * len(values)) - 1]


@pytest.mark.parametrize("by_day", [False, True])
def test_percentiles(spark, by_day):
    rng = random.Random(4)
    rows = [("hot", round(rng.lognormvariate(2, 2), 3), f"d{rng.randrange(9)}") for _ in range(1500)]
    rows += [("ties", float(rng.randrange(3)), "d1") for _ in range(300)] + [("same", 5.0, None)] * 60 + [("one", -1.5, "d2")]
    rows += [("hot", None, "d1"), ("hot", float("nan"), "d1"), (None, 1.0, "d1")]
    df = spark.createDataFrame(rows, "tool string, duration double, n string").repartition(5)
    day = F.coalesce("n", F.lit("unknown")) if by_day else None
    got = {(r["tool"], r["percent"]): (r["value"], r["n"]) for r in Q.multi_select(df.drop("n") if not by_day else df, ["tool"], "duration", day, finish=150).collect()}
    groups = defaultdict(list)
    for tool, v, _ in rows:
        if tool and v is not None and v == v:
            groups[tool].append(v)
    assert got == {(t, p): (rank_value(v, p), len(v)) for t, v in groups.items() for p in Q.PERCENTS}


def test_no_measurements(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0)], "tool string, v double")
    assert Q.multi_select(df, ["tool"], "v").count() == 0
    assert Q.multi_select(df.limit(0), ["tool"], "v").count() == 0


def fused(rows):
    best = defaultdict(dict)
    for q, s, scores in rows:
        for c, v in (scores or {}).items():
            if q is not None and s is not None and v is not None and v == v:
                best[q, c][s] = max(v, best[q, c].get(s, -math.inf))
    out = {(q, s): 0.0 for q, s, _ in rows if q is not None and s is not None}
    for (q, _), mine in best.items():
        for s, v in mine.items():
            out[q, s] += 1 / (60 + 1 + sum(w > v for w in mine.values()))
    return {k: round(v, 12) for k, v in out.items()}


@pytest.mark.parametrize("chunk", [100_000, 15])
def test_reciprocal_ranks(spark, chunk):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(2, 6), f"s{rng.randrange(60)}", {c: rng.choice([None, float("nan"), round(rng.random() * 10**e, 2), 1.0]) for e, c in enumerate("abcd") if rng.random() < 0.8}) for _ in range(250)]
    rows += [(None, "s1", {"a": 1.0}), (1, None, {"a": 1.0}), (9, "x", None), (9, "y", {}), rows[0]]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "q bigint, s string, m map<string,double>, score double")
    out = R.reciprocal_rank_fusion(df, "q", "s", "m", chunk=chunk)
    want = fused(rows)
    assert {(r["q"], r["s"]): r["fused"] for r in out.collect()} == want
    best = {r["q"]: r["s"] for r in R.best_per_query(out, "q", "s").collect()}
    assert best == {q: min((s for p, s in want if p == q), key=lambda s: (-want[q, s], s)) for q, _ in want}
    ranked = {(r["q"], r["s"]): r["rank"] for r in R.ranks(out, ["q"], "fused", chunk).collect()}
    assert ranked == {(q, s): 1 + sum(1 for (p, _), w in want.items() if p == q and w > v) for (q, s), v in want.items()}
    assert R.reciprocal_rank_fusion(df.limit(0), "q", "s", "m").count() == 0


def test_terms(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "rare", "common", "x"]
    docs = [(f"d{i}", [rng.choice(vocab[:5] + ["common"] * 4) for _ in range(rng.randrange(0, 9))]) for i in range(40)] + [("only", ["x", "x", "common"]), (None, ["a"]), ("none", None)]
    df = spark.createDataFrame([(*d, "t") for d in docs], "id string, terms array<string>, term string").select("id", "terms")
    tf = {i: Counter(t or []) for i, t in docs if i}
    cf, dfreq = Counter(), Counter()
    for c in tf.values():
        cf.update(c)
        dfreq.update(c.keys())
    size, mu = sum(cf.values()), sum(cf.values()) / sum(1 for c in tf.values() if c)
    want = {}
    for i, c in tf.items():
        n = sum(c.values())
        for t, k in c.items():
            if dfreq[t] >= 2:
                q = cf[t] / size
                p = (k + mu * q) / (n + mu)
                want[i, t] = p * math.log(p / q)
    scored = T.term_scores(df)
    got = {(r["id"], r["term"]): r["score"] for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    asked = spark.createDataFrame([("d1",), ("d1",), ("gone",)], "id string")
    assert {r["id"] for r in T.term_scores(df, asked).collect()} <= {"d1"}
    top = {r["id"]: r["term"] for r in T.top_term(scored).collect()}
    assert all(abs(want[i, t] - max(v for (j, _), v in want.items() if j == i)) < 1e-9 for i, t in top.items())
    assert T.term_scores(df.limit(0)).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("parseHTTPConfig_v2", ["Big-Cache"], "Reads über fooBar."), (None, None, None)], "name string, keywords array<string>, summary string")
    got = [r[0] for r in df.select(T.words(F.col("name"), F.array_join("keywords", " "), F.col("summary"))).collect()]
    assert got == [["parse", "httpconfig", "v", "big", "cache", "reads", "ber", "foobar"], []]


def test_shares_fill_up():
    given = M.fill_shares({"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.1}, {"a": 1000, "b": 10, "c": 1000, "none": 0}, 100)
    assert given["b"] == 10 and given["none"] == 0 and abs(given["a"] / given["c"] - 2.5) < 1e-9 and abs(sum(given.values()) - 100) < 1e-6
    assert sum(M.fill_shares({"a": 1.0}, {"a": 5}, 100).values()) == 5


@pytest.mark.parametrize("blocks", [{"a": 500, "b": 50, "c": 450}, {"a": 7, "b": 1}, {"a": 1, "b": 2, "c": 3, "d": 5, "e": 89}])
def test_schedule_is_fair_everywhere(blocks):
    order, done, total = M.pfair_schedule(blocks), Counter(), sum(blocks.values())
    assert Counter(s for s, _ in order) == blocks
    for i, (s, j) in enumerate(order, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - i * n / total) < 1 for x, n in blocks.items())


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, "big" if i % 3 else "small" if i % 2 else "mid", rng.randrange(1, 400)) for i in range(600)] + [(1000, None, 5), (1001, "other", 5), (1002, "big", 0), (None, "big", 5)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, source string, n_tokens bigint, slot int").select("doc_id", "source", "n_tokens")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.45, 2), ("mid", 0.2, 5), ("empty", 0.05, 3), ("zero", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = M.mix(df, targets, bucket_rows=50, block_tokens=500)
    rows = out.collect()
    assert {r["source"] for r in rows} == {"big", "small", "mid"} and len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    most = {"big": 1, "small": 2, "mid": 5}
    for s, cap in most.items():
        copies = Counter(r["doc_id"] for r in rows if r["source"] == s)
        assert max(copies.values()) <= cap
        left = {d for d, x, n in docs if x == s and n > 0 and d is not None} - set(copies)
        assert max(copies.values()) - (0 if left else min(copies.values())) <= 1
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    have = {s: sum(n for d, x, n in docs if x == s and d is not None) for s in most}
    want = M.fill_shares({"big": 0.3, "small": 0.45, "mid": 0.2}, {s: have[s] * c for s, c in most.items()}, sum(have.values()))
    assert all(abs(tokens[s] - want[s]) <= 400 for s in most)
    report = {r["source"]: r for r in M.mix_report(out, targets.where("source is not null")).collect()}
    assert report["empty"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-5
    assert M.mix(df.limit(0), targets).count() == 0
