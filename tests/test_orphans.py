import pytest

from lodestrata.operators.orphans import orphan_references, orphan_report


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_single_key(spark):
    refs = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("x", "t1"), (None, "t1"), ("X", "t2"), ("a ", "t2")], "ref string, id string")
    keys = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "id string, ref int")
    assert rows(orphan_references(refs, ["ref"], keys, ["id"])) == [("X", "t2"), ("a ", "t2"), ("x", "t1")]
    report = orphan_report(orphan_references(refs, ["ref"], keys, ["id"]), ["id"])
    assert rows(report) == [("t1", 1), ("t2", 2)]


@pytest.mark.parametrize(
    ("match", "want"),
    [
        ("simple", {(1, 9)}),
        ("partial", {(1, 9), (7, None), (None, 9)}),
        ("full", {(1, 9), (1, None), (7, None), (None, 9), (None, 2)}),
    ],
)
def test_composite_keys_with_nulls(spark, match, want):
    refs = spark.createDataFrame([(1, 2), (1, 9), (1, None), (7, None), (None, 9), (None, 2), (None, None)], "a int, b int")
    keys = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    assert {tuple(r) for r in orphan_references(refs, ["a", "b"], keys, ["x", "y"], match).collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ref string")
    some = spark.createDataFrame([("a",)], "ref string")
    assert orphan_references(none, ["ref"], some.withColumnRenamed("ref", "id"), ["id"]).count() == 0
    assert rows(orphan_references(some, ["ref"], none, ["ref"])) == [("a",)]


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        orphan_references(spark.createDataFrame([], "a int"), ["a"], spark.createDataFrame([], "a int"), ["a"], "some")
