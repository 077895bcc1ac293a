from pyspark.sql import functions as F

from skeinlab.operators import references as R
from tests.helpers import comments, posts, removals


def found(spark, c, p, n):
    return {tuple(r) for r in R.dangling_references(c, p, n).select("ref_field", "comment_id", "kind").collect()}


def test_kinds_spelling_and_nulls(spark):
    c = comments(spark, [
        {"comment_id": "K1", "parent_id": " T3_P1\t", "post_fullname": "t3_p1", "hour": 5},
        {"comment_id": "k2", "parent_id": "t1_gone", "post_fullname": "p9", "hour": 5},
        {"comment_id": "k3", "parent_id": "t1_K1 ", "post_fullname": None, "hour": 1},
        {"comment_id": "k4", "parent_id": "", "post_fullname": "t3_", "hour": 1},
        {"comment_id": "k5", "parent_id": "t3_p2", "post_fullname": "t3_p2", "hour": 1},
        {"comment_id": "k6", "parent_id": "t1_p2", "post_fullname": "p2", "hour": 9},
        {"comment_id": None, "parent_id": "t1_nowhere", "post_fullname": "t3_nowhere"},
        {"comment_id": "k2", "parent_id": "t1_gone", "post_fullname": "p9", "hour": 50},
    ])
    got = found(spark, c, posts(spark, [("p1", 0), ("P2", 3)]), removals(spark, ["t1_gone", "T3_P2", None, "", "k1"]))
    assert got == {
        ("parent_id", "k2", "removed"), ("post_fullname", "k2", "missing"), ("parent_id", "k3", "removed"), ("parent_id", "k5", "removed"), ("post_fullname", "k5", "removed"),
        ("parent_id", "k6", "missing"), ("post_fullname", "k6", "removed"),
    }


def test_late_uses_first_retrievals(spark):
    c = comments(spark, [{"comment_id": "a", "parent_id": "t1_b", "hour": 4}, {"comment_id": "a", "parent_id": "t1_b", "hour": 1}, {"comment_id": "b", "hour": 2}, {"comment_id": "c", "parent_id": "b", "hour": 2}])
    assert found(spark, c, posts(spark, []), removals(spark, [])) == {("parent_id", "a", "late")}


def test_empty_tables(spark):
    assert found(spark, comments(spark, []), posts(spark, []), removals(spark, [])) == set()


def test_counts_by_month(spark):
    c = comments(spark, [{"comment_id": "a", "parent_id": "t1_x", "created_utc": 1735689600}, {"comment_id": "b", "parent_id": "t1_x", "created_utc": None}])
    got = R.dangling_counts(R.dangling_references(c, posts(spark, []), removals(spark, [])))
    assert {tuple(r) for r in got.collect()} == {("parent_id", "2025-01", "missing", 1), ("parent_id", None, "missing", 1)}


def test_bloom_filter_misses_nothing_and_rejects_most(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"))
    table, blocks = R.bloom_blocks(keys, "id", 5000)
    assert R.bloom_probe(keys, "id", table, blocks).where("not maybe").isEmpty()
    other = spark.range(5000).select(F.concat(F.lit("z"), "id").alias("id"))
    assert R.bloom_probe(other, "id", table, blocks).where("maybe").count() < 250


def test_hot_parent_is_whole(spark):
    c = comments(spark, [{"comment_id": f"c{i}", "parent_id": "t3_hot", "hour": 1} for i in range(300)])
    got = found(spark, c, posts(spark, [("hot", 5)]), removals(spark, []))
    assert len(got) == 300 and {k for _, _, k in got} == {"late"}
