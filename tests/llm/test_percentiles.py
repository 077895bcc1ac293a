import random

import numpy as np
import pytest

from skeinlab.llm import percentiles as P

SCHEMA = "thread_id string, model string, product_category string, scored_on string, self_bleu_4 double, semantic_mean_cosine double, mean_disagree_probability double, part string, n int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_numpy_with_ties_and_many_partitions(spark):
    rng = random.Random(2)
    rows = [(f"t{i}", "m" if i % 3 else "rare", None if i % 2 else "c", f"d{i % 5}", rng.randrange(6) / 5, rng.random(), None, "x", i) for i in range(700)]
    state = P.value_counts(table(spark, rows))
    for parts in (1, 9):
        got = P.percentiles(state, partitions=parts).collect()
        assert len(got) == 8
        for r in got:
            v = [x[4 if r.metric == "self_bleu_4" else 5] for x in rows if x[1] == r.model and x[2] == r.product_category]
            assert r.n == len(v) and r.max_error == 0.0
            assert [r[f"p{p}"] for p in P.PERCENTS] == pytest.approx(np.percentile(v, P.PERCENTS))


def test_what_counts(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", "m", "c", "d", 0.5, nan, inf, "x", 1)] * 3 + [("b", "m", "c", "d", -0.0, None, -inf, "x", 1), ("c", "m", "c", "e", 0.0, 2.0, None, "x", 1), ("__summary_mean__", "m", "c", "d", 9.0, 9.0, 9.0, "x", 1), (None, "m", "c", "d", 1.0, None, None, None, None)]
    got = {r.metric: r for r in P.percentiles(P.value_counts(table(spark, rows))).collect()}
    assert set(got) == {"self_bleu_4", "semantic_mean_cosine"}
    assert got["self_bleu_4"].n == 4 and got["self_bleu_4"].p50 == 0.25 and got["semantic_mean_cosine"].p1 == 2.0
    assert str(got["self_bleu_4"].p1)[0] != "-"


def test_days_merge(spark):
    rows = [(f"t{i}", "m", "c", f"d{i % 3}", i / 7, None, None, "x", i) for i in range(50)]
    days = [P.value_counts(table(spark, [r for r in rows if r[3] == d])) for d in ("d0", "d1", "d2")]
    whole, merged = P.percentiles(P.value_counts(table(spark, rows))).first(), P.percentiles(P.merge_counts(days)).first()
    assert whole == merged


def test_empty(spark):
    assert P.percentiles(P.value_counts(table(spark, []))).isEmpty()


def test_rows_that_differ_in_which_column_is_null(spark):
    rows = [("a", "m", "c", "d", None, 0.3, None, "x", 1), ("a", "m", "c", "d", 0.3, None, None, "x", 1)]
    got = {(r.metric, r.value, r.n) for r in P.value_counts(table(spark, rows)).collect()}
    assert got == {("self_bleu_4", 0.3, 1), ("semantic_mean_cosine", 0.3, 1)}
