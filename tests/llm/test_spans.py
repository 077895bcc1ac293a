import random

import pytest

from skeinlab.llm import spans as S
from skeinlab.llm.words import words
from tests.helpers import comments
from tests.llm.test_overlaps import TEXT, make, split_table


def brute(recs, splits):
    """Covered words of each record, by all spans of the other side."""
    side = {i: splits[p] == "train" for i, p, _ in recs}
    grams = lambda t: [tuple(t[k : k + S.SPAN]) for k in range(len(t) - S.SPAN + 1)]
    seen = {True: set(), False: set()}
    texts = {i: words(t) for i, _, t in recs}
    for i, t in texts.items():
        seen[side[i]].update(grams(t))
    out = {}
    for i, t in texts.items():
        hit = [False] * len(t)
        for k, g in enumerate(grams(t)):
            if g in seen[not side[i]]:
                hit[k : k + S.SPAN] = [True] * S.SPAN
        out[i] = sum(hit)
    return out


@pytest.mark.parametrize("size", [200_000, 40])
def test_coverage_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(S, "RANGE", size)
    splits, recs = make(random.Random(3), per=4)
    recs = [(i, p, t if k % 4 else "same words in very many records of both sides " + t) for k, (i, p, t) in enumerate(recs)]
    found = S.coverage(comments(spark, [{"comment_id": i, "post_id": p, "body": t, "subreddit": "s"} for i, p, t in recs]), split_table(spark, splits))
    assert {r.rec_id: r.covered for r in found.collect()} == brute(recs, splits)


def test_report_same_text_and_nothing_shared(spark):
    rows = [
        {"comment_id": "a", "post_id": "t3_p1", "body": TEXT, "subreddit": "s"}, {"comment_id": "b", "post_id": "P2", "body": TEXT.upper(), "subreddit": "s"},
        {"comment_id": "c", "post_id": "p1", "body": " ".join(f"x{i}" for i in range(25)), "subreddit": "s"}, {"comment_id": None, "post_id": "p1", "body": TEXT}, {"comment_id": "d", "post_id": "p1", "body": None},
    ]
    found = S.coverage(comments(spark, rows), split_table(spark, {"p1": "train", "p2": "test"}))
    assert {(r.rec_id, r.n, r.covered) for r in found.collect()} == {("a", 20, 20), ("b", 20, 20), ("c", 25, 0)}
    assert {(r.split, r.n_records, r.n_sharing, r.n_words, r.n_covered) for r in S.coverage_report(found).collect()} == {("train", 2, 1, 45, 20), ("test", 1, 1, 20, 20)}
    empty = comments(spark, [])
    assert S.coverage(empty, split_table(spark, {"p": "train"})).isEmpty()
