import random
from collections import Counter

import pytest

from skeinlab.llm import overlaps as O
from skeinlab.llm.words import words
from tests.helpers import comments


def split_table(spark, of):
    return spark.createDataFrame([(p, s) for p, s in of.items()], "post_id string, split string")


def brute(recs, splits, least):
    got = set()
    w = [(i, p, words(t)) for i, p, t in recs]
    for i, p, a in w:
        for j, q, b in w:
            if splits.get(p) == "train" and splits.get(q) in ("validation", "test") and i != j and min(len(a), len(b)) >= least:
                if sum((Counter(a) & Counter(b)).values()) >= 0.8 * max(len(a), len(b)):
                    got.add(tuple(sorted((i, j))))
    return got


VOCAB = [f"w{i}" for i in range(400)]


def make(rng, n_posts=40, per=6):
    splits = {f"p{i}": ("train", "train", "train", "validation", "test")[i % 5] for i in range(n_posts)}
    base = [" ".join(rng.choice(VOCAB) for _ in range(rng.randrange(20, 70))) for _ in range(30)]
    recs = []
    for i in range(n_posts * per):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(0, max(1, len(t) // 11))):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = [rng.choice(VOCAB)]
        if rng.random() < 0.2:
            k = rng.randrange(len(t))
            t = t[k:] + t[:k]
        recs.append((f"c{i}", f"p{i % n_posts}", " ".join(t)))
    return splits, recs


@pytest.mark.parametrize("block", [2_000, 3])
def test_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    splits, recs = make(random.Random(5))
    found = O.split_overlaps(comments(spark, [{"comment_id": i, "post_id": p, "body": t, "subreddit": "s"} for i, p, t in recs]), split_table(spark, splits))
    pairs = {(r.id_a, r.id_b) for r in O.overlap_pairs(found).collect()}
    assert pairs == brute(recs, splits, 20)
    for r in found.collect():
        assert 0 < r.train_covered <= r.train_words and 0 < r.eval_covered <= r.eval_words


TEXT = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_spelling_titles_and_dirt(spark):
    rows = [
        {"comment_id": "A", "post_id": "P1 ", "body": TEXT.upper(), "post_title": None, "subreddit": "s"},
        {"comment_id": "b", "post_id": "p2", "body": "Ｏne two thrée four-five s​ix seven; eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty", "post_title": TEXT, "subreddit": "s"},
        {"comment_id": "c", "post_id": "p3", "body": " ".join(TEXT.split()[:19]), "post_title": " ".join(TEXT.split()[:17] + ["else"]), "subreddit": "s"},
        {"comment_id": "d", "post_id": "nowhere", "body": TEXT, "subreddit": "s"},
        {"comment_id": "b", "post_id": "p2", "body": None, "post_title": "", "subreddit": "s"},
        {"comment_id": None, "post_id": "p2", "body": TEXT},
        {"comment_id": "e", "post_id": None, "body": TEXT, "post_title": TEXT},
    ]
    splits = split_table(spark, {"p1": "Train ", "P2": "TEST", "p3": "train", "p4": None})
    got = {tuple(r) for r in O.overlap_pairs(O.split_overlaps(comments(spark, rows), splits)).collect()}
    assert got == {("body", "a", "b"), ("post_title", "p2", "p3")}
    counts = O.overlap_counts(O.split_overlaps(comments(spark, rows), splits)).collect()
    assert {(r.field_name, r.split, r.subreddit, r.n_pairs) for r in counts} == {("body", "test", "s", 1), ("post_title", "test", "s", 1)}


def test_empty_and_one_sided(spark):
    c = comments(spark, [{"comment_id": f"c{i}", "post_id": "p", "body": TEXT} for i in range(3)])
    assert O.split_overlaps(c, split_table(spark, {"p": "train"})).isEmpty()
    assert O.split_overlaps(c.limit(0), split_table(spark, {"p": "train"}).limit(0)).isEmpty()


def test_words():
    assert words("Ｃａｆé’s  n°5_x­yz ﬁve") == ["cafe", "s", "n", "5", "xyz", "five"]
    assert words(None) == [] and words("") == []


@pytest.mark.parametrize("popular, block", [(1_500, 2_000), (2, 3)])
def test_pairs_without_a_long_span(spark, monkeypatch, popular, block):
    monkeypatch.setattr(O, "POPULAR", popular)
    monkeypatch.setattr(O, "BLOCK", block)
    rng = random.Random(7)
    splits, recs, titles = {}, [], {}
    for i in range(60):
        n = rng.choice([12, 15, 20, 30, 50])
        a = [rng.choice(VOCAB[:150]) for _ in range(n)]
        b = list(a)
        for k in range(n // 5):
            b[k * 5 + 2] = rng.choice(VOCAB)
        if i % 3 == 0:
            b = [w for k in range(0, n, 3) for w in reversed(b[k : k + 3])]
        if i % 3 == 1:
            b = b + [rng.choice(VOCAB)]
        for post, split, text in ((f"a{i}", "train", a), (f"b{i}", ("test", "validation")[i % 2], b)):
            splits[post] = split
            titles[post] = " ".join(text)
            recs.append((f"c{post}", post, " ".join(text)))
    rows = [{"comment_id": i, "post_id": p, "body": t, "post_title": titles[p], "subreddit": "s"} for i, p, t in recs]
    got = {tuple(r) for r in O.overlap_pairs(O.split_overlaps(comments(spark, rows), split_table(spark, splits))).collect()}
    wanted = {("body", *x) for x in brute(recs, splits, 20)} | {("post_title", *x) for x in brute([(p, p, t) for p, t in titles.items()], splits, 12)}
    assert len(wanted) > 60 and got == wanted
