import random

from skeinlab.llm import components as C
from skeinlab.runtime import Scratch
from tests.helpers import comments


def brute(pairs):
    posts = {p: p for p, _ in pairs}

    def find(x):
        while posts[x] != x:
            x = posts[x]
        return x

    first = {}
    for p, a in pairs:
        if a is not None:
            q = first.setdefault(a, p)
            x, y = sorted((find(p), find(q)))
            posts[y] = x
    groups = {}
    for p in posts:
        groups.setdefault(find(p), []).append(p)
    return {(p, min(g)) for g in groups.values() for p in g}


def rows(pairs):
    return [{"post_id": p, "comment_id": f"c{i}", "author": a} for i, (p, a) in enumerate(pairs)]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"p{rng.randrange(60):02d}", f"a{rng.randrange(70)}") for _ in range(90)] + [(f"q{i:02d}", f"b{i // 2}") for i in range(40)] + [(f"q{i:02d}", f"b{(i - 1) // 2}") for i in range(1, 40)]
    got = C.assign_splits(comments(spark, rows(pairs))).collect()
    assert {(r.post_id, r.group_id) for r in got} == brute(pairs)
    assert all(len({r.split for r in got if r.group_id == g}) == 1 for g in {r.group_id for r in got})


def test_author_spelling_and_stand_ins(spark):
    pairs = [("P1", " /u/Ann"), ("p2", "ann "), ("p3", "[deleted]"), ("p4", "[deleted]"), ("p5", None), ("p6", ""), ("p7", "U/ann"), (None, "ann"), ("p8", "u/[removed]"), ("p3", "u/[removed]"), ("p9", "Deleted"), ("p1", "deleted")]
    found = C.related_posts(C.assign_splits(comments(spark, rows(pairs))))
    assert {tuple(r) for r in found.collect()} == {("p1", "p1"), ("p2", "p1"), ("p7", "p1")}


def test_shares_are_filled(spark):
    pairs = [(f"p{i:03d}", f"a{i}") for i in range(400)] + [("p000", "a0")] * 3
    got = C.assign_splits(comments(spark, rows(pairs))).collect()
    n = {s: sum(r.n_comments for r in got if r.split == s) for s in C.SHARES}
    assert abs(n["train"] / 403 - 0.8) < 0.02 and abs(n["test"] / 403 - 0.1) < 0.02


def test_updates_keep_splits_and_quarantine_conflicts(spark):
    table = C.ComponentTable(spark, Scratch(spark, "table").root)
    first = {r.post_id: r for r in table.update(comments(spark, rows([(f"p{i:02d}", f"a{i}") for i in range(30)]))).collect()}
    a = next(p for p, r in first.items() if r.split == "train")
    b = next(p for p, r in first.items() if r.split != "train")
    other = next(p for p, r in first.items() if r.split == "train" and p != a)
    batch = [(a, "bridge"), (b, "bridge"), ("x1", "bridge"), (other, "calm"), ("x2", "calm"), ("x3", "fresh")]
    second = {r.post_id: r for r in table.update(comments(spark, rows(batch))).collect()}
    assert all(second[p].split == r.split for p, r in first.items())
    assert second[a].quarantined and second[b].quarantined and second["x1"].quarantined and second["x1"].split is None
    assert second[a].group_id == second[b].group_id == second["x1"].group_id == min(a, b)
    assert second["x2"].split == "train" and second["x2"].group_id == other and not second["x2"].quarantined
    assert second["x3"].split in C.SHARES
    third = {r.post_id: r for r in table.update(comments(spark, rows([("y1", "A" + a[1:].lstrip("0") if a != "p00" else "a0")]))).collect()}
    assert third["y1"].group_id == second[a].group_id and table.version() == 3


def test_empty(spark):
    assert C.related_posts(C.assign_splits(comments(spark, []))).isEmpty()
