import random

import pytest

from skeinlab.operators import hierarchy as H
from skeinlab.runtime import hot_keys, salted_join
from tests.helpers import comments, posts


def brute(parent):
    """state and depth of every node of {node: parent or None}."""
    out = {}
    for v in parent:
        seen, x = [], v
        while x is not None and x not in seen:
            seen.append(x)
            x = parent[x]
        out[v] = ("tree", len(seen) - 1) if x is None else ("cycle", None) if x == v else ("below_cycle", None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_contract_equals_walking(spark, seed):
    rng = random.Random(seed)
    n = 120
    names = [f"n{i}" for i in range(n)]
    shapes = [lambda i: None if i == 0 else names[i - 1], lambda i: None if i < 3 else names[rng.randrange(i)], lambda i: names[rng.randrange(n)], lambda i: None if i % 9 == 0 else names[rng.randrange(n)]]
    parent = {names[i]: shapes[seed](i) for i in range(n)}
    df = spark.createDataFrame([(v, p, "post" if p is None else None) for v, p in parent.items()], "comment_id string, parent string, post string")
    rows = H.contract(df, with_paths=True, with_sizes=True).collect()
    want = brute(parent)
    assert {r.comment_id: (r.state, r.depth) for r in rows} == want
    for r in rows:
        if r.state == "tree":
            path, x = [], parent[r.comment_id]
            while x is not None:
                path.insert(0, x)
                x = parent[x]
            assert list(r.path) == path and r.root == "post"
    below = dict.fromkeys(parent, 0)
    for v in parent:
        x, seen = v, set()
        while x is not None and x not in seen:
            seen.add(x)
            below[x] += 1
            x = parent[x]
    assert {r.comment_id: r.size for r in rows if r.state != "cycle"} == {r.comment_id: below[r.comment_id] for r in rows if r.state != "cycle"}


def test_problems(spark):
    c = comments(spark, [
        {"comment_id": "A", "parent_id": "t3_P", "depth": 0}, {"comment_id": "b", "parent_id": "t1_a", "depth": 3}, {"comment_id": "c", "parent_id": "b", "depth": None},
        {"comment_id": "x", "parent_id": "t1_y"}, {"comment_id": "y", "parent_id": "t1_x "}, {"comment_id": "z", "parent_id": "t1_x", "depth": 1}, {"comment_id": "s", "parent_id": "T1_S"},
        {"comment_id": "o", "parent_id": "t3_unknown", "depth": 7}, {"comment_id": "m", "parent_id": None, "depth": 7}, {"comment_id": "b", "parent_id": "t1_a", "depth": 3, "hour": 9}, {"comment_id": None, "parent_id": "t1_a"},
    ])
    got = {tuple(r) for r in H.hierarchy_problems(c, posts(spark, [("p", 0)])).collect()}
    assert got == {("b", "depth"), ("x", "cycle"), ("y", "cycle"), ("z", "below_cycle"), ("s", "cycle")}


def test_descendants_and_empty(spark):
    c = comments(spark, [{"comment_id": "a", "parent_id": "t3_p"}, {"comment_id": "b", "parent_id": "t1_a"}, {"comment_id": "c", "parent_id": "t1_b"}])
    h = H.hierarchy(c, posts(spark, [("p", 0)]))
    assert {tuple(r) for r in H.descendants(h).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert H.hierarchy_problems(comments(spark, []), posts(spark, [])).isEmpty()


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2), (None, 3)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w int")
    key = lambda r: tuple(str(x) for x in r)
    for hot in ([], ["hot"], ["hot", None], [None]):
        for how in ("left", "inner"):
            assert sorted(salted_join(big, small, "k", how, hot).collect(), key=key) == sorted(big.join(small, "k", how).collect(), key=key)
    assert hot_keys(big, "k", 2, 9) == ["hot", None]
