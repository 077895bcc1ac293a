from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlab.llm import packing, segmentation
from skeinlab.llm.bpe import transducer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 20)), min_size=1, max_size=120))
def test_fill_respects_all_limits(items):
    d = np.array([(t, min(l, t), 1) for t, l in items])
    limits = np.array([50, 30, 6])
    of = packing.fill(d, limits)
    for c in range(of.max() + 1):
        assert (of == c).any() and (d[of == c].sum(axis=0) <= limits).all()


def test_fill_leaves_little_room():
    rng = np.random.default_rng(1)
    n = np.minimum(2048, rng.lognormal(5, 1.2, 3000).astype(int) + 1)
    of = packing.fill(np.column_stack([n, n, np.ones_like(n)]), np.array([2048, 2048, 256]))
    assert of.max() + 1 <= 1.02 * n.sum() / 2048 + 1


@pytest.mark.parametrize("group_items", [7, 10_000])
def test_items_are_placed_once_and_whole(spark, group_items):
    rows = [(f"i{k}", (k * 37) % 130, (k * 37) % 130 // 2) for k in range(200)] + [("long", 450, 0), ("long", 450, 0), ("none", 0, 0), (None, 3, 3)]
    items = spark.createDataFrame(rows, "item string, n_tokens long, loss_tokens long")
    at = packing.pack_items(items, 128, 8, 100, group_items=group_items).collect()
    assert sum(r.n_tokens for r in at) == sum(n for _, n, _ in rows)
    assert [r.container for r in at if r.item == "none"] == [None]
    assert sorted((r.part, r.start_token, r.n_tokens) for r in at if r.item == "long") == sorted(2 * [(p, 128 * p, 128 if p < 3 else 66) for p in range(4)])
    bins = {}
    for r in at:
        if r.container:
            bins.setdefault(r.container, []).append(r)
    for rs in bins.values():
        assert sum(r.n_tokens for r in rs) <= 128 and sum(r.loss_tokens for r in rs) <= 100 and len(rs) <= 8
        at_ = sorted((r.offset, r.n_tokens) for r in rs)
        assert all(a + n <= b for (a, n), (b, _) in zip(at_, at_[1:]) if n) and at_[0][0] == 0


def test_loss_is_spread_over_parts(spark):
    items = spark.createDataFrame([("a", 300, 100), ("b", 300, 250), ("c", 90, 500)], "item string, n_tokens long, loss_tokens long")
    at = packing.pack_items(items, 128, 8, 120).collect()
    assert {(r.item, r.part): r.loss_tokens for r in at} == {("a", 0): 0, ("a", 1): 56, ("a", 2): 44, ("b", 0): 78, ("b", 1): 120, ("b", 2): 44, ("c", 0): 90}


def test_faults_are_seen(spark):
    rows = [("x", 1, 0, 0, 100, 0, 0), ("x", 2, 0, 0, 50, 0, 100), ("y", 3, 0, 0, 90, 0, 0), ("y", 4, 0, 0, 60, 0, 80), (None, 5, 0, 0, 0, 0, None), ("z", 6, 1, 10, 5, 0, 0)]
    packed = spark.createDataFrame(rows, "container string, doc_id long, part int, start_token long, n_tokens long, loss_tokens long, offset long")
    found = {r.doc_id: (r.wrong_parts, r.gaps) for r in packing.faults(packed, 160, 8, 100).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 0), 6: (0, 1)}


def test_documents_of_all_kinds(spark):
    d = spark.createDataFrame([(1, "some words here", "comment"), (2, "x y z " * 3000, "log"), (3, None, None), (4, "", "post"), (1, "some words here", "comment")], "doc_id long, text string, kind string")
    at = packing.pack_documents(d).collect()
    assert sorted({r.doc_id for r in at}) == [1, 2, 3, 4] and all(r.container is None for r in at if r.doc_id in (3, 4))
    assert all(r.loss_tokens == 0 for r in at if r.doc_id == 2)
    assert packing.pack_documents(d.limit(0)).isEmpty()


M = transducer()
TEXTS = [
    "First topic about cameras and lenses. " * 40 + "\n\n" + "Second topic on laptops, keyboards and hinges! " * 60, "w" * 9000, "中文没有空格，但有句号。" * 300, "a b c " * 2000, "\n" * 3000, "😀" * 1500,
    "line one\nline two is longer\n" * 200, "word " * 511 + "end.",
]


def check(text, limit, overlap):
    parts = [*segmentation.split_text(M, text, limit, overlap)]
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for k, (a, b, n, shared) in enumerate(parts):
        assert n == len(M.encode(text[a:b])) <= limit
        if k:
            la, lb = parts[k - 1][:2]
            assert la < a <= lb < b and shared == len(M.encode(text[a:lb])) <= overlap
    rebuilt = text[: parts[0][1]] + "".join(text[parts[k - 1][1] : parts[k][1]] for k in range(1, len(parts)))
    assert rebuilt == text
    return parts


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_cover_and_fit(text):
    check(text, 512, 64)
    check(text, 64, 8)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n中é😀!?", min_size=0, max_size=600), st.integers(32, 60), st.integers(0, 15))
def test_any_text_is_covered(text, limit, overlap):
    if text:
        check(text, limit, overlap)


def test_cut_at_the_topic_boundary():
    a, b = ("The lens is sharp and the camera focus is fast. " * 30).strip(), ("My bank card has no fee and pays cash back. " * 30).strip()
    parts = check(a + " " + b, 512, 64)
    assert parts[0][1] in (len(a), len(a) + 1)


def test_valleys():
    words = ["cat", "dog"] * 40 + ["car", "bus"] * 40
    depths = segmentation.valley_depths(words, [40, 60, 80, 100, 120])
    assert max(range(5), key=depths.__getitem__) == 2


def test_valleys_equal_plain_counts():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 30, 400)]
    at = [0, 3, 50, 51, 120, 260, 390, 400]

    def like(a, b):
        x, y = Counter(a), Counter(b)
        size = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
        return sum(n * y[w] for w, n in x.items()) / size**0.5 if size else 0.0

    sims = [like(words[max(0, p - 40) : p], words[p : p + 40]) for p in at]
    left, right = sims[:], sims[:]
    for i in range(1, len(at)):
        left[i] = max(sims[i - 1], left[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
    for i in range(len(at) - 2, -1, -1):
        right[i] = max(sims[i + 1], right[i + 1]) if sims[i + 1] >= sims[i] else sims[i]
    assert segmentation.valley_depths(words, at) == pytest.approx([a + b - 2 * s for a, b, s in zip(left, right, sims)])


def test_natural_end_in_the_first_half_is_found():
    text = "A short start. " * 10 + "word " * 900
    parts = check(text, 512, 64)
    assert text[: parts[0][1]].rstrip().endswith(".")


def test_rebuilt(spark):
    texts = [(1, "short"), (2, "One sentence here. " * 400), (3, None), (4, ""), (5, "x" * 9000)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(tuple(r) for r in segmentation.rebuilt(d, segmentation.split_documents(d)).collect()) == [t for t in texts if t[1] is not None]


def test_documents_and_bad_limits(spark):
    d = spark.createDataFrame([(1, "short", 1), (2, "One sentence here. " * 400, 1), (3, None, 1), (4, "", 1)], "doc_id long, text string, piece int")
    rows = segmentation.split_documents(d).orderBy("piece").collect()
    assert {r.doc_id for r in rows} == {2} and [r.piece for r in rows] == [*range(len(rows))] and rows[0].text.endswith(".")
    with pytest.raises(ValueError):
        segmentation.split_documents(d, 100, 60)
