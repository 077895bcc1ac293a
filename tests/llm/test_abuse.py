import os

import numpy as np
import pandas as pd
import pytest

from skeinlab.llm import abuse as A
from tests.helpers import comments

LABELS = "/root/testdata/sf0.001/abuse_labels.parquet"


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in A._fresh(rng).items()}
    p["word"], p["char"] = rng.normal(0, 1, (5, A.WIDTH)), rng.normal(0, 1, (6, A.WIDTH))
    word = np.array([[0, 1], [2, 3], [4, 0]])
    chars, of = np.array([0, 1, 2, 3, 4, 5, 1]), np.array([0, 0, 1, 2, 3, 4, 4])
    n = np.array([2.0, 1, 1, 1, 2, 1])
    mask = np.array([[1.0, 1], [1, 1], [1, 0]])
    y, w = np.array([1.0, 0.0]), np.ones(2)
    loss = lambda: A._gradients(p, word, chars, of, n, mask, y, w)[0].sum() / 2
    _, g = A._gradients(p, word, chars, of, n, mask, y, w)
    for k in p:
        for _ in range(3):
            i = tuple(rng.integers(s) for s in p[k].shape)
            keep, e = p[k][i], 1e-4
            p[k][i] = keep + e
            up = loss()
            p[k][i] = keep - e
            down = loss()
            p[k][i] = keep
            assert g[k][i] == pytest.approx((up - down) / (2 * e), abs=2e-4), k


def test_windows_cover_every_token():
    for n in (0, 1, 24, 25, 40, 41, 1000):
        w = A.windows(n)
        assert {i for a, b in w for i in range(a, b)} == set(range(n)) and all(b - a <= A.WINDOW for a, b in w)


def test_tokens_undo_disguise():
    assert A.skeleton(A.tokens("ІMBЕСІLЕ")[0]) == A.skeleton("imbecile") == A.skeleton(A.tokens("1mb3c1l3")[0]) == A.skeleton("imm​becile".replace("​", ""))
    assert A.tokens("f*ck  you!!") == ["f*ck", "you", "!!"] and A.tokens(None) == []


def test_same_score_in_any_batch():
    m = A.Committee([A._fresh(np.random.default_rng(i)) for i in range(2)])
    texts = ["a b c", "one two three four " * 30, "", None, "x", "a b c"]
    whole = m.score(texts)
    assert whole == pytest.approx(np.concatenate([m.score([t]) for t in texts]), abs=1e-5) and whole[2] == whole[3] == 0 and len(whole) == 6
    alone = [A.Committee([p]).score(["one two three"])[0] for p in m.members]
    assert m.score(["one two three"])[0] == pytest.approx(np.mean(alone), abs=1e-5)


def test_scores_equal_a_plain_network():
    p = A._fresh(np.random.default_rng(5))
    words = A.tokens("one strange little text of some words")
    x = [np.concatenate([p["word"][A.features(w)[0]], p["char"][A.features(w)[1]].mean(axis=0)]) for w in words]
    h, states = A.HIDDEN, []
    for d in "fb":
        state, trace = np.zeros(h), []
        for v in x if d == "f" else x[::-1]:
            g, u = v @ p[d + "x"] + p[d + "b"], state @ p[d + "u"]
            r, z = A._sigmoid(g[:h] + u[:h]), A._sigmoid(g[h : 2 * h] + u[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            trace.append(state)
        states.append(trace if d == "f" else trace[::-1])
    s = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
    e = np.tanh(s @ p["aw"]) @ p["av"]
    att = np.exp(e) / np.exp(e).sum()
    want = A._sigmoid(np.tanh((att @ s) @ p["ow"] + p["ob"]) @ p["ov"] + p["oc"][0])
    assert A.Committee([p]).score([" ".join(words)])[0] == pytest.approx(want, abs=1e-5)


def test_rare_words_are_no_background():
    common = [["the", "lens", "is", "good", "and", "light"] * 4 for _ in range(400)]
    runs = A.ordinary([*common, ["the", "lens", "is"] + ["strange"] + ["good", "and"]])
    assert len(runs) == 400 and all("strange" not in r for r in runs)


@pytest.mark.skipif(not os.path.exists(LABELS), reason="test data not there")
def test_held_out_accuracy():
    r = pd.read_parquet(LABELS)
    x, y = r.body.tolist(), r.is_abusive.tolist()
    rest, test = [i for i in range(len(x)) if i % 4], [i for i in range(len(x)) if i % 4 == 0]
    m = A.train([x[i] for i in rest], [y[i] for i in rest], [x[i] for i in rest if not y[i]], members=1, epochs=9)
    right = np.mean([(s >= A.THRESHOLD) == y[i] for s, i in zip(m.score([x[i] for i in test]), test)])
    assert right >= 0.9


def test_tables_nulls_and_ids(spark, monkeypatch):
    monkeypatch.setattr(A, "MEMBERS", 1)
    monkeypatch.setattr(A, "EPOCHS", 4)
    texts = ["you are a fool", "nice camera", None, ""] * 6
    labels = spark.createDataFrame([(i, t, int(t == "you are a fool")) for i, t in enumerate(texts)] + [(99, "x", None)], "sample_id long, body string, is_abusive int")
    c = comments(spark, [{"comment_id": "A", "body": "you are a fool", "subreddit": "s"}, {"comment_id": " t1_a", "body": "nice camera", "subreddit": "s"}, {"comment_id": "b", "body": None}, {"comment_id": "d", "body": "nice camera " * 400, "subreddit": None}])
    g = spark.createDataFrame([("r", "m", 1, None, "you are a fool"), ("r", "m", 1, 2, ""), ("r", "m", 1, 2, "you are a fool"), ("r", None, 1, 3, None)], "run_id string, model string, post_id int, comment_id int, content string")
    both = A.all_texts(c, g)
    model = A.model_of(labels, both)
    s = A.score_texts(both, model)
    assert s.count() == 8
    assert {tuple(r) for r in A.abusive_records(s).collect()} == {("comments", "a"), ("example_thread_format", "r/1"), ("example_thread_format", "r/1/2")}
    rates = {(r.table_name, r.source): (r.n_records, r.n_abusive) for r in A.abuse_rates(s).collect()}
    assert rates["comments", "s"] == (1, 1) and rates["example_thread_format", "m"] == (2, 2)
    again = A.model_of(labels, both)  # kept, not fitted anew
    assert all((model.members[0][k] == again.members[0][k]).all() for k in model.members[0])
    empty = A.all_texts(c.limit(0), g.limit(0))
    assert A.abusive_records(A.score_texts(empty, A.model_of(labels.limit(0), empty))).isEmpty()
