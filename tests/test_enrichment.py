import json

import pytest
from pyspark.sql import functions as F

from skeinlab.functions import text as X
from skeinlab.operators import diagnosis as D
from skeinlab.operators import enrichment as E
from skeinlab.operators import labels as L
from skeinlab.operators import threads as T
from skeinlab.sources import readers as R
from skeinlab.sources import writers as W
from tests.helpers import comments

TEXT = "some words that are enough"


def test_ids_written_differently_are_one(spark):
    c = T.crawled_comments(comments(spark, [
        {"post_id": "T3_P", "comment_id": " A", "parent_id": "t3_p", "body": TEXT, "post_title": "a title with words", "author": "x"},
        {"post_id": " p ", "comment_id": "b", "parent_id": "a", "body": TEXT, "author": "y"}, {"post_id": "t3_p", "comment_id": "c", "parent_id": "P", "body": TEXT, "post_title": "a title with words"},
        {"post_id": "p", "comment_id": "d", "parent_id": "t1_zz", "body": TEXT}, {"post_id": None, "comment_id": "e", "parent_id": None, "body": TEXT},
    ]))
    assert {(r.comment_id, r.thread_id) for r in c.collect()} == {("a", "p"), ("b", "p"), ("c", "p"), ("d", "p"), ("e", None)}
    assert {(r.comment_id, r.parent_kind) for r in T.reply_pairs(c).collect()} == {("a", "post"), ("b", "comment"), ("c", "post")}
    posts = spark.createDataFrame([("P", "found", None)], "post_id string, title string, retrieved_at timestamp")
    raw = comments(spark, [{"post_id": "t3_P ", "comment_id": "a"}])
    assert [r.title for r in T.comments_with_titles(raw, posts).collect()] == ["found"]


def test_scores_profiles_and_posts(spark):
    c = spark.createDataFrame([("t", "1"), ("t", "2"), ("u", "1")], "thread_id string, comment_id string")
    s = spark.createDataFrame([("t", "1", 1, 0.5), ("t", "1", 2, 0.7), ("u", "1", 1, None)], "thread_id string, comment_id string, at int, score double")
    assert {tuple(r) for r in E.attach_scores(c, s, "at").collect()} == {("t", "1", 0.7), ("u", "1", None)}
    people = spark.createDataFrame([(1, "ann", 5), (1, "ann", 5), (3, None, None)], "user_id long, username string, karma long")
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id long")
    assert {tuple(r) for r in E.with_profiles(rows, people).collect()} == {(1, "ann", 5), (2, "user_2", 0), (3, "user_3", 0), (None, None, 0)}
    posts = spark.createDataFrame([("p", 1), ("q", 2)], "id string, ordinal long")
    cs = spark.createDataFrame([("a", "p"), ("b", "zz"), ("c", None)], "comment_id string, source_post string")
    assert {tuple(r) for r in E.attach_to_posts(cs, posts).collect()} == {("a", "p", 1, False), ("b", "zz", 2, True), ("c", None, 2, True)}
    assert E.attach_to_posts(cs, posts.limit(0)).isEmpty()


def test_products_and_posts_shown(spark):
    p = spark.createDataFrame([(1, "Big  Camera"), (2, None)], "product_id long, title string")
    o = spark.createDataFrame([("x", " big camera "), ("y", "other"), ("z", None)], "who string, product_title string")
    assert [tuple(r) for r in E.opinions_on_products(o, p).collect()] == [("x", 1, "Big  Camera")]
    pool = spark.createDataFrame([(i, 100 + i) for i in range(3)], "position int, product_id long")
    who = spark.createDataFrame([(0,), (2,)], "profile int")
    assert {tuple(r) for r in E.rotated_products(who, pool, 2).collect()} == {(0, 0, 100), (0, 1, 101), (2, 0, 102), (2, 1, 100)}
    assert E.rotated_products(who, pool.limit(0), 2).isEmpty()
    posts = spark.createDataFrame([(1, "a", "root", None, None), (2, "b", "", 1, None), (3, "c", None, 1, "so true"), (4, "d", "own", 99, None)], "post_id long, author string, content string, original_post_id long, quote string")
    assert {(r.post_id, r.shown, r.from_author) for r in E.resolved_posts(posts).collect()} == {(1, "root", None), (2, "root", "a"), (3, "so true\nroot", "a"), (4, "own", None)}
    done = spark.createDataFrame([(1, True, "x"), (2, False, "x"), (3, True, None)], "candidate_id int, success boolean, place string")
    assert [tuple(r) for r in E.with_previews(done, spark.createDataFrame([(1, "p")], "candidate_id int, preview string")).collect()] == [(1, True, "x", "p")]


@pytest.mark.parametrize("raw, want", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": {"b": [1,2,]},}\n```', {"a": {"b": [1, 2]}}), ('Here you go: {"a": 1} bye', {"a": 1}), ("nothing", None), ("", None), (None, None), ("[1]", None),
])
def test_json_in_text(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(X.json_object(F.col("raw"))).first()[0]
    assert (json.loads(got) if got else None) == want


def test_numbers_and_lines(spark):
    df = spark.createDataFrame([("3", 1.23456), ("x", None), (None, float("nan")), ("99", -2.0)], "s string, x double")
    assert [r[0] for r in df.select(X.bounded(F.col("s"), 0, 10, 5)).collect()] == [3, 5, 5, 10]
    assert [r[0] for r in df.select(X.shown(F.col("x"), 2)).collect()] == ["1.23", "n/a", "n/a", "-2.00"]
    assert spark.range(1).select(X.without_blank_runs(F.lit("a  \n\n\n\nb\n"))).first()[0] == "a\n\nb"


def test_pair_scores_of_small_and_large_threads(spark):
    many = [("big", i / 1000, 0.5, i / 1000) for i in range(1001)]
    p = spark.createDataFrame(many + [("one", 0.2, 0.4, 0.3)], "thread_id string, precision double, recall double, f1 double")
    c = spark.createDataFrame([("big",), ("one",), ("none",)], "thread_id string")
    got = {r.thread_id: r for r in L.pair_scores(p, c, 2).collect()}
    assert got["big"].median_f1 == pytest.approx(0.5) and got["big"].p90_f1 == pytest.approx(0.9) and got["big"].top_k_mean_f1 == pytest.approx(0.9995)
    assert (got["one"].pair_count, got["one"].top_k_mean_f1, got["one"].min_f1) == (1, 0.3, 0.3) and (got["none"].pair_count, got["none"].mean_f1) == (0, 0.0)


def test_choices(spark):
    s = spark.createDataFrame([("d", m, g, f, 0.0, 0.0) for m, g, f in (("a", "g1", 0.9), ("a", "g2", 0.1), ("b", "g1", 0.5), ("b", "g2", 0.5))], "domain string, model string, metric_group string, quantile_fail_rate double, mean_percentile_distance double, mean_abs_robust_z double")
    best = spark.createDataFrame([("d", "a")], "domain string, model string")
    front = s.where("(model = 'b' and metric_group = 'g1') or (model = 'a' and metric_group = 'g2')")
    for misses, want in ((2, ("d", "a", "global_best", None)), (3, ("d", "b", "challenger_root", "g1"))):
        stuck = spark.createDataFrame([("d", misses)], "domain string, misses int")
        assert [tuple(r) for r in D.search_roots(s, best, front, stuck).collect()] == [want]
    assert {(r.model, r.metric_group): r.place for r in D.worst_groups(s).collect()} == {("a", "g1"): 1, ("a", "g2"): 2, ("b", "g1"): 1, ("b", "g2"): 2}
    assert {r.model: r.families for r in D.family_order(s, ["g3", "g2"]).collect()} == {"a": ["g1", "g2", "g3"], "b": ["g1", "g2", "g3"]}
    log = spark.createDataFrame([("f", 1, "x", False, 0.5, None, 0.1), ("f", 2, "y", True, 0.5, 0.3, 0.1), ("g", 1, "z", False, None, None, None)], "family string, iteration int, candidate string, won boolean, quantile_fail_rate double, mean_percentile_distance double, mean_abs_robust_z double")
    assert {r.family: (r.attempts, r.wins, r.best_candidate) for r in D.family_learning(log).collect()} == {"f": (2, 1, "y"), "g": (1, 0, "z")}
    batches = spark.createDataFrame([("k", i, 10) for i in range(5)], "key string, at int, n int")
    assert [r.at for r in D.until_enough(batches, "key", "at", "n", 25).orderBy("at").collect()] == [0, 1, 2]


def test_sources(spark, tmp_path):
    for n in ("b.comments.jsonl", "bb.json", "aa.json", "a.skip.json"):
        (tmp_path / n).write_text("{}")
    assert R.pick_file(spark, str(tmp_path), "*.json", (".skip.json",)).endswith("/aa.json")
    with pytest.raises(FileNotFoundError):
        R.pick_file(spark, str(tmp_path), "*.csv")
    box = tmp_path / "box"
    box.mkdir()
    (box / "x.json").write_text(json.dumps({"topic": "t", "posts": [{"id": "p", "title": "one", "selftext": "body"}, {"id": "q", "title": "two"}]}))
    (box / "x.comments.jsonl").write_text('{"post_id": "p", "comment_id": "c", "body": "hi"}\n\n')
    (box / "m.json").write_text(json.dumps([{"discussion_bundle_status": "json_bundle", "files": {"json": "x.json", "comments_jsonl": "gone.jsonl"}}]))
    assert {(r.thread_id, r.comment_id, r.content) for r in R.read_threads(spark, str(box / "x.json")).collect()} == {("p", "c", "hi"), ("q", None, None)}
    assert {(r.thread_id, r.comment_id, r.content) for r in R.read_threads(spark, str(box / "m.json"), str(box)).collect()} == {("p", None, "body"), ("q", None, None)}
    store = tmp_path / "store"
    trace = [(1, "CREATE_POST", '{"content": "hello", "post_id": 7}', "t1"), (2, "create_comment", "plain words", "t2"), (2, "like", None, "t3"), (3, "create_comment", None, "t4")]
    spark.createDataFrame(trace, "user_id long, action string, info string, created_at string").write.parquet(str(store / "trace.parquet"))
    posts, found = R.read_store(spark, str(store))
    assert [(r.post_id, r.content) for r in posts.collect()] == [(7, "hello")] and {r.content for r in found.collect()} == {"plain words", "{}"}
    spark.createDataFrame([(1, 1, "x")], "post_id long, user_id long, content string").write.parquet(str(store / "post.parquet"))
    spark.createDataFrame([(1, 1, "y")], "comment_id long, post_id long, content string").write.parquet(str(store / "comment.parquet"))
    posts, found = R.read_store(spark, str(store))
    assert posts.first().num_likes is None and found.first().content == "y" and R.has_columns(found, "depth", "post_id")
    W.write_object(spark, {"a": [1]}, str(tmp_path / "o" / "overlay.json"))
    assert R.read_json_object(spark, str(tmp_path / "o" / "overlay.json")) == {"a": [1]} and R.read_json_object(spark, str(tmp_path / "none.json")) == {}
    for folder, config in (("one", {"llm_model": "m", "category_name": "raw"}), ("two", None)):
        (tmp_path / "base" / folder / "run").mkdir(parents=True)
        (tmp_path / "base" / folder / "run" / "run_config.json").write_text(json.dumps({"llm_model": "of run"}))
        if config:
            (tmp_path / "base" / folder / "baseline_config.json").write_text(json.dumps(config))
    assert {(r.model, r.domain) for r in R.read_baselines(spark, str(tmp_path / "base"), {"raw": "nice"}, "none").collect()} == {("m", "nice"), ("of run", "two")}
    (tmp_path / "scores" / "th1").mkdir(parents=True)
    (tmp_path / "scores" / "th1" / "s.json").write_text(json.dumps({"threads": [{"thread_id": "wrong", "x": 1.5}]}))
    assert [tuple(r) for r in R.merged_results(spark, str(tmp_path / "scores"), "thread_id string, x double").select("thread_id", "x").collect()] == [("th1", 1.5)]
    (tmp_path / "people.json").write_text('[{"user_id": 1, "username": "ann", "karma": 3}]')
    assert tuple(R.read_profiles(spark, str(tmp_path / "people.json")).first()) == (1, "ann", 3)


def test_scratch_is_freed(spark, monkeypatch):
    import os

    from skeinlab import runtime

    monkeypatch.setattr(runtime.Scratch, "made", [])
    scratch = runtime.Scratch(spark, "freed")
    scratch.cut(spark.range(3))
    at = scratch.root.removeprefix("file://")
    assert os.path.isdir(at)
    runtime.free_scratch(spark)
    assert not os.path.isdir(at) and runtime.Scratch.made == []
