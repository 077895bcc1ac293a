import json

import pytest
from pyspark.sql import functions as F

from skeinlab.functions import providers
from skeinlab.operators import keyvalues as KV
from skeinlab.operators import threads as T
from skeinlab.sources import readers as R
from skeinlab.sources import writers as W
from skeinlab.streaming import events as X

DISCUSSION = {
    "meta": {"run_id": "r1", "product_category": "cameras"},
    "posts": [{"post_id": 1, "author": "a", "content": "post text", "timestamp": "2025-01-01T10:05:00", "likes": 3, "comments": [
        {"comment_id": 1, "author": "b", "content": "first one here", "parent_comment_id": None, "depth": 0, "replies": [
            {"comment_id": 2, "author": "c", "content": "an answer to it", "replies": [{"comment_id": 3, "author": "b", "content": "and one more", "parent_comment_id": 2, "replies": []}]}]},
        {"comment_id": 4, "author": "d", "content": "flat one here", "replies": []}]}],
}


def test_nested_discussion_of_any_depth(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1/discussion.json").write_text(json.dumps(DISCUSSION))
    rows = R.read_discussions(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.comment_id, r.parent_comment_id, r.depth) for r in rows] == [(None, None, None), ("1", None, 0), ("2", "1", 1), ("3", "2", 2), ("4", None, 0)]
    deep = {"posts": [{"post_id": 1, "comments": []}]}
    at = deep["posts"][0]["comments"]
    for i in range(300):
        at.append({"comment_id": i, "replies": []})
        at = at[0]["replies"]
    assert [r[6] for r in R.flatten_discussion("p", deep)][-1] == 299
    assert R.read_discussions(spark, str(tmp_path / "nothing")).isEmpty()


def test_structure_of_the_example(spark):
    c = spark.createDataFrame([("t", str(r[4]), r[5], "two words") for r in R.flatten_discussion("p", DISCUSSION) if r[4]], "thread_id string, comment_id string, parent_id string, text string")
    r = T.thread_structure(c).first()
    assert (r.max_depth, r.avg_depth, r.avg_branching_factor, r.structural_virality) == (3, pytest.approx(1.75), 1.0, pytest.approx(4 / 3))


def test_reply_trees_nest_and_round_trip(spark):
    rows = [("t", str(r[4]), r[5], r[8], r[9]) for r in R.flatten_discussion("p", DISCUSSION) if r[4]] + [("t", "9", "77", "x", 'orphan "quoted" text')]
    c = spark.createDataFrame(rows, "thread_id string, comment_id string, parent_id string, author string, text string")
    tree = json.loads(T.nested_replies(c).first().tree)
    assert [x["comment_id"] for x in tree] == ["1", "4", "9"] and tree[0]["replies"][0]["replies"][0]["comment_id"] == "3"
    assert tree[2]["content"] == 'orphan "quoted" text'


PRODUCTS = [
    ({"meta": {"n": 1}, "products": [{"title": "Camera", "brand": "B", "price": {"currentPrice": 9.5}, "rating": 4, "page_description": "x" * 600, "feature_entries": [{"feature": "f1"}, {"feature": ""}, "f2"]}]}, ("Camera", "B", 9.5, 503, ["f1", "f2"])),
    ([{"title": "T", "price": 3, "brand": "Q"}], ("T", "Q", 3.0, 0, [])),
    ([{"card_name": "Gold", "official_product_url": "https://www.chase.com/x", "description": "d", "features": ["a", None, "b"]}], ("Gold", "Chase", None, 1, ["a", "b"])),
]


@pytest.mark.parametrize("data,want", PRODUCTS)
def test_products(spark, tmp_path, data, want):
    (tmp_path / "p.json").write_text(json.dumps(data))
    r = R.read_products(spark, str(tmp_path / "p.json")).first()
    assert (r.title, r.brand, r.price, len(r.description), list(r.features)) == want


def test_products_without_any_fail():
    with pytest.raises(ValueError):
        R.product_rows("p", {"foo": "bar", "baz": 42})


def test_jsonl_bundles_manifest_kinds(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"comment_id":"a","body":"x","depth":1}\n\n{"comment_id":"b","unknown":1}\n')
    assert [r.comment_id for r in R.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect()] == ["a", "b"]
    assert R.read_jsonl(spark, str(tmp_path / "none.jsonl")).isEmpty()
    (tmp_path / "b.json").write_text(json.dumps({"topic": "cam", "posts": [{"id": "p1", "title": "t", "num_comments": 2}]}))
    assert R.read_bundle_posts(spark, str(tmp_path / "b.json")).select("topic", "id", "num_comments").first() == ("cam", "p1", 2)
    (tmp_path / "m.json").write_text(json.dumps([{"discussion_bundle_status": "json_bundle", "files": {"json": "b.json", "comments_jsonl": "c.jsonl"}}, {"discussion_bundle_status": "failed", "files": {}}]))
    assert [tuple(r) for r in R.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("b.json", "c.jsonl")]
    (tmp_path / "d.json").write_text(json.dumps(DISCUSSION))
    assert [R.detect_kind(spark, str(tmp_path / f"{x}.json")) for x in "bmd"] == ["bundle", "manifest", "discussion"]


def test_metric_tables_and_submissions(spark, tmp_path):
    for model, domain in (("m1", "cameras"), ("_skip", "cameras")):
        (tmp_path / model / domain).mkdir(parents=True)
        (tmp_path / model / domain / "thread_scores.csv").write_text("thread_id,self_bleu_4\na,0.5\nb,\n__summary_mean__,0.5\n")
    assert {(r.model, r.domain, r.thread_id) for r in R.read_submissions(spark, str(tmp_path)).collect()} == {("m1", "cameras", x) for x in ("a", "b", "__summary_mean__")}
    assert [r.source for r in R.read_metric_csv(spark, str(tmp_path / "m1" / "cameras")).collect()] == ["cameras", "cameras"]
    (tmp_path / "r.json").write_text(json.dumps({"meta": {}, "overall": {}, "threads": [{"thread_id": "a", "max_depth": 3}]}))
    assert R.read_results(spark, str(tmp_path / "r.json"), "thread_id string, max_depth int").first() == ("a", 3)
    assert R.read_results(spark, str(tmp_path / "no.json"), "thread_id string").isEmpty()
    assert len(R.file_hashes(spark, str(tmp_path / "r.json")).first().sha256) == 64


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1.5)], "k string, v double")
    W.write_csv(df, str(tmp_path / "o"), order=["k"], one_file=True)
    assert next((tmp_path / "o").glob("*.csv")).read_text() == "k,v\na,1.5\nb,\n"
    doc = json.loads(W.result_document({"model": "x"}, df.limit(1), df).first().value)
    assert doc["meta"] == {"model": "x"} and len(doc["threads"]) == 2
    posts = spark.createDataFrame([("t", "ann", 1200, "Hello\nthere", "2025-01-01T09:05:00", 3)], "thread_id string, author string, author_karma int, content string, posted_at string, likes int")
    comments = posts.withColumn("ord", F.lit(1)).withColumn("depth", F.lit(1))
    lines = [r.line for r in W.markdown_lines(posts, comments).orderBy("ord").collect()]
    assert lines[0] == "## [3↑] Hello there\n**u/ann** (karma: 1,200) · 9:05 AM\n\nHello\nthere\n"
    assert lines[1] == ">> **u/ann** (karma: 1,200) · 9:05 AM [3↑]\n>>\n>> Hello\n>> there\n"
    assert W.splice("x<!-- b:begin -->old<!-- b:end -->y", ["new"], "b") == "x<!-- b:begin -->\nnew\n<!-- b:end -->y"
    with pytest.raises(ValueError):
        W.splice("none", [], "b")


def test_providers_keep_rows(spark):
    df = spark.createDataFrame([("a",), (None,), ("ccc",)], "text string")
    got = providers.with_scores(df, ["text"], lambda b, k: b.assign(n=[k * len(t or "") for t in b.text])[["n"]], "n int", load=lambda: 2, batch=2)
    assert [r.n for r in got.collect()] == [2, 0, 6]
    p = df.limit(1).select(providers.softmax_column(F.array(F.lit(0.0), F.lit(0.0))).alias("p"))
    assert list(p.first().p) == [0.5, 0.5]
    assert p.select(providers.argmax_label(F.col("p"), ["x", "y"])).first()[0] == "x"


def test_key_values(spark):
    old, new = (spark.createDataFrame(x, "k string, value string") for x in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert {tuple(r) for r in KV.changes(old, new, ["k"]).collect()} == {("b", "2", "3"), ("c", None, "4")}
    assert {tuple(r) for r in KV.merged(old, new, ["k"]).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    allowed = spark.createDataFrame([("a", True), ("z", True), ("c", False)], "k string, required boolean")
    assert {tuple(r) for r in KV.invalid(new, allowed, "k").collect()} == {("b", "unknown"), ("z", "missing")}
    assert old.limit(1).select(KV.append_once(F.lit("x"), F.lit("y")), KV.append_once(F.lit("xy"), F.lit("y"))).first() == ("x\n\ny", "xy")
    blocks = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, "a"), ("k", 4, " ")], "key string, position int, text string")
    assert KV.ordered_blocks(blocks, "key").first().text == "a\n\nb"
    log = spark.createDataFrame([(1, False, ["p", "q"], "s"), (2, True, ["r"], "s"), (3, None, None, "only")], "iteration int, won boolean, candidates array<string>, summary string")
    assert {tuple(r) for r in KV.candidates_of_losers(log).collect()} == {(1, "p"), (1, "q"), (3, "only")}


def test_upsert_keeps_latest_and_repeats_safely(spark, tmp_path):
    put = X.upsert(str(tmp_path / "t"), ["k"], "at")
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "only")], "k string, at int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("y", 4, "late")], "k string, at int, v string")
    put(a, 0)
    put(b, 1)
    put(b, 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {("x", 2, "new"), ("y", 5, "only")}


def test_empty_threads(spark):
    c = spark.createDataFrame([], "thread_id string, comment_id string, parent_id string, text string, author string")
    assert T.thread_structure(c).isEmpty() and T.nested_replies(c).isEmpty()
