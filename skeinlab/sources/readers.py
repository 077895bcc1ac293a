"""Readers of discussions, bundles, products, metric tables and submissions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlab.functions.text import brand_of_url, json_or_content

DISCUSSION = (
    "path string, run_id string, product_category string, post_id string, comment_id string, parent_comment_id string, depth int, ord long, author string, content string, "
    "posted_at string, likes long, dislikes long"
)
COMMENT = (
    "post_id string, post_fullname string, post_permalink string, post_title string, comment_id string, comment_fullname string, parent_id string, depth int, author string, body string, "
    "score int, created_utc long, created_iso string, permalink string, distinguished string, stickied boolean, is_submitter boolean"
)
POST = (
    "id string, fullname string, query string, strategy string, subreddit string, title string, author string, permalink string, url string, created_utc long, created_iso string, score int, "
    "upvote_ratio double, num_comments int, over_18 boolean, spoiler boolean, stickied boolean, is_self boolean, post_hint string, domain string, selftext string, link_flair_text string, search_rank int, is_relevant boolean"
)
PRODUCT = "path string, title string, brand string, url string, price double, description string, rating double, review_count long, features array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def _text(x) -> str | None:
    return None if x is None else str(x)


def _int(x) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def flatten_discussion(path: str, data: dict) -> list[tuple]:
    """Rows of one nested discussion, posts and comments in reading order. A comment's parent is its own
    parent_comment_id, or the comment it is nested in where it has none."""
    meta = data.get("meta") or {}
    rows: list[tuple] = []
    for post in data.get("posts") or []:
        head = (path, _text(meta.get("run_id")), _text(meta.get("product_category")), _text(post.get("post_id")))
        what = lambda x: (x.get("author"), x.get("content"), _text(x.get("timestamp")), _int(x.get("likes")), _int(x.get("dislikes")))
        rows.append((*head, None, None, None, len(rows), *what(post)))
        stack = [(c, None, 0) for c in reversed(post.get("comments") or [])]
        while stack:
            c, above, level = stack.pop()
            own = _text(c.get("comment_id"))
            parent = _text(c.get("parent_comment_id")) if c.get("parent_comment_id") is not None else above
            depth = _int(c.get("depth"))
            rows.append((*head, own, parent, level if depth is None else depth, len(rows), *what(c)))
            stack.extend((r, own, level + 1) for r in reversed(c.get("replies") or []))
    return rows


def read_discussions(spark: SparkSession, path: str) -> DataFrame:
    """Discussion files below path (or path itself), one nested JSON each, as flat rows. Files that are no JSON object
    are an error; an empty folder gives no rows."""
    names = [f.split(" ")[0] for f in DISCUSSION.split(", ")]

    def flatten(batches):
        for b in batches:
            rows = [r for p, t in zip(b.path, b.value) for r in flatten_discussion(p, json.loads(t))]
            yield pd.DataFrame(rows, columns=names)

    files = path if path.endswith(".json") else f"{path}/*/discussion.json"
    if not _exists(spark, files):
        return spark.createDataFrame([], DISCUSSION)
    text = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.mapInPandas(flatten, DISCUSSION)


def read_jsonl(spark: SparkSession, path: str, schema: str = COMMENT) -> DataFrame:
    """JSON lines; blank lines are skipped, and a missing path gives no rows."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_bundle_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts inside bundle files {topic, posts: [...]}, with topic."""
    schema = f"topic string, posts array<struct<{', '.join(f.replace(' ', ': ', 1) for f in POST.split(', '))}>>"
    if not _exists(spark, path):
        return spark.createDataFrame([], f"topic string, {POST}")
    return spark.read.schema(schema).option("multiLine", True).json(path).select("topic", F.explode("posts").alias("p")).select("topic", "p.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """json and comments_jsonl paths of the manifest's usable entries."""
    schema = "discussion_bundle_status string, files struct<json: string, comments_jsonl: string>"
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    return m.where("discussion_bundle_status = 'json_bundle' and files.json is not null").select("files.json", "files.comments_jsonl")


def detect_kind(spark: SparkSession, path: str) -> str:
    """discussion, bundle, manifest or products, by the top-level keys of one file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(text)
    first = data[0] if isinstance(data, list) and data else data
    if isinstance(first, dict) and "discussion_bundle_status" in first:
        return "manifest"
    if isinstance(data, dict) and "posts" in data:
        return "bundle" if "topic" in data or "strategies" in data else "discussion"
    if isinstance(data, list) or any(isinstance(v, list) and v and isinstance(v[0], dict) for v in data.values()):
        return "products"
    raise ValueError(f"no known layout in {path}")


def product_rows(path: str, data) -> list[tuple]:
    """Rows of one product file: a list, an object with products, or the first list of objects in it."""
    if isinstance(data, dict):
        lists = [data.get("products"), *data.values()]
        data = next((x for x in lists if isinstance(x, list) and x and isinstance(x[0], dict)), None)
    if not isinstance(data, list):
        raise ValueError(f"no products in {path}")
    rows = []
    for raw in data:
        price = raw.get("price")
        if isinstance(price, dict):
            price = price["currentPrice"] if price.get("currentPrice") is not None else price.get("regularPrice")
        about = raw.get("page_description") or raw.get("full_description") or raw.get("description") or ""
        about = about[:500] + "..." if len(about) > 500 else about
        entries = [e.get("feature") if isinstance(e, dict) else e for e in raw.get("feature_entries") or []]
        features = [str(e) for e in entries if e] or [str(e) for e in (raw["features"] if isinstance(raw.get("features"), list) else []) if e]
        number = float(price) if isinstance(price, (int, float)) and not isinstance(price, bool) else None
        title = raw.get("title") or raw.get("card_name") or raw.get("product_name") or raw.get("name") or "Unknown Product"
        rating = raw.get("rating")
        rows.append((path, title, raw.get("brand") or None, raw.get("final_url") or raw.get("official_product_url"), number, about, None if rating is None else float(rating), _int(raw.get("review_count")), features[:6]))
    return rows


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Normalised products: title, brand (by the address's host where there is none), price, description, rating,
    review_count, features. A file without products is an error."""
    names = [f.split(" ")[0] for f in PRODUCT.split(", ")]

    def parse(batches):
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.value) for r in product_rows(p, json.loads(t))], columns=names)

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(parse, PRODUCT)
    return rows.withColumn("brand", F.coalesce("brand", brand_of_url("url"))).drop("url")


def read_metric_csv(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Metric tables as strings with their file's folder as source; summary rows are left out."""
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.csv").csv(path, header=True)
    df = df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return df.where(~F.coalesce(F.col("thread_id"), F.lit("")).startswith("__summary") & ~F.coalesce(F.col("thread_id"), F.lit("")).startswith("__aggregate"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """thread_scores.csv of every model and domain below path, with model and domain from the folders; folders whose
    names start with _ or . are left out."""
    df = spark.read.csv(f"{path}/[!_.]*/*/thread_scores.csv", header=True)
    at = F.col("_metadata.file_path")
    return df.withColumn("model", F.regexp_extract(at, r"([^/]+)/[^/]+/[^/]+$", 1)).withColumn("domain", F.regexp_extract(at, r"([^/]+)/[^/]+$", 1))


def read_results(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Threads of scorer results {meta, overall, threads: [...]}; none if the path is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], fields)
    schema = f"threads array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(', '))}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("threads").alias("t")).select("t.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [s.getPath().toString() for s in found or []]


def pick_file(spark: SparkSession, folder: str, pattern: str, without: tuple[str, ...] = ()) -> str:
    """The one file of a folder that fits a pattern and has none of the suffixes: the shortest name, then the first by
    name. None is an error."""
    found = [f for f in _listed(spark, f"{folder}/{pattern}") if not f.endswith(without)] if without else _listed(spark, f"{folder}/{pattern}")
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return min(found, key=lambda f: (len(f.rsplit("/", 1)[-1]), f))


def read_bundle(spark: SparkSession, bundles: list[str], comments: list[str]) -> DataFrame:
    """Posts of bundle files with the comments of comment files: one row per comment, and one for a post without any,
    whose comment columns are null. Missing comment files give no comments."""
    posts = spark.createDataFrame([], f"topic string, {POST}")
    for b in bundles:
        posts = posts.unionByName(read_bundle_posts(spark, b))
    there = [c for c in comments if c and _exists(spark, c)]
    c = spark.read.schema(COMMENT).json(there) if there else spark.createDataFrame([], COMMENT)
    p = posts.select("topic", F.col("id").alias("post_id"), "subreddit", "title", "selftext", F.col("score").alias("post_score"), "search_rank", "is_relevant", "num_comments")
    return p.join(c.select("post_id", "comment_id", "parent_id", "depth", "author", "body", "score", "created_iso"), "post_id", "left")


def read_threads(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """thread_id, title, comment_id, parent_id, author, content of whatever is at path: a generated discussion or a folder
    of them, a bundle with its comment file beside it, or a manifest naming such pairs (relative to folder)."""
    kind = detect_kind(spark, path) if path.endswith(".json") else "discussion"
    if kind == "discussion":
        d = read_discussions(spark, path)
        return d.select(F.concat_ws("/", "run_id", "post_id").alias("thread_id"), F.lit(None).cast("string").alias("title"), "comment_id", F.col("parent_comment_id").alias("parent_id"), "author", "content")
    if kind == "manifest":
        at = lambda p: p if not p or p.startswith("/") or "://" in p else f"{folder.rstrip('/')}/{p}"
        pairs = [(at(r[0]), at(r[1])) for r in read_manifest(spark, path).collect()]  # a manifest names files
    elif kind == "bundle":
        pairs = [(path, path[: -len(".json")] + ".comments.jsonl")]
    else:
        raise ValueError(f"{path} holds no threads")
    b = read_bundle(spark, [p for p, _ in pairs], [c for _, c in pairs])
    return b.select(F.col("post_id").alias("thread_id"), "title", "comment_id", "parent_id", "author", F.coalesce("body", "selftext").alias("content"))


def read_category(spark: SparkSession, path: str, per_product: int, seed: int = 0) -> DataFrame:
    """Generated posts of a category folder <product>/**/discussion.json, at most per_product threads of each product, by a
    hash of seed and file."""
    files = _listed(spark, f"{path}/*/*/discussion.json") + _listed(spark, f"{path}/*/discussion.json")
    parts = [read_discussions(spark, f) for f in files]
    if not parts:
        return spark.createDataFrame([], DISCUSSION + ", product string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("product", F.regexp_extract("path", f"{path.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/", 1))
    heads = rows.where("comment_id is null").withColumn("place", F.row_number().over(Window.partitionBy("product").orderBy(F.xxhash64("path", "post_id", F.lit(seed)), "path", "post_id")))
    return rows.join(heads.where(F.col("place") <= per_product).select("path", "post_id"), ["path", "post_id"])


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of a store exported as Parquet tables: from the tables post and comment, or, where either is
    missing, from the actions in trace, whose info is a JSON object or plain text. Columns that the store lacks are null."""
    post = "post_id long, user_id long, content string, created_at string, num_likes long, num_dislikes long"
    comment = "comment_id long, " + post + ", parent_comment_id long, depth int"

    def fitted(df: DataFrame, schema: str) -> DataFrame:
        cols = [c.split(" ") for c in schema.split(", ")]
        return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in cols])

    if _exists(spark, f"{path}/post.parquet") and _exists(spark, f"{path}/comment.parquet"):
        return fitted(spark.read.parquet(f"{path}/post.parquet"), post), fitted(spark.read.parquet(f"{path}/comment.parquet"), comment)
    trace = spark.read.parquet(f"{path}/trace.parquet")

    def actions(name: str, schema: str, text: tuple[str, str]) -> DataFrame:
        rows = trace.where(F.lower("action") == name).withColumn("j", json_or_content(F.col("info")))
        get = lambda k: F.get_json_object("j", f"$.{k}")
        out = rows.select("user_id", "created_at", F.coalesce(get(text[0]), get(text[1]), F.col("j")).alias("content"), *[get(k).alias(k) for k in ("post_id", "comment_id", "num_likes", "num_dislikes", "parent_comment_id", "depth")])
        return fitted(out, schema)

    return actions("create_post", post, ("content", "post_content")), actions("create_comment", comment, ("content", "comment"))


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """user_id, username, karma of a profiles file, a JSON list."""
    return spark.read.schema("user_id long, username string, karma long").option("multiLine", True).json(path)


def read_json_object(spark: SparkSession, path: str) -> dict:
    """The object of a small JSON file (seed, baseline, overlay, checkpoint); empty if the file is missing."""
    if not _exists(spark, path):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def baseline_name(config: dict, runs: list[dict], folder: str, aliases: dict[str, str], default_model: str) -> tuple[str, str]:
    """Model and domain of a baseline folder: from its config, else the model of the first run that has one and the
    folder's name."""
    model = config.get("llm_model") or next((r["llm_model"] for r in runs if r.get("llm_model")), default_model)
    raw = config.get("category_name", "") if config else folder.rstrip("/").rsplit("/", 1)[-1]
    return model, aliases.get(raw, raw)


def read_baselines(spark: SparkSession, path: str, aliases: dict[str, str], default_model: str) -> DataFrame:
    """folder, model, domain of every baseline folder below path, those with a baseline_config.json or a run's
    run_config.json."""
    folders = sorted({f.rsplit("/", 1)[0] for f in _listed(spark, f"{path}/*/baseline_config.json")} | {f.rsplit("/", 2)[0] for f in _listed(spark, f"{path}/*/*/run_config.json")})
    rows = []
    for f in folders:
        runs = [read_json_object(spark, r) for r in sorted(_listed(spark, f"{f}/*/run_config.json"))]
        rows.append((f, *baseline_name(read_json_object(spark, f"{f}/baseline_config.json"), runs, f, aliases, default_model)))
    return spark.createDataFrame(rows, "folder string, model string, domain string")


def merged_results(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Threads of the scorer results <thread>/<metric>.json below path, with the folder's name as thread_id whatever the
    file says."""
    schema = f"threads array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(', '))}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{path}/*/*.json")
    at = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.select(at.alias("_at"), F.explode("threads").alias("t")).select("_at", "t.*").withColumn("thread_id", F.col("_at")).drop("_at")
