"""Small tables with the columns of the test data."""

from datetime import datetime, timedelta

BEGIN = datetime(2025, 1, 1)
COMMENTS = (
    "post_id string, post_fullname string, post_permalink string, post_title string, comment_id string, comment_fullname string, parent_id string, depth int, author string, body string, score int, "
    "created_utc long, created_iso string, permalink string, distinguished string, stickied boolean, is_submitter boolean, subreddit string, retrieved_at timestamp_ntz"
)


def comments(spark, rows, extra=""):
    """rows: dicts with any of the columns; hour is the retrieval time."""
    names = [c.split(" ")[0] for c in COMMENTS.split(", ")]
    full = []
    for r in rows:
        r = dict(r)
        r["retrieved_at"] = BEGIN + timedelta(hours=r.pop("hour", 0)) if r.get("hour", 0) is not None else None
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, COMMENTS)


def posts(spark, rows):
    return spark.createDataFrame([(p, BEGIN + timedelta(hours=h), p) for p, h in rows], "post_id string, retrieved_at timestamp_ntz, id string")


def removals(spark, names):
    return spark.createDataFrame([(n, 0, None) for n in names], "fullname string, removed_utc long, reason string")
