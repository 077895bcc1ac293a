"""Sinks: CSV, JSON, Markdown and board pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header and empty nulls; one_file is for tables of known small size."""
    out = df.select(*columns) if columns else df
    out = out.orderBy(*order) if order else out
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def result_document(meta: dict[str, str], overall: DataFrame, threads: DataFrame) -> DataFrame:
    """One row, value: the scorer result {meta, overall, threads} as JSON; for per-run results of bounded size."""
    t = threads.agg(F.to_json(F.collect_list(F.struct(*threads.columns))).alias("t"))
    o = overall.agg(F.to_json(F.collect_list(F.struct(*overall.columns))).alias("o"))
    m = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()])) if meta else F.lit("{}")
    return t.crossJoin(o).select(F.concat(F.lit('{"meta":'), m, F.lit(',"overall":'), "o", F.lit(',"threads":'), "t", F.lit("}")).alias("value"))


def discussion_json(trees: DataFrame, posts: DataFrame) -> DataFrame:
    """thread_id, value: each post with its nested comments (trees from operators.threads.nested_replies)."""
    head = F.to_json(F.struct("thread_id", "author", "content"))
    j = posts.join(trees, "thread_id", "left")
    return j.select("thread_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"comments":'), F.coalesce("tree", F.lit("[]")), F.lit("}")).alias("value"))


def markdown_lines(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """thread_id, ord, line: a heading and text per post, and its comments quoted as deep as they stand.

    posts: thread_id, author, author_karma, content, posted_at, likes; comments: the same and ord, depth (0 at the top).
    """
    clock = F.coalesce(F.date_format(F.try_to_timestamp("posted_at"), "h:mm a"), F.coalesce("posted_at", F.lit("")))
    who = F.concat(F.lit("**u/"), F.coalesce("author", F.lit("")), F.lit("** (karma: "), F.format_number(F.coalesce("author_karma", F.lit(0)), 0), F.lit(") · "), clock)
    text, up = F.coalesce("content", F.lit("")), F.concat(F.lit("["), F.coalesce("likes", F.lit(0)).cast("string"), F.lit("↑]"))
    short = F.concat(F.regexp_replace(F.substring(text, 1, 100), "\n", " "), F.when(F.length(text) > 100, "...").otherwise(""))
    p = posts.select("thread_id", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("## "), up, F.lit(" "), short, F.lit("\n"), who, F.lit("\n\n"), text, F.lit("\n")).alias("line"))
    mark = F.repeat(F.lit(">"), F.col("depth") + 1)
    quoted = F.array_join(F.transform(F.split(text, "\r?\n"), lambda x: F.concat(mark, F.lit(" "), x)), "\n")
    c = comments.select("thread_id", F.col("ord").cast("long").alias("ord"), F.concat(mark, F.lit(" "), who, F.lit(" "), up, F.lit("\n"), mark, F.lit("\n"), quoted, F.lit("\n")).alias("line"))
    return p.unionByName(c)


def board_rows(board: DataFrame) -> DataFrame:
    """place, value: a table row of the board page per ranked model."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    style = F.when(F.col("percent") >= 25, "text-accent font-medium").when(F.col("percent") < 5, "text-red font-medium").otherwise("text-text")
    return board.where("place is not null").select("place", F.concat(F.lit("<tr>"), cell("place"), cell("model"), F.lit('<td class="'), style, F.lit('">'), F.col("total").cast("string"), F.lit("</td>"), cell("percent"), F.lit("</tr>")).alias("value"))


def splice(page: str, rows: list[str], name: str) -> str:
    """page with rows between its markers <!-- name:begin --> and <!-- name:end -->."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    a, b = page.find(begin), page.find(end)
    if a < 0 or b < a:
        raise ValueError(f"markers of {name} not found")
    return page[: a + len(begin)] + "\n" + "\n".join(rows) + "\n" + page[b:]


def rank(df: DataFrame, order: list) -> DataFrame:
    """With place from 1 in the given order; for boards and rankings of few rows."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def write_object(spark, value: dict, path: str) -> None:
    """One small JSON object (an overlay, a checkpoint) as a file of its own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(value, indent=2).encode()))
    out.close()
