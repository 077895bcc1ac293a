"""Lexical diversity within threads: self-BLEU, repeated terms and phrases, openings, overlap, style."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.functions.text import STYLE_PATTERNS, bleu_tokens, is_informative, ngrams, overlap_tokens

#: Comments of one side of a tile; all pairs of a thread are covered by tiles of blocks against blocks.
TILE = 256


def tiles(comments: DataFrame, tile: int = TILE) -> DataFrame:
    """Each comment in every tile its block takes part in: thread_id, left, right, and side.

    Blocks are dealt by ordinal, their number follows the thread's size, and a tile holds two blocks at most, so no
    task gets a whole popular thread and no pair of comments is ever a row.
    """
    n = comments.groupBy("thread_id").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("blocks"))
    c = comments.join(n, "thread_id").withColumn("block", F.pmod(F.xxhash64("thread_id", "comment_id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return c.select("*", others).select(
        "thread_id", "comment_id", "tokens", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), (F.col("block") <= F.col("other")).alias("is_left")
    )


def _bleu(overlap: np.ndarray, n_hyp: np.ndarray, n_ref: np.ndarray, order: int) -> np.ndarray:
    """Smoothed BLEU of each pair: overlap[k] is the clipped overlap of (k+1)-grams."""
    total = np.zeros(np.broadcast(n_hyp, n_ref).shape)
    for k in range(order):
        total = total + np.log((overlap[k] + 1.0) / (np.maximum(n_hyp - k, 0) + 1.0)) / order
    with np.errstate(divide="ignore", invalid="ignore"):
        brevity = np.where(n_hyp > n_ref, 1.0, np.exp(1.0 - n_ref / np.maximum(n_hyp, 1)))
    return np.where((n_hyp == 0) | (n_ref == 0), 0.0, brevity * np.exp(total))


def pair_sums(tokens_a: list[list[str]], tokens_b: list[list[str]], same: bool) -> tuple[int, list[float], np.ndarray, np.ndarray]:
    """Number of pairs and sums of symmetric BLEU-2, -3 and -4 over the pairs of two blocks (or within one)."""
    na, nb = (np.array([len(t) for t in x], dtype=float) for x in (tokens_a, tokens_b))
    overlap = np.zeros((4, len(na), len(nb)))
    for k in range(4):
        places: dict[tuple, list[tuple[int, int]]] = {}
        for j, t in enumerate(tokens_b):
            for g, c in Counter(zip(*[t[i:] for i in range(k + 1)])).items():
                places.setdefault(g, []).append((j, c))
        index = {g: (np.array([p[0] for p in v]), np.array([p[1] for p in v])) for g, v in places.items()}
        for i, t in enumerate(tokens_a):
            for g, c in Counter(zip(*[t[i:] for i in range(k + 1)])).items():
                if g in index:
                    at, counts = index[g]
                    overlap[k, i, at] += np.minimum(c, counts)
    pick = np.triu(np.ones((len(na), len(nb)), dtype=bool), 1) if same else np.ones((len(na), len(nb)), dtype=bool)
    sums, by_a, by_b = [], [], []
    for order in (2, 3, 4):
        both = (_bleu(overlap, na[:, None], nb[None], order) + _bleu(overlap, nb[None], na[:, None], order)) / 2
        both = np.where(pick, both, 0.0)
        sums.append(float(both.sum()))
        by_a.append(both.sum(axis=1))
        by_b.append(both.sum(axis=0))
    return int(pick.sum()), sums, np.array(by_a), np.array(by_b)


def _tile_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    thread, left, right = key
    pdf = pdf.sort_values("comment_id")
    a = pdf[pdf.is_left] if left != right else pdf
    b = pdf[~pdf.is_left] if left != right else pdf
    n, _, by_a, by_b = pair_sums([list(t) for t in a.tokens], [list(t) for t in b.tokens], left == right)
    out = pd.DataFrame({"thread_id": thread, "comment_id": a.comment_id.to_numpy(), "b2": by_a[0], "b3": by_a[1], "b4": by_a[2]})
    other = pd.DataFrame({"thread_id": thread, "comment_id": b.comment_id.to_numpy(), "b2": by_b[0], "b3": by_b[1], "b4": by_b[2]})
    return pd.concat([out, other])


def comment_self_bleu(comments: DataFrame, tile: int = TILE) -> DataFrame:
    """thread_id, comment_id, n (comments of the thread), self_bleu_2 to _4: each comment's mean symmetric BLEU with the
    other comments of its thread; 0 alone."""
    c = comments.select("thread_id", "comment_id", bleu_tokens("text").alias("tokens"))
    sums = tiles(c, tile).groupBy("thread_id", "left", "right").applyInPandas(_tile_sums, "thread_id string, comment_id string, b2 double, b3 double, b4 double")
    per = sums.groupBy("thread_id", "comment_id").agg(*[F.sum(x).alias(x) for x in ("b2", "b3", "b4")])
    n = comments.groupBy("thread_id").agg(F.count("*").alias("n"))
    return per.join(n, "thread_id").select("thread_id", "comment_id", "n", *[F.coalesce(F.try_divide(f"b{k}", F.col("n") - 1), F.lit(0.0)).alias(f"self_bleu_{k}") for k in (2, 3, 4)])


def self_bleu(comments: DataFrame, tile: int = TILE) -> DataFrame:
    """thread_id, comment_count, pair_count, self_bleu_2 to _4, mean_comment_tokens, median_comment_tokens."""
    per = comment_self_bleu(comments, tile).groupBy("thread_id").agg(F.max("n").alias("comment_count"), *[F.avg(f"self_bleu_{k}").alias(f"self_bleu_{k}") for k in (2, 3, 4)])
    sizes = comments.select("thread_id", F.size(bleu_tokens("text")).alias("t")).groupBy("thread_id").agg(F.avg("t").alias("mean_comment_tokens"), F.median("t").alias("median_comment_tokens"))
    return per.withColumn("pair_count", F.col("comment_count") * (F.col("comment_count") - 1) / 2).join(sizes, "thread_id")


def _repeated(units: DataFrame, n_texts: DataFrame, limit: int, tie) -> DataFrame:
    counts = units.groupBy("thread_id", "term", "comment_id").agg(F.count("*").alias("c")).groupBy("thread_id", "term").agg(F.count("*").alias("docs"), F.sum("c").alias("total"))
    least = F.when(F.col("n") < 6, 2).otherwise(3)
    good = counts.join(n_texts, "thread_id").where((F.col("docs") >= least) & (F.col("total") >= least))
    w = Window.partitionBy("thread_id").orderBy(F.desc("docs"), F.desc("total"), *tie, F.desc("term"))
    return good.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("thread_id", "place", "term", "docs", "total")


def repeated_terms(comments: DataFrame, limit: int = 7) -> DataFrame:
    """Terms in at least 2 comments of a thread (3 from six comments on), most documents first."""
    n = comments.groupBy("thread_id").agg(F.count("*").alias("n"))
    return _repeated(comments.select("thread_id", "comment_id", F.explode(overlap_tokens("text")).alias("term")), n, limit, [])


def repeated_phrases(comments: DataFrame, limit: int = 5) -> DataFrame:
    """Two- and three-word phrases repeated likewise, unless all their words say little."""
    n = comments.groupBy("thread_id").agg(F.count("*").alias("n"))
    t = comments.select("thread_id", "comment_id", overlap_tokens("text").alias("t"))
    phrases = t.select("thread_id", "comment_id", F.explode(F.concat(ngrams("t", 2), ngrams("t", 3))).alias("term")).where(is_informative(F.split("term", " ")))
    return _repeated(phrases, n, limit, [F.desc(F.size(F.split("term", " ")))])


def opening_ratio(comments: DataFrame) -> DataFrame:
    """Share of a thread's comments that have the most frequent first six terms."""
    t = comments.select("thread_id", overlap_tokens("text").alias("t"))
    n = t.groupBy("thread_id").agg(F.count("*").alias("n"))
    top = t.where(F.size("t") > 0).groupBy("thread_id", F.array_join(F.slice("t", 1, 6), " ").alias("o")).count().groupBy("thread_id").agg(F.max("count").alias("m"))
    return n.join(top, "thread_id", "left").select("thread_id", F.coalesce(F.col("m") / F.col("n"), F.lit(0.0)).alias("opening_ratio"))


def mean_overlap(comments: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean Jaccard similarity of the pairs of a thread's term sets, in tiles; comments without terms don't count."""
    c = comments.select("thread_id", "comment_id", F.array_distinct(overlap_tokens("text")).alias("tokens")).where(F.size("tokens") > 0)

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf.is_left] if key[1] != key[2] else pdf
        b = pdf[~pdf.is_left] if key[1] != key[2] else pdf
        words = {w: i for i, w in enumerate(sorted({w for t in pdf.tokens for w in t}))}
        rows = lambda x: np.array([np.bincount([words[w] for w in t], minlength=len(words)) for t in x.tokens], dtype=np.float64).reshape(len(x), len(words))
        ma, mb = rows(a), rows(b)
        both = ma @ mb.T
        j = both / np.maximum(ma.sum(axis=1)[:, None] + mb.sum(axis=1)[None] - both, 1)
        pick = np.triu(np.ones(j.shape, dtype=bool), 1) if key[1] == key[2] else np.ones(j.shape, dtype=bool)
        return pd.DataFrame({"thread_id": [key[0]], "total": [float(j[pick].sum())], "pairs": [int(pick.sum())]})

    s = tiles(c, tile).groupBy("thread_id", "left", "right").applyInPandas(sums, "thread_id string, total double, pairs long")
    per = s.groupBy("thread_id").agg(F.sum("total").alias("t"), F.sum("pairs").alias("p"))
    return comments.select("thread_id").distinct().join(per, "thread_id", "left").select("thread_id", F.coalesce(F.try_divide("t", "p"), F.lit(0.0)).alias("token_jaccard"))


def style_signals(comments: DataFrame) -> DataFrame:
    """thread_id, signal, n, place: how many comments show each style, most frequent first."""
    low = F.lower("text")
    hits = [F.when(low.rlike(p), F.lit(s)) for s, p in STYLE_PATTERNS.items()]
    hits.append(F.when(F.size(F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))) <= 12, F.lit("short blunt replies")))
    found = comments.where("text <> ''").select("thread_id", F.explode(F.array_compact(F.array(*hits))).alias("signal")).groupBy("thread_id", "signal").agg(F.count("*").alias("n"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("n"), "signal")))
