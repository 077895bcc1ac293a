"""Spans that records of one split share with the other: a suffix array over the partitioned, concatenated texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlab.llm import overlaps as O
from skeinlab.runtime import Scratch, salted_join

#: Words of the shortest shared span that counts.
SPAN = O.SPAN
#: Words of a suffix that it is sorted by. A longer span is found whole all the same, as each of its places has a suffix.
KEY = 24
#: Suffixes of one range of the array, sorted and compared by one task.
RANGE = 200_000
TRAIN, EVAL = 1, 2


class Spans:
    """All spans of SPAN words of a batch of texts: record, place and 64-bit hash."""

    def __init__(self, batch: pd.DataFrame):
        self.texts = [np.frombuffer(w, dtype=np.uint32) for w in batch.words]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        word = (np.concatenate(self.texts) if len(self.texts) else np.zeros(0, dtype=np.uint32)).astype(np.uint64)
        rec = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(pos + SPAN <= sizes[rec]) if len(word) else np.zeros(0, dtype=np.int64)
        field = np.array([f == "body" for f in batch.field_name], dtype=np.uint64)
        h = field[rec[at]] + np.uint64(7)
        for k in range(SPAN):
            h = O._mix(h, word[at + k])
        self.rec, self.pos, self.hash = rec[at], pos[at], h

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        return O._bits(self.hash)


def _suffixes(of_eval, of_train):
    """Suffixes whose first span the other split may have; those of records in both splits have both sides. The key is
    the field and the first KEY words, so that keys compare like the words."""

    def make(batches):
        for b in batches:
            s = Spans(b)
            train, evaluated = b.has_train.to_numpy(bool)[s.rec], b.has_eval.to_numpy(bool)[s.rec]
            keep = np.flatnonzero((train & O._among(of_eval.value, s)) | (evaluated & O._among(of_train.value, s)))
            fields, turned = [b"b" if f == "body" else b"t" for f in b.field_name], [t.astype(">u4") for t in s.texts]
            keys = [fields[r] + turned[r][p : p + KEY].tobytes() for r, p in zip(s.rec[keep], s.pos[keep])]
            yield pd.DataFrame({"id": b.id.to_numpy()[s.rec[keep]], "pos": s.pos[keep].astype(np.int32), "key": keys, "side": (train[keep] * TRAIN + evaluated[keep] * EVAL).astype(np.int32)})

    return make


def _common(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows i and j, in words; padding is equal to nothing."""
    same = (keys[i] == keys[j]) & (keys[i] != 0)
    return np.where(same.all(axis=1), keys.shape[1], np.argmin(same, axis=1))


def matched(rows: pd.DataFrame) -> pd.DataFrame:
    """id, pos, length: how far each suffix of a sorted range agrees with its nearest neighbours of the other side, the
    last before it and the first after it; in a suffix array no other suffix agrees further."""
    rows = rows.sort_values(["key", "id", "pos"], kind="stable").reset_index(drop=True)
    n = len(rows)
    keys = np.zeros((n, KEY), dtype=np.uint32)
    fields = np.array([k[0] for k in rows.key], dtype=np.int64)
    for r, k in enumerate(rows.key):
        own = np.frombuffer(k, dtype=">u4", offset=1)
        keys[r, : len(own)] = own
    side, at = rows.side.to_numpy(), np.arange(n)
    length = np.zeros(n, dtype=np.int64)
    for own, other in ((TRAIN, EVAL), (EVAL, TRAIN)):
        mine, there = (side & own) > 0, (side & other) > 0
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(there, at, -1))[:-1]])
        after = np.concatenate([np.minimum.accumulate(np.where(there, at, n)[::-1])[::-1][1:], [n]])
        for near in (before, after):
            i = np.flatnonzero(mine & (near >= 0) & (near < n))
            j = near[i]
            found = np.where(fields[i] == fields[j], _common(keys, i, j), 0)
            length[i] = np.maximum(length[i], found)
    own = (rows.ghost.to_numpy() == 0) & (length >= SPAN)
    return pd.DataFrame({"id": rows.id.to_numpy()[own], "pos": rows.pos.to_numpy()[own], "length": length[own].astype(np.int32)})


def shared_spans(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """id, pos, length of every place from which a class (id, field_name, words, has_train, has_eval) shares at least SPAN
    words with a class of the other split.

    The array is partitioned by range over whole keys, so a span that a third of all records has lies in many ranges. A
    range also gets the nearest suffixes of either side from the ranges before and after it, at most four. The work is
    linear in the suffixes, however often a span occurs.
    """
    sc = classes.sparkSession.sparkContext
    of_eval = sc.broadcast(O.signature_filter(classes.where("has_eval"), Spans))
    of_train = sc.broadcast(O.signature_filter(classes.where("has_train"), Spans, of_eval))
    rows = scratch.cut(classes.mapInPandas(_suffixes(of_eval, of_train), "id long, pos int, key binary, side int"))
    n = rows.count()
    ranged = scratch.cut(rows.repartitionByRange(max(1, -(-n // RANGE)), "key", "id", "pos").withColumn("part", F.spark_partition_id()).withColumn("ghost", F.lit(0)))
    one = F.struct("key", "id", "pos", "side")
    of = lambda s: F.col("side").bitwiseAND(s) > 0
    edges = ranged.groupBy("part").agg(
        F.max(F.when(of(TRAIN), one)).alias("last_train"), F.max(F.when(of(EVAL), one)).alias("last_eval"), F.min(F.when(of(TRAIN), one)).alias("first_train"), F.min(F.when(of(EVAL), one)).alias("first_eval")
    )
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    down = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    near = edges.select("part", F.array(
        F.last("last_train", True).over(up), F.last("last_eval", True).over(up), F.first("first_train", True).over(down), F.first("first_eval", True).over(down),
    ).alias("near"))
    around = near.select("part", F.explode("near").alias("g")).where("g is not null")
    ghosts = around.select("g.id", "g.pos", "g.key", "g.side", "part", F.lit(1).alias("ghost"))
    return ranged.select(*ghosts.columns).unionByName(ghosts).groupBy("part").applyInPandas(matched, "id long, pos int, length int")


def coverage(comments: DataFrame, splits: DataFrame) -> DataFrame:
    """field_name, rec_id, split, subreddit, n, covered: how many of a record's words lie in spans of SPAN or more words
    that records of the other split (train against validation and test) have too.

    Records are as in overlaps.split_overlaps; one with several texts comes out with each. Records that are in both
    splits with the same words are covered whole. Records without a shared span have 0, empty tables give no rows.
    """
    scratch = Scratch(comments.sparkSession, "spans")
    members, classes = O.records(comments, splits, scratch)
    spans = shared_spans(classes, scratch)
    step = "CASE WHEN x.pos + x.length <= a.upto THEN a ELSE named_struct('upto', x.pos + x.length, 'n', a.n + x.pos + x.length - greatest(a.upto, x.pos)) END"
    merged = spans.groupBy("id").agg(F.expr(f"aggregate(array_sort(collect_list(struct(pos, length))), named_struct('upto', 0, 'n', 0), (a, x) -> {step}).n").alias("covered"))  # a text's places
    by_class = classes.select("class", "id", "n", (F.col("has_train") & F.col("has_eval")).alias("whole")).join(merged, "id", "left")
    covered = by_class.select("class", F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("covered", F.lit(0))).alias("covered"))
    return salted_join(members.select("class", "field_name", "rec_id", "split", "subreddit", "n"), covered, "class", "inner").drop("class")


def coverage_report(found: DataFrame) -> DataFrame:
    """Per field, split and subreddit: records, those with a shared span, words and covered words."""
    return found.groupBy("field_name", "split", "subreddit").agg(F.count("*").alias("n_records"), F.count_if(F.col("covered") > 0).alias("n_sharing"), F.sum("n").alias("n_words"), F.sum("covered").alias("n_covered"))
