"""Same or near-same records across splits, by sets of their rarest words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.llm.words import WordHashes, words
from skeinlab.runtime import Scratch, own_id, fits_broadcast, lookup_join, salted_join

#: Least words of a record by field.
LEAST_WORDS = {"body": 20, "post_title": 12}
#: Words in common, of those of the longer text.
SIMILARITY = 0.8
#: Words of the shortest shared span that counts as covered. Pairs without one are found by their rarest words.
SPAN = 6
#: A signature of more records than this (as counted in the sample) gets a further word, up to DEEPEST words.
POPULAR = 6_000
DEEPEST = 4
#: From this many classes on, one class in SAMPLE is counted to tell popular signatures.
SAMPLE, SAMPLE_FROM = 8, 50_000
#: Pairs of records whose sketches are compared at once.
PAIRS_AT_ONCE = 200_000
#: Longest signatures whose records are compared in blocks; the others take one task each.
MOST_BLOCKED = 10_000
#: Buckets of the counts by which words are ordered; any counts give an order that finds every pair.
BUCKETS = 1 << 18
#: Bits of a filter of signatures; collected once per side, whatever the size of the data.
FILTER_BITS = 1 << 26
#: Counters of a record's word sketch, four bits each in two longs, which bounds its words in common with another.
SKETCH = 32
#: Records of one signature compared by one task; where longest signatures have more, they are compared in blocks.
BLOCK = 2_000

MEMBERS = "field_name string, rec_id string, is_train boolean, split string, subreddit string, class binary, n int, words binary"
MARKS = "prefix long, id long, about long, sketch_a long, sketch_b long"


def clean_splits(splits: DataFrame) -> DataFrame:
    """post_id, split, is_train: one row per post with a known split; a post named with several takes the least."""
    s = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    rows = splits.select(own_id("post_id").alias("post_id"), s.alias("split")).where("post_id is not null and split in ('train', 'validation', 'test')")
    return rows.groupBy("post_id").agg(F.min("split").alias("split")).withColumn("is_train", F.col("split") == "train")


def _members(batches):
    hashes = WordHashes()
    for b in batches:
        rows = []
        for field, rec, train, split, sub, text in zip(b.field_name, b.rec_id, b.is_train, b.split, b.subreddit, b.text):
            found = words(text)
            if len(found) >= LEAST_WORDS[field]:
                h = hashes(found).tobytes()
                rows.append((field, rec, train, split, sub, xxhash.xxh3_128_digest(h + field.encode()), len(found), h))
        yield pd.DataFrame(rows, columns=["field_name", "rec_id", "is_train", "split", "subreddit", "class", "n", "words"])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x5851F42D) % np.uint64(FILTER_BITS)).astype(np.int64)


def _mix(h: np.ndarray, x) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Bags:
    """The words of a batch of records, an n-th repetition being a word of its own, as 64-bit hashes."""

    def __init__(self, batch: pd.DataFrame):
        self.texts = [np.frombuffer(w, dtype=np.uint32) for w in batch.words]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        word = np.concatenate(self.texts) if len(self.texts) else np.zeros(0, dtype=np.uint32)
        self.begin = np.cumsum(self.sizes) - self.sizes
        rec = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((word, rec))
        self.rec, word = rec[order], word[order]
        at = np.arange(len(word))
        new = np.ones(len(word), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (self.rec[1:] != self.rec[:-1])
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        field = np.array([f == "body" for f in batch.field_name], dtype=np.uint64)
        self.token = _mix(_mix(field[self.rec] + np.uint64(1), word.astype(np.uint64)), nth.astype(np.uint64) + np.uint64(1))

    def buckets(self) -> np.ndarray:
        return (self.token % np.uint64(BUCKETS)).astype(np.int64)


class Signatures(Bags):
    """Sets of a record's rarest words, of which records with SIMILARITY of their words in common share at least one.

    Sorted by rarity, of n words at most n - need can come before the first that is shared, where need is SIMILARITY*n,
    and the k-th shared word is among the first n - need + k. Two such records thus have the set of their first k shared
    words both, for any k. A set of one word is a signature unless it is in the filter popular[0]; then it is followed by
    every possible second word, and so on. Filters only tell how long signatures are: hits by chance lose nothing.
    """

    def __init__(self, batch: pd.DataFrame, counts: np.ndarray, popular: list[np.ndarray], last: bool = False):
        super().__init__(batch)
        order = np.lexsort((self.token, counts[self.buckets()], self.rec))
        token = self.token[order]
        spare = self.sizes - np.ceil(SIMILARITY * self.sizes - 1e-9).astype(np.int64)
        recs, hashes = [], []
        rec = np.arange(len(self.sizes))
        pos, h = np.full(len(rec), -1), np.zeros(len(rec), dtype=np.uint64)
        for k in range(1, len(popular) + 2):
            more = spare[rec] + k - 1 - pos
            ends = np.cumsum(more)
            step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - more, more)
            pos, rec, h = np.repeat(pos, more) + 1 + step, np.repeat(rec, more), np.repeat(h, more)
            h = _mix(h, token[self.begin[rec] + pos])
            if k <= len(popular):
                often = _has(popular[k - 1], h)
                if not last:
                    recs.append(rec[~often])
                    hashes.append(h[~often])
                rec, pos, h = rec[often], pos[often], h[often]
        self.rec, self.hash = np.concatenate([*recs, rec]), np.concatenate([*hashes, h])

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        return _bits(self.hash)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    hit = lambda i: (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)


def _among(bits: np.ndarray, grams: Signatures) -> np.ndarray:
    return _has(bits, grams.hash)


def signature_filter(classes: DataFrame, of, within=None) -> np.ndarray:
    """Filter of all signatures that `of` makes of classes, or of those in the broadcast filter within, as FILTER_BITS bits.

    Tasks make 4 KB blocks of bits, which are combined before one filter of fixed size comes to the driver. It is a
    sketch: a hit means a signature may be there, and nothing that is there is missed, however full it gets.
    """

    def blocks(batches):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for b in batches:
            g = of(b)
            keep = _among(within.value, g) if within is not None else slice(None)
            for i in g.bits():
                bits[i[keep]] = True
        yield _packed(bits)

    return _combined(classes.select("field_name", "words").mapInPandas(blocks, "block int, bits binary"))


def _packed(bits: np.ndarray) -> pd.DataFrame:
    packed = np.packbits(bits, bitorder="little").reshape(-1, 4096)
    used = np.flatnonzero(packed.any(axis=1))
    return pd.DataFrame({"block": used, "bits": [packed[i].tobytes() for i in used]})


def _combined(parts: DataFrame) -> np.ndarray:
    out = np.zeros((FILTER_BITS // 8 // 4096, 4096), dtype=np.uint8)
    for r in parts.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")).toLocalIterator():
        out[r[0]] = np.frombuffer(r[1], dtype=np.uint8)
    return out.reshape(-1)


def word_counts(classes: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur; of fixed size."""

    def count(batches):
        n = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            n += np.bincount(Bags(b).buckets(), minlength=BUCKETS)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": used, "n": n[used]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in classes.select("field_name", "words").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def popular_filters(classes: DataFrame, counts) -> tuple[list, dict[int, int]]:
    """Broadcast filters of the signatures of 1, 2, ... words that need a further word, and in how many blocks the
    records of the most frequent longest signatures are compared."""
    sc = classes.sparkSession.sparkContext
    one_in = SAMPLE if classes.count() >= SAMPLE_FROM else 1
    sample = classes.where(F.pmod(F.xxhash64("class"), F.lit(one_in)) == 0).select("field_name", "words")
    least = max(2, POPULAR // one_in)
    popular: list = []

    def deepest(batches):
        for b in batches:
            yield pd.DataFrame({"h": Signatures(b, counts.value, [p.value for p in popular], last=True).hash.view(np.int64)})

    def blocks(batches):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for b in batches:
            for i in _bits(b.h.to_numpy(np.int64).view(np.uint64)):
                bits[i] = True
        yield _packed(bits)

    while True:
        often = sample.mapInPandas(deepest, "h long").groupBy("h").count().where(F.col("count") > (least if len(popular) < DEEPEST - 1 else max(2, BLOCK // one_in)))
        if len(popular) == DEEPEST - 1:
            top = often.orderBy(F.desc("count"), "h").limit(MOST_BLOCKED).collect()
            return popular, {h: -(-n * one_in // BLOCK) for h, n in top}
        found = _combined(often.mapInPandas(blocks, "block int, bits binary"))
        if not found.any():
            return popular, {}
        popular = [*popular, sc.broadcast(found)]


def _sketches(texts: list[np.ndarray]) -> np.ndarray:
    """For each text SKETCH counters up to 15, in two 64-bit numbers."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.concatenate(texts) if len(texts) else np.zeros(0, dtype=np.uint32)
    at = np.repeat(np.arange(len(texts)), sizes) * SKETCH + words % SKETCH
    c = np.minimum(np.bincount(at, minlength=len(texts) * SKETCH), 15).astype(np.uint64).reshape(len(texts), 2, SKETCH // 2)
    return (c << (np.arange(SKETCH // 2, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def _counters(sketches: np.ndarray) -> np.ndarray:
    """The counters again, one row a text."""
    shifts = np.arange(SKETCH // 2, dtype=np.uint64) * np.uint64(4)
    return ((sketches[:, :, None] >> shifts) & np.uint64(15)).astype(np.uint8).reshape(len(sketches), SKETCH)


def _marks(counts, popular, of_eval, of_train):
    """Signatures that the other split may have, each with its class's id, sketch, and about: its length times four and
    whether it is among train (2) and evaluation records (1)."""

    def make(batches):
        for b in batches:
            g = Signatures(b, counts.value, [p.value for p in popular])
            train, evaluated = b.has_train.to_numpy(bool), b.has_eval.to_numpy(bool)
            keep = (train[g.rec] & _among(of_eval.value, g)) | (evaluated[g.rec] & _among(of_train.value, g))
            rec, h = g.rec[keep], g.hash[keep]
            sketch, about = _sketches(g.texts).view(np.int64), g.sizes * 4 + train * 2 + evaluated
            yield pd.DataFrame({"prefix": h.view(np.int64), "id": b.id.to_numpy()[rec], "about": about[rec], "sketch_a": sketch[rec, 0], "sketch_b": sketch[rec, 1]})

    return make


def _met(batches):
    """Pairs of classes of different splits with a signature in common, unless length or sketch rules SIMILARITY out."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        key, part = rows.prefix.to_numpy(), rows.part.to_numpy()
        run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))])
        about, kind = rows.about.to_numpy(np.int64), rows.id.to_numpy()
        size = about >> 2
        sketch = _counters(rows[["sketch_a", "sketch_b"]].to_numpy(np.int64).view(np.uint64))
        full = (sketch == 15).any(axis=1)
        train, evaluated = np.flatnonzero(about & 2), np.flatnonzero(about & 1)
        wide = int(size.max()) * 2 + 2
        at = run[train] * wide + size[train]
        order = np.argsort(at, kind="stable")
        train, at = train[order], at[order]
        least, most = np.ceil(SIMILARITY * size[evaluated] - 1e-9), np.floor(size[evaluated] / SIMILARITY + 1e-9)
        begin = np.searchsorted(at, run[evaluated] * wide + least.astype(np.int64), side="left")
        end = np.searchsorted(at, run[evaluated] * wide + np.minimum(most.astype(np.int64), wide - 1), side="right")
        out: set = set()
        ends = np.cumsum(end - begin)
        first = 0
        while first < len(evaluated):
            past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS_AT_ONCE, side="right")))
            n = (end - begin)[first:past]
            j = np.repeat(evaluated[first:past], n)
            i = train[np.repeat(begin[first:past] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            good = full[i] | full[j] | (np.minimum(sketch[i], sketch[j]).sum(axis=1, dtype=np.uint16) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9)
            out.update((x, y) if x < y else (y, x) for x, y in zip(kind[i[good]].tolist(), kind[j[good]].tolist()) if x != y)
            first = past
        return pd.DataFrame(list(out), columns=["id_a", "id_b"])

    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        other = np.flatnonzero((b.prefix != b.prefix.iloc[-1]).to_numpy() | (b.part != b.part.iloc[-1]).to_numpy())
        begin = int(other[-1]) + 1 if len(other) else 0
        held = b.iloc[begin:].reset_index(drop=True)
        if begin:
            yield pairs(b.iloc[:begin].reset_index(drop=True))
    if held is not None and len(held):
        yield pairs(held)


def similar_words(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """id_a, id_b: every pair of classes of different splits that may have SIMILARITY of their words in common,
    in whatever order."""
    sc = classes.sparkSession.sparkContext
    counts = sc.broadcast(word_counts(classes))
    popular, blocks = popular_filters(classes, counts)
    of = lambda b: Signatures(b, counts.value, [p.value for p in popular])
    of_eval = sc.broadcast(signature_filter(classes.where("has_eval"), of))
    of_train = sc.broadcast(signature_filter(classes.where("has_train"), of, of_eval))
    marks = classes.mapInPandas(_marks(counts, popular, of_eval, of_train), MARKS).withColumn("part", F.lit(0).cast("long"))
    if blocks:
        often = classes.sparkSession.createDataFrame(list(blocks.items()), "prefix long, blocks long")
        marks = _dealt(marks.join(F.broadcast(often), "prefix", "left"))
    return scratch.cut(marks.repartition("prefix", "part").sortWithinPartitions("prefix", "part").mapInPandas(_met, "id_a long, id_b long"))


def _verified(batches):
    """Words in common, counted with repetition, and how many words of each record its shared spans cover."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            a, c = np.frombuffer(r.words_a, dtype=np.uint32), np.frombuffer(r.words_b, dtype=np.uint32)
            common = sum((Counter(a.tolist()) & Counter(c.tolist())).values())
            if common < SIMILARITY * max(len(a), len(c)) - 1e-9:
                continue
            covered_a, covered_b = _covered(a, c)
            rows.append((r.class_a, r.class_b, common, covered_a, covered_b))
        yield pd.DataFrame(rows, columns=["class_a", "class_b", "common", "covered_a", "covered_b"])


def _covered(a: np.ndarray, c: np.ndarray) -> tuple[int, int]:
    """Words of each that lie in spans of SPAN or more words which the other has too."""
    spans = [[x[p : p + SPAN].tobytes() for p in range(len(x) - SPAN + 1)] for x in (a, c)]
    shared = set(spans[0]) & set(spans[1])
    covers = [np.zeros(len(a), dtype=bool), np.zeros(len(c), dtype=bool)]
    for cover, own in zip(covers, spans):
        for p, span in enumerate(own):
            if span in shared:
                cover[p : p + SPAN] = True
    return int(covers[0].sum()), int(covers[1].sum())


def records(comments: DataFrame, splits: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Records with enough words and a known split, and their classes: the different word sequences of a field."""
    known = scratch.cut(clean_splits(splits))
    rows = comments.select(own_id("post_id").alias("post_id"), own_id("comment_id").alias("comment_id"), "post_title", "body", "subreddit")
    long_enough = lambda c, n: (F.length(c) >= n) | (F.octet_length(c) > F.length(c))  # noqa: E731  ASCII words take two characters each; other letters may fold to several words
    bodies = rows.where(F.col("comment_id").isNotNull() & long_enough("body", 2 * LEAST_WORDS["body"] - 1)).select("post_id", F.lit("body").alias("field_name"), F.col("comment_id").alias("rec_id"), "subreddit", F.col("body").alias("text"))
    titles = rows.where(long_enough("post_title", 2 * LEAST_WORDS["post_title"] - 1)).groupBy("post_id", "post_title").agg(F.min("subreddit").alias("subreddit")).select(
        "post_id", F.lit("post_title").alias("field_name"), F.col("post_id").alias("rec_id"), "subreddit", F.col("post_title").alias("text")
    )
    texts = lookup_join(bodies.unionByName(titles).where("post_id is not null"), known, "post_id", "inner")
    members = scratch.cut(texts.select("field_name", "rec_id", "is_train", "split", "subreddit", "text").mapInPandas(_members, MEMBERS))
    classes = scratch.cut(members.groupBy("class").agg(
        F.max("field_name").alias("field_name"), F.max("words").alias("words"), F.max("n").alias("n"),
        F.bool_or("is_train").alias("has_train"), F.bool_or(~F.col("is_train")).alias("has_eval"),
    ).withColumn("id", F.monotonically_increasing_id()))  # written, so it stays
    return members, classes


def split_overlaps(comments: DataFrame, splits: DataFrame) -> DataFrame:
    """Pairs of a train and an evaluation record that are the same or nearly: field_name, train_id, eval_id, split,
    subreddit (both of the evaluation record), train_words, eval_words, common, train_covered, eval_covered.

    Records are bodies (by comment) and titles (by post) with enough words and a known split. Equal word sequences are
    one class. Classes that share a signature (a set of their rarest words, see Signatures) are candidates, which leaves
    out no pair with SIMILARITY of the words in common, however they are scattered, unless lengths or word sketches rule it out. Candidates are verified on their whole
    texts, and the spans they share merged into each record's coverage. No partner is dropped: the
    longest signatures of many records are compared in blocks. Null and short texts are no records; with several texts a record counts by any of them.
    """
    scratch = Scratch(comments.sparkSession, "overlaps")
    members, classes = records(comments, splits, scratch)
    pairs = scratch.cut(similar_words(classes, scratch).distinct())
    ids = scratch.cut(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
    texts = scratch.cut(lookup_join(classes.select("id", "class", "words"), ids, "id", "inner", 40))
    side = lambda s: texts.select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}"), F.col("words").alias(f"words_{s}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    near = scratch.cut(both.select("class_a", "class_b", "words_a", "words_b").mapInPandas(_verified, "class_a binary, class_b binary, common int, covered_a int, covered_b int"))
    same = classes.where("has_train and has_eval").select(F.col("class").alias("t"), F.col("class").alias("e"), F.col("n").alias("common"), F.col("n").alias("train_covered"), F.col("n").alias("eval_covered"))
    way = lambda x, y: near.select(F.col(f"class_{x}").alias("t"), F.col(f"class_{y}").alias("e"), "common", F.col(f"covered_{x}").alias("train_covered"), F.col(f"covered_{y}").alias("eval_covered"))
    links = scratch.cut(same.unionByName(way("a", "b")).unionByName(way("b", "a")))
    train = members.where("is_train").select(F.col("class").alias("t"), F.col("rec_id").alias("train_id"), F.col("n").alias("train_words"), "field_name")
    small = fits_broadcast(links.count(), 80)
    of_links = train.join(F.broadcast(links), "t") if small else salted_join(train, links, "t", "inner")
    evaluated = members.where("not is_train").select(F.col("class").alias("e"), F.col("rec_id").alias("eval_id"), F.col("n").alias("eval_words"), "split", "subreddit")
    if small:
        evaluated = evaluated.join(F.broadcast(links.select("e").distinct()), "e", "left_semi")
    out = salted_join(scratch.cut(of_links), evaluated, "e", "inner").where("train_id <> eval_id")
    return out.select("field_name", "train_id", "eval_id", "split", "subreddit", "train_words", "eval_words", "common", "train_covered", "eval_covered")


def _dealt(wide: DataFrame) -> DataFrame:
    """Rows with blocks in the parts where they meet every block of the other side."""
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    none = F.array().cast("array<long>")
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(
        F.when(F.col("about").bitwiseAND(2) > 0, F.transform(others, lambda x: mine * F.col("blocks") + x)).otherwise(none),
        F.when(F.col("about").bitwiseAND(1) > 0, F.transform(others, lambda x: x * F.col("blocks") + mine)).otherwise(none),
    )))
    return wide.withColumn("part", F.explode(cells)).drop("blocks")


def overlap_pairs(found: DataFrame) -> DataFrame:
    """field_name, id_a, id_b with id_a < id_b, each pair once."""
    return found.select("field_name", F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def overlap_counts(found: DataFrame) -> DataFrame:
    """Pairs and evaluation records found, per field, split and subreddit."""
    return found.groupBy("field_name", "split", "subreddit").agg(F.countDistinct("train_id", "eval_id").alias("n_pairs"), F.countDistinct("eval_id").alias("n_records"))
