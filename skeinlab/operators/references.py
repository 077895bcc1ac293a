"""References to records that do not exist: removed, missing or late parents of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.runtime import BROADCAST_BYTES, Scratch, clean_id, ref_id, ref_type, salted_join

#: Bits of one block: what bitmap_construct_agg builds (4,096 bytes).
BLOCK_BITS = 32_768
#: Hash positions of a key in its block.
HASHES = 5
#: Bits of filter for a key.
BITS_PER_KEY = 10


def bloom_blocks(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """A blocked Bloom filter as a table (block, bits): all positions of a key lie in one 4 KB block.

    Keys are moved to their block's partition first, so only (block, position) pairs are shuffled and each block is
    built once; the table is as large as n_keys * BITS_PER_KEY says, spread over the cluster.
    """
    blocks = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    at = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_positions(F.col(key)))).alias("at"))
    return at.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), blocks


def _block(key, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _positions(key):
    h = F.xxhash64(key, F.lit("position"))
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [F.pmod(h + step * F.lit(i), F.lit(BLOCK_BITS)) for i in range(HASHES)]


def bloom_probe(rows: DataFrame, key: str, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """rows with maybe: false where the filter proves that key isn't among its keys.

    The filter is broadcast while its exact size, blocks * 4 KB, is within BROADCAST_BYTES; beyond that its blocks are
    joined by shuffle.
    """
    table = F.broadcast(filter_blocks) if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES else filter_blocks
    joined = rows.withColumn("block", _block(F.col(key), blocks)).join(table, "block", "left")
    maybe = F.col("bits").isNotNull()
    for at in _positions(F.col(key)):
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        maybe = maybe & (F.getbit(byte.cast("long"), F.pmod(at, F.lit(8)).cast("int")) == 1)
    return joined.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("block", "bits")


def reference_rows(comments: DataFrame) -> DataFrame:
    """One row per comment, field and different reference: ref_field, comment_id, type, id, seen, month.

    seen is the comment's first retrieved_at; month comes from its first created_utc, null if there is none. Null and
    empty references name nothing and give no row; a comment without an id can't refer.
    """
    one = comments.select(
        clean_id("comment_id").alias("comment_id"), "retrieved_at", "created_utc",
        clean_id("parent_id").alias("parent_id"), clean_id("post_fullname").alias("post_fullname"),
    ).where("comment_id is not null")
    per_comment = one.groupBy("comment_id").agg(
        F.min("retrieved_at").alias("seen"), F.min("created_utc").alias("created"),
        F.collect_set("parent_id").alias("parent_id"), F.collect_set("post_fullname").alias("post_fullname"),
    )

    def named(field):
        return F.transform(field, lambda r: F.struct(F.lit(field).alias("ref_field"), r.alias("ref")))

    both = F.array(named("parent_id"), named("post_fullname"))
    rows = per_comment.select("comment_id", "seen", F.date_format(F.timestamp_seconds("created"), "yyyy-MM").alias("month"), F.explode(F.flatten(both)).alias("r"))
    return rows.select("r.ref_field", "comment_id", ref_type(F.col("r.ref")).alias("type"), ref_id(F.col("r.ref")).alias("id"), "seen", "month").where("id is not null")


def record_facts(comments: DataFrame, posts: DataFrame, removals: DataFrame) -> DataFrame:
    """One row per id: whether a comment or post has it, when each was first seen, and which notices name it."""

    def part(df, ident, kind, when):
        return df.select(ident.alias("id"), F.lit(kind).alias("kind"), when.cast("timestamp_ntz").alias("at"))

    notice = clean_id("fullname")
    parts = part(comments, clean_id("comment_id"), "t1", F.col("retrieved_at")).unionByName(
        part(posts, clean_id("post_id"), "t3", F.col("retrieved_at"))
    ).unionByName(part(removals, ref_id(notice), F.concat(F.lit("n"), F.coalesce(ref_type(notice), F.lit(""))), F.lit(None)))
    is_ = lambda k: F.col("kind") == k
    return parts.where("id is not null").groupBy("id").agg(
        *[F.coalesce(F.bool_or(is_(k)), F.lit(False)).alias(n) for k, n in (("t1", "has1"), ("t3", "has3"), ("nt1", "n1"), ("nt3", "n3"), ("n", "nb"))],
        F.min(F.when(is_("t1"), F.col("at"))).alias("first1"), F.min(F.when(is_("t3"), F.col("at"))).alias("first3"),
    )


def dangling_references(comments: DataFrame, posts: DataFrame, removals: DataFrame) -> DataFrame:
    """Each comment's references that are removed, missing or late: ref_field, comment_id, kind, month.

    A Bloom filter of all known ids (records and notices) proves references missing without an exact join; only
    references that it lets through are joined with the records. kind is `removed` if a notice names the record (of the
    given type; a bare name means whichever record has the id, or either type if none has), else `missing` if no row
    has it, else `late` if it was first retrieved after the comment. Several rows of a comment are one comment; with
    different references in them, the strongest kind counts. A null retrieved_at is never late. Empty tables give an
    empty result.
    """
    spark = comments.sparkSession
    scratch = Scratch(spark, "references")
    refs = scratch.cut(reference_rows(comments))
    facts = scratch.cut(record_facts(comments, posts, removals))
    table, blocks = bloom_blocks(facts, "id", facts.count())
    probed = bloom_probe(refs, "id", scratch.cut(table), blocks)
    proven = probed.where("not maybe").select("ref_field", "comment_id", "month", F.lit("missing").alias("kind"))
    joined = salted_join(probed.where("maybe").drop("maybe"), facts, "id")
    had = lambda c: F.coalesce(F.col(c), F.lit(False))
    could1, could3 = had("has1") | ~had("has3"), had("has3") | ~had("has1")
    gone1, gone3 = had("n1") | (had("nb") & could1), had("n3") | (had("nb") & could3)
    t = F.col("type")
    removed = F.when(t == "t1", gone1).when(t == "t3", gone3).otherwise((could1 & gone1) | (could3 & gone3))
    there = F.when(t == "t1", had("has1")).when(t == "t3", had("has3")).otherwise(had("has1") | had("has3"))
    first = F.when(t == "t1", F.col("first1")).when(t == "t3", F.col("first3")).otherwise(F.least("first1", "first3"))
    kind = F.when(removed, "removed").when(~there, "missing").when(first > F.col("seen").cast("timestamp_ntz"), "late")
    verified = joined.select("ref_field", "comment_id", "month", kind.alias("kind")).where("kind is not null")
    strength = F.when(F.col("kind") == "removed", 3).when(F.col("kind") == "missing", 2).otherwise(1)
    return verified.unionByName(proven).groupBy("ref_field", "comment_id").agg(F.max_by("kind", strength).alias("kind"), F.first("month").alias("month"))


def dangling_counts(found: DataFrame) -> DataFrame:
    """Number of such references per field, month and kind."""
    return found.groupBy("ref_field", "month", "kind").agg(F.count("*").alias("n_references"))
