"""Key-value tables: differences, merges, validation, and text kept without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.runtime import broadcast_if_small


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, old_value, new_value of the keys whose value differs; a missing key has a null value."""
    o, n = old.select(*keys, F.col("value").alias("old_value")), new.select(*keys, F.col("value").alias("new_value"))
    return o.join(n, keys, "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def merged(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: over's values where it has the key, else base's."""
    b, o = base.select(*keys, F.col("value").alias("b"), F.lit(True).alias("in_b")), over.select(*keys, F.col("value").alias("o"), F.lit(True).alias("in_o"))
    return b.join(o, keys, "full").select(*keys, F.when(F.col("in_o"), F.col("o")).otherwise(F.col("b")).alias("value"))


def invalid(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """key, problem: keys that aren't allowed, and allowed required ones that are absent or blank.

    allowed: key, required; a table of known small size.
    """
    unknown = rows.join(broadcast_if_small(allowed), key, "left_anti").select(key, F.lit("unknown").alias("problem")).distinct()
    filled = rows.where(F.trim(F.coalesce(F.col("value").cast("string"), F.lit(""))) != "")
    absent = allowed.where("required").join(filled.select(key).distinct(), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return unknown.unionByName(absent)


def append_once(text: F.Column, more: F.Column) -> F.Column:
    """text with more on a new paragraph, unless it holds it already or more is blank."""
    t, m = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(more, F.lit("")))
    return F.when((m == "") | t.contains(m), t).when(t == "", m).otherwise(F.concat(t, F.lit("\n\n"), m))


def ordered_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """key, text: the blocks (key, position, text) of each key joined in order, blank and repeated ones left out."""
    good = blocks.where(F.trim("text") != "").groupBy(key, "text").agg(F.min("position").alias("position"))
    return good.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text), "\n\n").alias("text"))


def candidates_of_losers(log: DataFrame) -> DataFrame:
    """iteration, candidate: candidates of iterations that didn't win; one without candidates gives its own summary."""
    lost = log.where(~F.coalesce("won", F.lit(False)))
    return lost.select("iteration", F.explode(F.when(F.size(F.coalesce("candidates", F.array().cast("array<string>"))) > 0, F.col("candidates")).otherwise(F.array("summary"))).alias("candidate")).where("candidate is not null")
