"""Filling fixed-capacity containers with items: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlab.llm.bpe import TOKENIZERS, token_count_column
from skeinlab.runtime import Scratch

CAPACITY = 2_048
#: Items of a container at most.
SEGMENTS = 64
#: Loss-bearing tokens of a container at most: a quarter of it is left to context.
LOSS_CAPACITY = 1_536
#: Kinds of documents that are context only: machine text, whose tokens bear no loss.
CONTEXT_KINDS = ("log", "product_page")
#: Items packed together by one task.
GROUP_ITEMS = 10_000
#: A group's last containers filled less than this are opened again and packed with those of other groups.
FULL = 0.98

ITEM = "item string, part int, start_token long, n_tokens long, loss_tokens long"


def fill(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item. demands: items x dimensions, each within limits.

    One container after another is filled with the item whose demand, weighted by the mean demand of what is left, has
    the largest dot product with the room left in all dimensions, among those that fit in all of them. Equal items are
    one type with a count, so a step looks at types, not items.
    """
    kinds, of = np.unique(demands, axis=0, return_inverse=True)
    of = of.reshape(-1)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1])
    left = np.array([len(m) for m in members])
    share = kinds / limits
    out = np.empty(len(demands), dtype=np.int64)
    container = 0
    live = np.flatnonzero(left > 0)
    while len(live):
        room = limits.astype(np.int64).copy()
        weights = np.average(share[live], axis=0, weights=left[live])
        at = live
        while True:
            at = at[(kinds[at] <= room).all(axis=1) & (left[at] > 0)]
            if not len(at):
                break
            best = at[np.argmax(share[at] @ (weights * (room / limits)))]
            left[best] -= 1
            out[members[best][left[best]]] = container
            room -= kinds[best]
        container += 1
        live = live[left[live] > 0]
    return out


def pack_items(items: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int = LOSS_CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """container, item, part, start_token, n_tokens, loss_tokens, offset for items (item, n_tokens, loss_tokens).

    An item longer than capacity is cut into full parts and a rest; no other is split. The loss-bearing tokens of an item
    are its last ones, and each part has those that lie in it; of a part with more than loss_capacity, only the last
    loss_capacity bear loss. Items are spread by hash over groups of about group_items, each packed by a task of its own
    under all three limits. The last containers of a group, which end less than FULL, are opened and their items, at
    most a quarter of the group's, packed again in fewer groups, until one group is left. So the unused space doesn't
    grow with the number of groups. Items of no tokens are in no container: container and offset are null.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    if not 0 < loss_capacity <= capacity or segments < 1:
        raise ValueError("loss_capacity must be positive and at most capacity, segments at least 1")
    at = F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("int"))).alias("part", "_")
    parts = items.select(F.col("item").cast("string").alias("item"), F.col("n_tokens").alias("all"), F.greatest(F.lit(0), F.least("loss_tokens", "n_tokens")).alias("all_loss"), at)
    start = (F.col("part").cast("long") * capacity).alias("start_token")
    parts = parts.select("item", "part", start, F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("part").cast("long") * capacity).alias("n_tokens"), (F.col("all") - F.col("all_loss")).alias("loss_from"))
    bearing = F.col("start_token") + F.col("n_tokens") - F.greatest("start_token", "loss_from")
    parts = parts.select("item", "part", "start_token", "n_tokens", F.greatest(F.lit(0), F.least(bearing, F.lit(loss_capacity))).cast("long").alias("loss_tokens"))
    parts = scratch.cut(parts)
    done = [scratch.write(parts.where("n_tokens <= 0").select(F.lit(None).cast("string").alias("container"), "*", F.lit(None).cast("long").alias("offset")))]
    left, level = parts.where("n_tokens > 0"), 0
    schema = "container string, " + ITEM + ", offset long, is_open boolean"
    limits = np.array([capacity, loss_capacity, segments])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        demands = np.column_stack([pdf.n_tokens, pdf.loss_tokens, np.ones(len(pdf), dtype=np.int64)]).astype(np.int64)
        pdf["number"] = fill(demands, limits)
        number = pdf.groupby("number").n_tokens.agg(["sum", "size"]).sort_index(ascending=False)
        loose = number.index[(number["size"].cumsum() <= group_items // 4) & (number["sum"] < FULL * capacity)]
        pdf["offset"] = pdf.groupby("number").n_tokens.cumsum() - pdf.n_tokens
        pdf["is_open"] = pdf.number.isin(loose)
        pdf["container"] = [f"{key[1]}-{key[0]}-{n}" for n in pdf.number]
        return pdf[["container", "item", "part", "start_token", "n_tokens", "loss_tokens", "offset", "is_open"]]

    while True:
        n = left.count()
        if not n:
            break
        groups = max(1, -(-n // group_items))
        key = F.pmod(F.xxhash64("item", "part", F.lit(level)), F.lit(groups)).alias("group")
        packed = left.select(key, F.lit(level).alias("level"), *[c for c in left.columns if c in ("item", "part", "start_token", "n_tokens", "loss_tokens")])
        table = scratch.read(scratch.write(packed.repartition(groups, "group").groupBy("group", "level").applyInPandas(pack, schema)), left.sparkSession.createDataFrame([], schema).schema)
        last = groups == 1
        keep = table if last else table.where("not is_open")
        done.append(scratch.write(keep.drop("is_open")))
        if last:
            break
        left, level = table.where("is_open").drop("container", "offset", "is_open"), level + 1
    out = spark.createDataFrame([], "container string, " + ITEM + ", offset long").schema
    return scratch.read(done, out)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, **limits) -> DataFrame:
    """Where each document lies: container, doc_id, part, start_token, n_tokens, loss_tokens, offset.

    Sizes are tokens of the whole text. Documents of the kinds in CONTEXT_KINDS bear no loss, all others do with every
    token. Null and empty texts have no tokens and no container. Repeated rows are separate items.
    """
    n = token_count_column("text", folder)
    sized = Scratch(documents.sparkSession, "sizes").cut(documents.select("doc_id", "kind", n.alias("n_tokens")))
    loss = F.when(F.col("kind").isin(*CONTEXT_KINDS), F.lit(0).cast("long")).otherwise(F.col("n_tokens"))
    items = sized.select(F.col("doc_id").alias("item"), "n_tokens", loss.alias("loss_tokens"))
    at = pack_items(items, capacity, **limits)
    return at.select("container", F.col("item").cast("long").alias("doc_id"), "part", "start_token", "n_tokens", "loss_tokens", "offset")


def container_fill(packed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int = LOSS_CAPACITY) -> DataFrame:
    """One row: containers, how far each limit is used over all of them, and in how many containers it is reached to FULL."""
    c = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.sum("loss_tokens").alias("loss"), F.count("*").alias("items"))
    used = {"tokens": capacity, "loss": loss_capacity, "items": segments}
    return c.agg(
        F.count("*").alias("containers"), *[(F.avg(k) / n).alias(f"{k}_used") for k, n in used.items()],
        *[F.count_if(F.col(k) >= FULL * n).alias(f"{k}_full") for k, n in used.items()],
    )


def faults(packed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int = LOSS_CAPACITY) -> DataFrame:
    """Per document, how many of its parts are wrong: parts that don't follow one another, offsets that don't follow one
    another in the container, containers beyond a limit. All are 0."""
    by_item = Window.partitionBy("doc_id").orderBy("part")
    by_container = Window.partitionBy("container")
    before = F.sum("n_tokens").over(by_container.orderBy("offset", "doc_id", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    total = lambda c: F.sum(c).over(by_container)
    wrong = (F.col("offset") != before) | (total("n_tokens") > capacity) | (total("loss_tokens") > loss_capacity) | (total(F.lit(1)) > segments)
    gap = F.col("start_token") != F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(by_item), F.lit(0))
    spread = packed.withColumn("container", F.coalesce("container", F.concat(F.lit("none"), F.col("doc_id").cast("string"))))  # else all without one meet in a task
    spread = spread.withColumn("wrong", F.when(F.col("container").startswith("none"), F.col("n_tokens") != 0).otherwise(wrong)).withColumn("gap", gap)
    return spread.groupBy("doc_id").agg(F.count_if("wrong").alias("wrong_parts"), F.count_if("gap").alias("gaps"))
