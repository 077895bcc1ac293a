"""Streams: windows with late data, sessions, first-seen rows, cooldowns, and latest-row tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinlab.runtime import Scratch


def open_table(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """name.parquet of folder, a file or a folder of files, as a stream; timestamps without zone are read as UTC."""
    static = spark.read.parquet(f"{folder}/{name}.parquet")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    is_dir = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(static.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    stream = reader.parquet(f"{folder}/{name}.parquet") if is_dir else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in static.schema if f.dataType.typeName() == "timestamp_ntz"})


def window_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and their total value per window and type; events later than `late` behind are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide or length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per user: no two events further apart than gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; batches keep one row per key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def cooled(events: DataFrame, minutes: int = 60) -> DataFrame:
    """user_id, ts of the events that fall at least `minutes` after the user's last accepted one, with state per user.

    Within a trigger a user's events are taken in the order of time.
    """
    wait = minutes * 60_000_000

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        taken = []
        for t in pd.concat(list(batches)).ts.sort_values():
            at = int(t.value // 1000)
            if last is None or at - last >= wait:
                taken.append(t)
                last = at
        state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(taken), "ts": taken})

    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(accept, "user_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, with its checkpoint in the shared folder, and read its result.

    complete keeps the last state of the result, append all rows that were put out.
    """
    scratch = Scratch(stream.sparkSession, "stream")
    out = f"{scratch.root}/out"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upsert(table: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the latest row of each key in the written table: every run writes a new
    version from the last one and the batch, and a version counts once its marker file is there."""

    def put(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path(table)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        last = max([int(n[1:]) for n in done if n.startswith("v") and int(n[1:]) < batch and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))], default=None)
        rows = df if last is None else df.unionByName(spark.read.schema(df.schema).parquet(f"{table}/v{last}"))
        rest = [c for c in df.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, "r.*")
        best.select(*df.columns).write.mode("overwrite").parquet(f"{table}/v{batch}")

    return put
