"""Session helpers shared by all operators: shared storage, lineage cuts, size-checked and salted joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many bytes (estimated as rows times row bytes).
BROADCAST_BYTES = 32 << 20
#: Keys examined for skew: any key with more than 1/HOT_KEYS of the rows is among them.
HOT_KEYS = 64
#: A key is hot from this many rows on.
HOT_ROWS = 20_000
#: Pieces that a hot key is split into.
SALTS = 16


def get_session(app: str = "skeinlab", master: str | None = None) -> SparkSession:
    """A session with the defaults the library expects; an existing session is reused unchanged."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or on a local master a folder of our own.
    On a cluster without the setting it is an error, as executors would write to disks of their own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skeinlab-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder. They survive lost executors; drop() frees those no longer read, and
    free_scratch() all that this process has made, once results are written elsewhere."""

    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self.root)
        self.step = 0

    def write(self, df: DataFrame) -> str:
        self.step += 1
        path = f"{self.root}/{self.step}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read again."""
        return self.read(self.write(df), df.schema)

    def read(self, paths: str | list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))

    def drop(self, path: str) -> None:
        delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process; DataFrames that still read one can't be run afterwards."""
    while Scratch.made:
        root = Scratch.made.pop()
        delete(spark, root)


def fits_broadcast(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= limit


def hot_keys(df: DataFrame, key: str, least: int = HOT_ROWS, most: int = HOT_KEYS) -> list:
    """The keys, null too, with at least `least` rows among the `most` most frequent; counted with map-side combine."""
    top = df.groupBy(key).count().where(F.col("count") >= least)
    return [r[0] for r in top.orderBy(F.desc("count"), key).limit(most).collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", hot: list | None = None, salts: int = SALTS) -> DataFrame:
    """big joined with small, unique by key, where a few keys may hold most rows of big.

    Rows of hot keys are spread over `salts` pieces, and only the matching rows of small are repeated as often, so no
    task gets a whole hot key; null keys, which match nothing, are spread likewise. The result has no duplicates beyond
    those of a plain join.
    """
    hot = hot_keys(big, key) if hot is None else hot
    if not hot:
        return big.join(small, key, how)
    named = [k for k in hot if k is not None]
    is_hot = F.coalesce(F.col(key).isin(named), F.lit(False)) if named else F.lit(False)
    spread_out = is_hot | F.col(key).isNull() if None in hot else is_hot
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", F.when(spread_out, spread).otherwise(F.lit(0)))
    pieces = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("_salt", F.explode(pieces))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else as it is."""
    return F.broadcast(df) if fits_broadcast(df.count(), row_bytes, limit) else df


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """big joined with small, unique by key: broadcast if small's counted rows fit the limit, else salted."""
    if fits_broadcast(small.count(), row_bytes, limit):
        return big.join(F.broadcast(small), key, how)
    return salted_join(big, small, key, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(c: Column | str) -> Column:
    """Ids compared without case and surrounding blanks; empty ones become null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(s != "", s)


def own_id(c: Column | str) -> Column:
    """A record's own id, or the id that a reference names: clean and without t1_ or t3_. Every id is read by this."""
    return ref_id(clean_id(c))


def ref_type(clean: Column) -> Column:
    """t1 for a comment, t3 for a post, null for a bare id."""
    return F.when(clean.startswith("t1_"), F.lit("t1")).when(clean.startswith("t3_"), F.lit("t3"))


def ref_id(clean: Column) -> Column:
    s = F.regexp_replace(clean, "^t[13]_", "")
    return F.when(s != "", s)
