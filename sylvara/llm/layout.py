"""Sizes of blocks and buckets, and the shared folder for cut lineage."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """About how large the texts of a one-column frame are; it only sets how finely work is divided.

    A plain scan has its file size; anything else, whose estimate may be off by any factor, is measured."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.agg(F.sum(F.octet_length(F.col(df.columns[0]).cast("string")))).first()[0] or 0


@dataclass(frozen=True)
class Division:
    """How an exchange between blocks of texts and buckets of hashes is cut."""

    blocks: int
    buckets: int
    block_bytes: int


def cut(size: int, part_bytes: int, least: int) -> Division:
    """Blocks of part_bytes and buckets of 8 times that, both growing with the root of the size beyond about half a TB.

    A message from a block to a bucket has size / (blocks * buckets) bytes of text, about 400 however large the
    input is, so messages are as many as the input is large and not as its square.  At 100 TB a block holds 60 MB
    of text and a bucket the hashes of 640 MB."""
    root = isqrt(size)
    block, bucket = max(part_bytes, 6 * root), max(8 * part_bytes, 64 * root)
    return Division(max(2 * least, size // block), max(least, size // bucket), block)


def divide(df: DataFrame, part_bytes: int) -> Division:
    """cut() for the texts of a one-column frame."""
    return cut(input_bytes(df), part_bytes, shuffle_partitions(df.sparkSession))


def is_stable(df: DataFrame) -> bool:
    """Whether a task that runs again reads the same rows in the same order: a scan or checkpoint, at most projected and filtered."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().head()
    kind = plan.getClass().getSimpleName()
    return kind in ("LogicalRelation", "LocalRelation") or (kind == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined())


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder.  The shuffles behind it are not needed any more and go at once."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan made under this setting
    finally:
        spark.conf.set(_CLEANUP, before)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame from cut_lineage() that nothing will read again."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """df itself if is_stable(), else its checkpoint: for work that tells rows by their place in the input, where a
    task that runs again must find them there."""
    return df if is_stable(df) else cut_lineage(df)


def block_of(key, blocks: int):
    """Block by key; rows without one by their place in the (stable) input, so that they spread."""
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.monotonically_increasing_id())), F.lit(blocks)).cast("int")
