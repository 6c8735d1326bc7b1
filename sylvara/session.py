"""What the engine needs of a session: a shared checkpoint folder, and unions that are not taken as partitioned.

prepare() is the one place that changes settings of the caller's session; parsing, edits and rules call it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_UNION = "spark.sql.unionOutputPartitioning"


def prepare(spark: SparkSession) -> SparkSession:
    """Spark 4.1 takes a union of inputs that are partitioned alike as partitioned so itself, and gives wrong rows
    where a repartition follows the union of two joins; that optimisation is switched off for the session."""
    spark.conf.set(_UNION, "false")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, that of spark.checkpoint.dir where none is set yet.

    Without either, a temporary folder of this machine in local mode; on a cluster others could not read it, so
    that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by the keys in as many partitions as the session deals out: work in Python takes a core and memory for every row,
    so few file splits, or partitions that adaptive execution puts together by their bytes, are too few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def held(df: DataFrame) -> DataFrame:
    """df's checkpoint, without a size for the planner.

    checkpoint() keeps the size that is derived from the files behind df.  Behind a parse that is too small by any
    factor, and whole node tables would be broadcast through the driver.  Without it joins are planned as shuffles,
    and what adaptive execution measures decides."""
    spark = df.sparkSession
    checkpoint_folder(prepare(spark))
    rows = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().logical().rdd(), rows.schema(), False), spark)
