"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import cut_lineage, drop


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


# Rows are doubled by exploding arrays, not by unions: Spark 4.1 takes a union of inputs that seem to be
# partitioned alike as partitioned so itself, and then skips or misreads exchanges.


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return edges.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(down.join(least, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Loops, repeated edges and either direction are allowed; edges with a null end are ignored.
    Each round is written to the shared checkpoint folder, so a lost executor costs one round; it replaces the
    round before.
    """
    now = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    sign = _sign(now)
    while True:
        before, now = now, cut_lineage(_small_star(_large_star(now)))
        drop(before)
        new = _sign(now)
        if new == sign:
            break
        sign = new
    return _pairs(now, ("u", "v"), ("v", "v")).distinct().toDF("node", "component")
