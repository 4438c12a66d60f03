"""Connected components of an edge table by alternating large and small stars; no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), v < u. Large: neighbours above u join the least of u's neighbourhood; small: those below do."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of the edges (a, b) with the least node it reaches."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = written(_star(_star(now, True), False), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    flat = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return flat.union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
