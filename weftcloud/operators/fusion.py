"""Voxel fusion, chunk statistics, levels of detail and deltas.

The key of a voxel is (session, chunk, voxel): one that straddles a chunk face is two rows. Sums combine before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import cell, half_up, to_world

CHUNK = ["session_id", "cx", "cy", "cz"]
VOXEL = [*CHUNK, "vx", "vy", "vz"]
SUMS = {"sx": "x", "sy": "y", "sz": "z", "sr": "r", "sg": "g", "sb": "b", "si": "intensity"}


def placed(points: DataFrame, chunk: float, fuse: float, pose: str = "pose") -> DataFrame:
    """Sensor-frame points with their pose as world points with chunk and voxel."""
    x, y, z = to_world(F.col(pose), tuple(F.col(a).cast("double") for a in "xyz"))
    world = points.withColumns({"x": x, "y": y, "z": z})
    return world.withColumns({f"{k}{a}": cell(F.col(a), size) for k, size in (("c", chunk), ("v", fuse)) for a in "xyz"})


#: sequence and idx as one number, which hash aggregation can keep; a struct would make it sort
STEP = Decimal(10) ** 19


def touch(sequence: str = "sequence", idx: str = "idx") -> Column:
    return (F.col(sequence).cast("decimal(19,0)") * F.lit(STEP) + F.col(idx).cast("decimal(19,0)")).cast("decimal(38,0)")


def _first(rows: DataFrame) -> DataFrame:
    idx = (F.col("first") - F.col("first_seq").cast("decimal(19,0)") * F.lit(STEP)).cast("bigint")
    return rows.select(*VOXEL, *SUMS, "n", "first_seq", idx.alias("first_idx"), "last_seq")


def fuse(points: DataFrame) -> DataFrame:
    """Sums, hits, and first and last touch of each voxel of placed points (sequence and idx, both 0 or more, order them)."""
    return _first(points.groupBy(*VOXEL).agg(*[F.sum(c).alias(s) for s, c in SUMS.items()], F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first_seq"), F.min(touch()).alias("first"), F.max("sequence").alias("last_seq")))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fused tables of different batches as one; sums are associative."""
    cols = [*VOXEL, *SUMS, "n", "first_seq", "first_idx", "last_seq"]
    both = a.select(*cols).unionByName(b.select(*cols))
    return _first(both.groupBy(*VOXEL).agg(*[F.sum(s).alias(s) for s in SUMS], F.sum("n").alias("n"), F.min(touch("first_seq", "first_idx")).alias("first"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")))


def with_ordinal(voxels: DataFrame) -> DataFrame:
    """Adds ordinal, the place of a voxel in its chunk's order of first touch. A chunk's version is its number of voxels."""
    w = Window.partitionBy(*CHUNK).orderBy("first_seq", "first_idx", "vx", "vy", "vz")
    return voxels.withColumn("ordinal", F.row_number().over(w) - 1)


def representative() -> list[Column]:
    """x, y, z as float32 means; colour and intensity rounded half up and clamped."""
    byte = lambda s, top: F.greatest(F.least(half_up(F.col(s) / F.col("n")), F.lit(top)), F.lit(0)).cast("int")
    return [*[(F.col(s) / F.col("n")).cast("float").alias(a) for s, a in zip(("sx", "sy", "sz"), "xyz", strict=True)], *[byte(s, 255).alias(a) for s, a in zip(("sr", "sg", "sb"), "rgb", strict=True)], byte("si", 65535).alias("intensity")]


def representatives(voxels: DataFrame, *keep: str) -> DataFrame:
    return voxels.select(*VOXEL, "n", *keep, *representative())


def seeded(points: DataFrame) -> DataFrame:
    """Voxels from stored representatives that lack sums: each counts as one hit."""
    return points.select(*VOXEL, *[F.col(c).cast("double").alias(s) for s, c in SUMS.items()], F.lit(1).cast("bigint").alias("n"))


def chunk_stats(voxels: DataFrame, bytes_per_point: int = 18) -> DataFrame:
    mean = {a: F.col(f"s{a}") / F.col("n") for a in "xyz"}
    bounds = [f(m).alias(f"{n}_{a}") for a, m in mean.items() for n, f in (("min", F.min), ("max", F.max))]
    return voxels.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("point_count"), (F.count(F.lit(1)) * bytes_per_point).alias("bytes"), F.max("last_seq").alias("applied_sequence"), *bounds)


def observed(voxels: DataFrame, min_hits: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """Voxels seen often enough; n, o0 and opportunities (of the chunk) must be there if min_ratio is given."""
    if min_hits < 1 or not 0 <= min_ratio:
        raise ValueError("min_hits starts at 1 and min_ratio at 0")
    out = voxels.where(F.col("n") >= min_hits) if min_hits > 1 else voxels
    if min_ratio > 0:
        out = out.where(F.col("n") / F.greatest(F.col("opportunities") - F.col("o0") + 1, F.lit(1)) >= min_ratio)
    return out


def coarsen(voxels: DataFrame, edge: float) -> DataFrame:
    """Coarser cells within each chunk: the mean of the fine float32 representatives, one vote each; first is the least ordinal."""
    fine = representatives(voxels, "ordinal")
    cells = fine.groupBy(*CHUNK, *[cell(F.col(a).cast("double"), edge).alias(f"v{a}") for a in "xyz"]).agg(
        *[F.sum(F.col(c).cast("double")).alias(s) for s, c in SUMS.items()], F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")
    )
    return cells


def level_of_detail(voxels: DataFrame, level: int, levels: int, fuse_edge: float) -> DataFrame:
    """Points of a level (voxels with ordinal); the finest level is the voxels themselves, 0 the coarsest."""
    level = min(max(level, 0), levels - 1)
    if level == levels - 1:
        return voxels.select(*VOXEL, "n", F.col("ordinal").alias("first"), *representative())
    return coarsen(voxels, fuse_edge * 2.0 ** (levels - 1 - level)).select(*VOXEL, "n", "first", *representative())


def delta(points: DataFrame, since: int | Column) -> DataFrame:
    """What is new at a level since a version: rows whose first fine voxel has that ordinal or a later one."""
    return points.where(F.col("first") >= since)


def versions(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("version"))


def touched(points: DataFrame) -> DataFrame:
    """Lineage: the chunks each batch touches."""
    return points.select("session_id", "sequence", "cx", "cy", "cz").distinct()


def not_applied(points: DataFrame, applied: DataFrame) -> DataFrame:
    """Leaves out points of batches at or before their chunk's applied sequence, so replay changes nothing."""
    done = applied.select(*CHUNK, "applied_sequence")
    return points.join(done, CHUNK, "left").where(F.col("applied_sequence").isNull() | (F.col("sequence") > F.col("applied_sequence"))).drop("applied_sequence")


def only_chunks(points: DataFrame, chunks: DataFrame) -> DataFrame:
    return points.join(chunks.select(*CHUNK).distinct(), CHUNK, "left_semi")


def each_once(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live chunks, and the stored ones that aren't live."""
    return live.unionByName(stored.join(live.select(*CHUNK).distinct(), CHUNK, "left_anti"))


def all_cells(*tables: DataFrame) -> DataFrame:
    out = tables[0].select(*CHUNK)
    for t in tables[1:]:
        out = out.union(t.select(*CHUNK))
    return out.distinct()
