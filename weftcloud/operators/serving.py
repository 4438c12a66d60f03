"""What each viewer is sent: chunk selection by view, the diff with what it holds, deltas and keyframes, and the live overlay."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import box
from ..functions.views import Camera, chunk_level, sees_point
from .fusion import CHUNK
from .sessions import first_reason

HELD = "viewer_id string, session_id string, cx bigint, cy bigint, cz bigint, level int, version bigint, count bigint, keyframe_version bigint"


def in_view(cells: DataFrame, cameras: Sequence[Camera], size: float, fuse: float, levels: int, target_px: float = 1.5) -> DataFrame:
    """(viewer_id, chunk, level): chunks in view, from chunk indexes alone, before any points are read.

    Each camera is a set of literals, so a chunk costs one row whatever the number of its viewers until it is seen.
    """
    low, high = box((F.col("cx"), F.col("cy"), F.col("cz")), size)
    views = F.array(*[F.struct(F.lit(c.name).alias("viewer_id"), chunk_level(c, low, high, fuse, levels, target_px).alias("level")) for c in cameras])
    return cells.select(*CHUNK, F.explode(F.filter(views, lambda v: v["level"].isNotNull())).alias("v")).select("v.viewer_id", *CHUNK, "v.level")


def view_diff(visible: DataFrame, held: DataFrame) -> DataFrame:
    """What a changed view asks for: keyframe for new chunks and changed levels, drop for chunks gone, nothing else."""
    keys = ["viewer_id", *CHUNK]
    both = visible.select(*keys, "level").join(held.select(*keys, F.col("level").alias("held_level")), keys, "full_outer")
    action = F.when(F.col("level").isNull(), "chunk_drop").when(F.col("held_level").isNull() | (F.col("held_level") != F.col("level")), "chunk_keyframe")
    return both.withColumn("action", action).where("action is not null")


def refresh(visible: DataFrame, held: DataFrame, totals: DataFrame) -> DataFrame:
    """The decision for each chunk of each viewer after new points: drop, keyframe, delta, advance or none.

    totals: viewer_id, chunk, level, version, total, added (points whose first voxel is at or after the held version).
    """
    keys = ["viewer_id", *CHUNK]
    h = held.select(*keys, F.col("level").alias("held_level"), F.col("version").alias("held_version"), F.col("count").alias("held_count"), "keyframe_version")
    j = visible.select(*keys, "level").join(h, keys, "full_outer").join(totals.select(*keys, "version", "total", "added"), keys, "left")
    is_held, empty = F.col("held_level").isNotNull(), F.coalesce(F.col("total"), F.lit(0)) == 0
    diverged = F.col("total") != F.col("held_count") + F.col("added")
    settled = F.col("version") >= 2 * F.greatest(F.col("keyframe_version"), F.lit(1))
    keyframe = ~is_held | (F.col("held_level") != F.col("level")) | diverged | settled
    action = (
        F.when(F.col("level").isNull(), F.when(is_held, "chunk_drop").otherwise("none"))
        .when(keyframe & empty, F.when(is_held, "chunk_drop").otherwise("none"))
        .when(keyframe, "chunk_keyframe").when(F.col("added") == 0, "advance").otherwise("chunk_delta")
    )
    return j.withColumn("action", action)


def next_held(decided: DataFrame) -> DataFrame:
    """Viewer state after the messages of refresh() were sent."""
    keys = ["viewer_id", *CHUNK]
    stays = decided.where(~F.col("action").isin("chunk_drop") & (F.col("held_level").isNotNull() | (F.col("action") == "chunk_keyframe")))
    fresh = F.col("action") == "chunk_keyframe"
    return stays.select(*keys, F.when(fresh, F.col("level")).otherwise(F.col("held_level")).alias("level"), F.col("version"), F.when(F.col("action").isin("chunk_keyframe", "chunk_delta"), F.col("total")).otherwise(F.col("held_count")).alias("count"), F.when(fresh, F.col("version")).otherwise(F.col("keyframe_version")).alias("keyframe_version"))


def messages(decided: DataFrame, points: DataFrame) -> DataFrame:
    """Serving rows: one for each message, with the points of keyframes (all) and deltas (first at or after the held version)."""
    keys = ["viewer_id", *CHUNK]
    sent = decided.where(F.col("action").isin("chunk_keyframe", "chunk_delta", "chunk_drop"))
    part = sent.select(*keys, "action", "level", "version", "total", "held_version")
    with_points = part.join(points, keys, "left").where((F.col("action") != "chunk_delta") | (F.col("first") >= F.col("held_version")))
    return with_points.groupBy(*keys, "action", "level", "version", "total").agg(F.sort_array(F.collect_list(F.struct("first", "x", "y", "z", "r", "g", "b", "intensity"))).alias("points")).withColumn("point_count", F.size("points"))


def overlay(points: DataFrame, cameras: Sequence[Camera], most: int = 0) -> DataFrame:
    """Live points of each batch in each viewer's frustum, thinned to `most` by an even stride: rows floor(j * inside / most)."""
    at = (F.col("x"), F.col("y"), F.col("z"))
    names = F.array(*[F.when(sees_point(c, at), F.lit(c.name)) for c in cameras])
    seen = points.withColumn("viewer_id", F.explode(F.filter(names, lambda n: n.isNotNull())))
    return thinned(seen, ["viewer_id", "session_id", "sequence"], "idx", most)


def thinned(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    if most <= 0:
        return rows
    w = Window.partitionBy(*by)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    # row i is floor(j * n / most) for some j below `most`: the least j with j * n / most >= i
    j = F.floor((F.col("_i") * most + F.col("_n") - 1) / F.col("_n"))
    hit = (F.floor(j * F.col("_n") / most) == F.col("_i")) & (j < most)
    return numbered.where((F.col("_n") <= most) | hit).drop("_i", "_n")


def bootstrap(points: DataFrame) -> DataFrame:
    """One message for each chunk for a viewer without a view."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "x", "y", "z", "r", "g", "b", "intensity")))
    return points.groupBy(*CHUNK).agg(rows.alias("points"), F.count(F.lit(1)).alias("point_count")).withColumn("action", F.lit("chunk_bootstrap"))


def touched_in_view(dirty: DataFrame, visible: DataFrame) -> DataFrame:
    """Chunks with new points, for each viewer that has them in view."""
    return visible.join(dirty.select(*CHUNK).distinct(), CHUNK)


def traffic(sent: DataFrame, kind: str = "action", size: str = "bytes") -> DataFrame:
    return sent.groupBy(kind).agg(F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes"))


def closed_by_backlog(sent: DataFrame, order: str, most: int = 32 << 20) -> DataFrame:
    """Viewers whose unsent bytes (bytes queued, bytes drained) at some time exceed the limit."""
    w = Window.partitionBy("viewer_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sent.withColumn("backlog", F.sum(F.col("bytes") - F.coalesce("drained", F.lit(0))).over(w)).groupBy("viewer_id").agg(F.max("backlog").alias("backlog")).where(F.col("backlog") > most)


def throttled(views: DataFrame, ms: str = "at_ms", gap: int = 100) -> DataFrame:
    """View messages that come at least `gap` after the last one that was accepted.

    After a pause of `gap` a message is accepted whatever came before, so a viewer's messages fall into bursts that are judged apart,
    many short ones together.
    """
    w = Window.partitionBy("viewer_id").orderBy(ms)
    pause = (F.col(ms) - F.lag(ms).over(w) >= gap).cast("int")
    bursts = views.withColumn("_p", F.coalesce(pause, F.lit(0))).withColumn("_burst", F.floor(F.sum("_p").over(w.rangeBetween(Window.unboundedPreceding, 0)) / 1024)).drop("_p")

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ms, kind="stable")
        at, keep, k = part[ms].to_numpy(), [], 0
        while k < len(at):
            keep.append(k)
            k = max(int(np.searchsorted(at, at[k] + gap)), k + 1)
        return part.iloc[keep]

    return bursts.groupBy("viewer_id", "_burst").applyInPandas(judge, bursts.schema).drop("_burst")


def view_reason() -> Column:
    """Why a viewer_view message is refused: over position, forward, up, viewport_px (arrays), fov_y_rad, near_m, far_m, min_hits, min_ratio, overlay_max_points."""
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    vector = lambda c, n: (F.size(c) == n) & F.forall(c, ok)
    some = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda t, v: t + v * v)) >= 1e-9
    whole = lambda c: c == F.floor(c)
    hits, ratio, cap = (F.coalesce(F.col(c).cast("double"), F.lit(d)) for c, d in (("min_hits", 1.0), ("min_ratio", 0.0), ("overlay_max_points", 0.0)))
    return first_reason(
        ("bad vectors", vector(F.col("position"), 3) & vector(F.col("forward"), 3) & vector(F.col("up"), 3)), ("bad viewport", vector(F.col("viewport_px"), 2)),
        ("bad numbers", ok(F.col("fov_y_rad")) & ok(F.col("near_m")) & ok(F.col("far_m"))), ("zero vectors", some("forward") & some("up")),
        ("out of bounds", (F.get("viewport_px", F.lit(0)) > 0) & (F.get("viewport_px", F.lit(1)) > 0) & (F.col("fov_y_rad") > 0) & (F.col("fov_y_rad") < math.pi) & (F.col("near_m") > 0) & (F.col("far_m") > F.col("near_m"))),
        ("bad overlay cap", ok(cap) & whole(cap) & cap.between(0, 10_000_000)), ("bad hits", ok(hits) & whole(hits) & hits.between(1, 1_000_000)), ("bad ratio", ok(ratio) & ratio.between(0, 1)),
    )


def sweep(dirty: DataFrame, budget: int = 8) -> DataFrame:
    """Adds tick: in which step of a checkpoint each dirty chunk is written, `budget` a step over all sessions, a session's newest first.

    Places inside a session come from a window of its own; sessions have one row each before they are put in a row.
    """
    inside = dirty.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last_seq"), "cx", "cy", "cz")) - 1)
    sizes = dirty.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(before, "session_id").withColumn("tick", F.floor((F.col("_before") + F.col("_k")) / budget).cast("bigint")).drop("_k", "_before")


def log_summary(batches: DataFrame, dirty: DataFrame, swept: int, budget: int = 8, stride: int = 18) -> DataFrame:
    """Of each session: log bytes, dirty chunks, and how many of them are still to be written after `swept` steps."""
    a = batches.groupBy("session_id").agg(F.sum(F.col("point_count") * stride).alias("log_bytes"), F.max("sequence").alias("last_sequence"))
    b = sweep(dirty, budget).groupBy("session_id").agg(F.count(F.lit(1)).alias("dirty_chunks"), F.sum((F.col("tick") >= swept).cast("bigint")).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "session_id", "left").select("session_id", "log_bytes", "last_sequence", zero("dirty_chunks"), zero("pending"))


PIECES = 256  # ranges of values that percentiles are looked for in


def percentiles(rows: DataFrame, value: str, shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Values at index floor(n * share) of the sorted values that aren't null, and the greatest; exact.

    Equal values are counted first. Approximate quantiles cut the rest into ranges, whose counts say which hold a wanted index; only
    those and the last are ranked, each in a task of its own.
    """
    groups = rows.select(F.col(value).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    cuts = groups.agg(F.percentile_approx("v", [k / PIECES for k in range(1, PIECES)], 10_000))
    dealt = groups.withColumn("cuts", cuts.scalar()).withColumn("piece", F.size(F.filter("cuts", lambda cut: cut <= F.col("v")))).drop("cuts")
    whole = Window.partitionBy()  # of PIECES rows at most, here and below
    counts = dealt.groupBy("piece").agg(F.sum("c").alias("k")).withColumn("n", F.sum("k").over(whole))
    starts = counts.withColumn("start", F.sum("k").over(whole.orderBy("piece")) - F.col("k"))
    end, wanted = F.col("start") + F.col("k"), [F.floor(F.col("n") * s) for s in shares]
    held = starts.where(reduce(operator.or_, [(F.col("start") <= i) & (end > i) for i in wanted], end == F.col("n"))).drop("k")
    ranked = dealt.join(F.broadcast(held), "piece").withColumn("upto", F.col("start") + F.sum("c").over(Window.partitionBy("piece").orderBy("v")))
    return ranked.agg(*[F.min(F.when(F.col("upto") > i, F.col("v"))).alias(f"p{int(s * 100)}") for s, i in zip(shares, wanted, strict=True)], F.max("v").alias("max"))
