"""Pose corrections over the untouched log, and incremental recomputation of what they move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import compose, moved
from . import fusion
from .fusion import CHUNK
from .sessions import checked_pose

DOCUMENT = "session_id string, generated_at string, poses array<struct<pose_sequence:bigint,pose:struct<translation_m:array<double>,rotation_xyzw:array<double>>>>, tail struct<translation_m:array<double>,rotation_xyzw:array<double>>, metadata map<string,string>"


def _pose(p: Column) -> Column:
    t, q = p["translation_m"], p["rotation_xyzw"]
    return F.struct(*[F.get(t, F.lit(k)).alias(n) for k, n in enumerate(("tx", "ty", "tz"))], *[F.get(q, F.lit(k)).alias(n) for k, n in enumerate(("qx", "qy", "qz", "qw"))])


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(poses, tails) of correction documents."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    poses = docs.select("session_id", F.explode("poses").alias("p")).select("session_id", F.col("p.pose_sequence").alias("pose_sequence"), _pose(F.col("p.pose")).alias("corrected"))
    return poses, docs.where("tail is not null").select("session_id", _pose(F.col("tail")).alias("tail"))


def problems(poses: DataFrame) -> DataFrame:
    """Why a set of corrections can't be installed: repeated or non-positive pose sequences, poses that aren't rigid."""
    twice = poses.groupBy("session_id", "pose_sequence").count().where("count > 1").select("session_id", "pose_sequence", F.lit("pose sequence occurs twice").alias("reason"))
    low = poses.where(~(F.col("pose_sequence") > 0)).select("session_id", "pose_sequence", F.lit("bad pose sequence").alias("reason"))
    bad = poses.withColumn("reason", checked_pose(F.col("corrected"))[0]).where("reason is not null").select("session_id", "pose_sequence", "reason")
    return twice.union(low).union(bad)


def effective(batches: DataFrame, poses: DataFrame, tails: DataFrame) -> DataFrame:
    """Adds effective: the correction of the batch's pose, else the tail after the logged pose past the last correction, else the logged pose.

    A tail without any corrected pose applies to everything.
    """
    last = poses.groupBy("session_id").agg(F.max("pose_sequence").alias("last_corrected"))
    j = batches.join(poses.select("session_id", "pose_sequence", "corrected"), ["session_id", "pose_sequence"], "left").join(tails, "session_id", "left").join(last, "session_id", "left")
    after = F.col("tail").isNotNull() & (F.col("pose_sequence") > F.coalesce("last_corrected", F.lit(-1)))
    out = F.when(F.col("corrected").isNotNull(), F.col("corrected")).when(after, compose(F.col("tail"), F.col("pose"))).otherwise(F.col("pose"))
    return j.withColumn("effective", out).drop("corrected", "tail", "last_corrected")


def to_json(poses: DataFrame, tails: DataFrame, **metadata: str) -> DataFrame:
    """(session_id, document): corrections with their provenance as JSON."""
    doc = lambda p: F.struct(F.array(*[p[k] for k in ("tx", "ty", "tz")]).alias("translation_m"), F.array(*[p[k] for k in ("qx", "qy", "qz", "qw")]).alias("rotation_xyzw"))
    rows = poses.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pose_sequence", doc(F.col("corrected")).alias("pose")))).alias("poses"))
    meta = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
    j = rows.join(tails.select("session_id", doc(F.col("tail")).alias("tail")), "session_id", "left")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return j.select("session_id", F.to_json(F.struct("session_id", stamp.alias("generated_at"), "poses", "tail", meta.alias("metadata"))).alias("document"))


def changed(batches: DataFrame, tolerance: float, before: str = "fused", after: str = "effective", reach: float = 25.0) -> DataFrame:
    """Batches whose pose moved by more than the tolerance since they were fused."""
    return batches.where(moved(F.col(before), F.col(after), tolerance, reach))


def mode(indexed: int, moved_batches: int) -> str:
    """full without an index or if more than half moved; else partial or unchanged."""
    if indexed == 0:
        return "full"
    if moved_batches == 0:
        return "unchanged"
    return "full" if 2 * moved_batches > indexed else "partial"


def affected_chunks(old_span: DataFrame, new_span: DataFrame) -> DataFrame:
    """Chunks that moved batches used to touch or touch now."""
    return old_span.select(*CHUNK).union(new_span.select(*CHUNK)).distinct()


def replay_set(lineage: DataFrame, affected: DataFrame, moved_batches: DataFrame) -> DataFrame:
    """Batches to fuse again: those that span an affected chunk, and those that moved."""
    spanning = lineage.join(affected, CHUNK, "left_semi").select("session_id", "sequence")
    return spanning.union(moved_batches.select("session_id", "sequence")).distinct()


@dataclass
class Rebuilt:
    mode: str
    voxels: DataFrame
    lineage: DataFrame
    chunks: DataFrame | None = None
    batches: DataFrame | None = None


def rebuild(points: DataFrame, batches: DataFrame, voxels: DataFrame, lineage: DataFrame, chunk: float, fuse: float, tolerance: float | None = None) -> Rebuilt:
    """Brings fused voxels up to date with effective poses.

    points: sensor-frame points (session_id, sequence, pose_sequence, idx, ...); batches: (session_id, sequence, fused, effective).
    A partial rebuild fuses affected chunks only, from all batches that span them, and leaves other rows as they are.
    """
    tolerance = fuse / 2 if tolerance is None else tolerance
    moved_ = changed(batches, tolerance)
    which = mode(batches.where("fused is not null").count(), moved_.count())
    if which == "unchanged":
        return Rebuilt(which, voxels, lineage)
    if which == "full":
        now = fusion.placed(points.join(batches.select("session_id", "sequence", F.col("effective").alias("pose")), ["session_id", "sequence"]), chunk, fuse)
        return Rebuilt(which, fusion.fuse(now), fusion.touched(now))
    # batches below the tolerance keep the pose that they were fused with
    pose = F.when(moved(F.col("fused"), F.col("effective"), tolerance), F.col("effective")).otherwise(F.col("fused")).alias("pose")
    posed = batches.select("session_id", "sequence", pose)
    key = ["session_id", "sequence"]
    new_span = fusion.touched(fusion.placed(points.join(moved_.select(*key), key, "left_semi").join(posed, key), chunk, fuse))
    old_span = lineage.join(moved_.select(*key), key, "left_semi")
    affected = affected_chunks(old_span, new_span)
    replay = replay_set(lineage, affected, moved_)
    again = fusion.only_chunks(fusion.placed(points.join(replay, key, "left_semi").join(posed, key), chunk, fuse), affected)
    kept = voxels.join(affected, CHUNK, "left_anti")
    new_lineage = lineage.join(affected, CHUNK, "left_anti").unionByName(fusion.touched(again))
    return Rebuilt(which, kept.unionByName(fusion.fuse(again)), new_lineage, affected, replay)


def install(spark: SparkSession, document: str, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(poses, tails) of one correction document given as JSON text; raises if it has problems."""
    doc = spark.createDataFrame([(document,)], "j string").select(F.from_json("j", DOCUMENT).alias("d")).select("d.*").where(F.col("session_id") == session_id)
    poses = doc.select("session_id", F.explode("poses").alias("p")).select("session_id", F.col("p.pose_sequence").alias("pose_sequence"), _pose(F.col("p.pose")).alias("corrected"))
    if bad := problems(poses).take(3):
        raise ValueError("; ".join(f"pose {r.pose_sequence}: {r.reason}" for r in bad))
    return poses, doc.where("tail is not null").select("session_id", _pose(F.col("tail")).alias("tail"))


def counter_changes(counters: DataFrame) -> DataFrame:
    """Of chunks that aren't rebuilt: their counter with views lost and won by moved batches (never below 0).

    counters: chunk, opportunities, and before, after: how many batches qualify under the old and the new pose. Batches that qualify under
    both cancel, so the views won less those lost are the difference of the two numbers.
    """
    return counters.withColumn("opportunities", F.greatest(F.col("opportunities") + F.col("after") - F.col("before"), F.lit(0))).drop("before", "after")
