"""Rules for sessions, poses and batches: each check adds a reject reason, so rows split into accepted and rejected."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.formats import STRIDES

IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
MAX_POINTS, POSES_KEPT, NORM_SLACK = 1_000_000, 64, 0.05


def identifier_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def text_ok(c: Column, most: int = 256) -> Column:
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= most), F.lit(False))


def timestamp_ok(c: Column) -> Column:
    return F.try_to_timestamp(c).isNotNull()


def finite(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out &= F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first broken rule; rules are (reason, condition that must hold)."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules])


def checked_pose(pose: Column) -> tuple[Column, Column]:
    """(reason or null, pose with a unit quaternion): the norm may be off by 5 %."""
    q = [pose[k] for k in ("qx", "qy", "qz", "qw")]
    norm = F.sqrt(sum((v * v for v in q[1:]), q[0] * q[0]))
    reason = first_reason(("pose isn't finite", finite(*q, *[pose[k] for k in ("tx", "ty", "tz")])), ("quaternion isn't normalised", F.abs(norm - 1) <= NORM_SLACK))
    unit = F.struct(*[pose[k].alias(k) for k in ("tx", "ty", "tz")], *[(v / norm).alias(k) for v, k in zip(q, ("qx", "qy", "qz", "qw"), strict=True)])
    return reason, F.when(reason.isNull(), unit)


def batch_reason(max_points: int = MAX_POINTS) -> Column:
    """Over columns point_format, stride_bytes, point_count, payload_bytes, pose_sequence, encoding, compression."""
    stride = F.coalesce(*[F.when(F.col("point_format") == k, F.lit(v)) for k, v in STRIDES.items() if k != "q8_chunk_v2"])
    return first_reason(
        ("unknown point format", stride.isNotNull()), ("stride doesn't fit the format", F.col("stride_bytes") == stride), ("bad point count", F.col("point_count").between(0, max_points)),
        ("payload size doesn't fit", F.col("payload_bytes") == F.col("point_count") * F.col("stride_bytes")), ("bad pose sequence", F.col("pose_sequence") > 0),
        ("bad encoding", F.col("encoding") == "binary_le"), ("bad compression", F.col("compression") == "none"),
    )


def session_reason(known: Column | None = None) -> Column:
    """Over create_session messages, in the order in which a server looks; known: whether there is a session of that id already."""
    return first_reason(
        ("unsupported protocol version", F.col("protocol_version") == 1), ("units must be meters", F.col("units") == "meters"), ("bad session id", identifier_ok(F.col("session_id"))),
        ("bad publisher id", identifier_ok(F.col("publisher_id"))), ("bad frame id", text_ok(F.col("frame_id"), 128)), ("bad start time", timestamp_ok(F.col("started_at"))),
        ("session exists", F.lit(True) if known is None else ~known),
    )


def resume_reason() -> Column:
    """Over resume_session messages joined with their session: owner (null: no such session) and last_sequence."""
    top = F.col("last_client_sequence").cast("double")
    return first_reason(
        ("unsupported protocol version", F.col("protocol_version") == 1), ("bad session id", identifier_ok(F.col("session_id"))), ("bad publisher id", identifier_ok(F.col("publisher_id"))),
        ("bad last sequence", (top >= 0) & (top == F.floor(top))), ("unknown session", F.col("owner").isNotNull()), ("other publisher", F.col("owner") == F.col("publisher_id")), ("ahead of the server", top <= F.col("last_sequence")),
    )


def close_reason() -> Column:
    """Over close_session messages joined with their session: owner (null: no such session), closed and last_sequence."""
    return first_reason(
        ("unknown session", F.col("owner").isNotNull()), ("other publisher", F.col("owner") == F.col("publisher_id")), ("closed", ~F.col("closed")),
        ("bad sequence", F.col("sequence") > 0), ("out of sequence", F.col("sequence") == F.col("last_sequence") + 1),
    )


def split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def with_pose(batches: DataFrame, poses: DataFrame) -> DataFrame:
    return batches.join(poses, ["session_id", "pose_sequence"])


def without_pose(batches: DataFrame, poses: DataFrame) -> DataFrame:
    return batches.join(poses.select("session_id", "pose_sequence"), ["session_id", "pose_sequence"], "left_anti").withColumn("reason", F.lit("unknown pose"))


def strict_sequence(rows: DataFrame, key: str = "session_id", sequence: str = "sequence", order: str = "arrival") -> DataFrame:
    """(key, order, sequence, expected, in_order): poses and batches share one counter that starts at 1 and has no gaps.

    A row is accepted if it is one more than the last accepted row; rejected rows don't move the counter, so each verdict
    depends on all before it and a session is judged in order.
    """

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        last, expected = 0, []
        for n in part[sequence].tolist():
            expected.append(last + 1)
            last += n == last + 1
        return part.assign(expected=expected, in_order=part[sequence] == expected)

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, order, sequence))
    return rows.select(key, order, sequence).groupBy(key).applyInPandas(judge, f"{kept}, expected bigint, in_order boolean")


def monotone(rows: DataFrame, key: str = "session_id", sequence: str = "sequence", order: str = "arrival") -> DataFrame:
    """Keeps rows whose sequence is above all before them; gaps are fine (redelivery after a crash)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_top", F.coalesce(F.max(sequence).over(w), F.lit(0))).where(F.col(sequence) > F.col("_top")).drop("_top")


def newest_poses(poses: DataFrame, keep: int = POSES_KEPT) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("pose_sequence"))
    return poses.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def lifecycle(events: DataFrame, order: str = "arrival") -> DataFrame:
    """Judges create, resume, close and data messages (type, session_id, publisher_id, sequence) in order: `verdict` of each.

    The broker's inlet reopens an existing session of the same owner on create, and skips data before create.
    """
    w = Window.partitionBy("session_id").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.first(F.when(F.col("type") == "create_session", F.col("publisher_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.last(F.when(F.col("type").isin("create_session", "resume_session"), "open").when(F.col("type") == "close_session", "closed"), ignorenulls=True).over(before)
    top = F.coalesce(F.max(F.when(~F.col("type").isin("create_session", "resume_session"), F.col("sequence"))).over(before), F.lit(0))
    out = events.withColumns({"_owner": owner, "_state": state, "_top": top})
    verdict = (
        F.when(F.col("_owner").isNull(), "skipped: no session").when(F.col("_owner") != F.col("publisher_id"), "rejected: other publisher")
        .when(F.col("type") == "create_session", F.when(F.col("_state").isNull(), "created").otherwise("reopened"))
        .when((F.col("type") == "resume_session") & (F.col("sequence") > F.col("_top")), "rejected: ahead of the server").when(F.col("type") == "resume_session", "resumed")
        .when(F.col("_state") == "closed", "rejected: closed").when(F.col("type") == "close_session", "closed").otherwise("accepted")
    )
    return out.withColumn("verdict", verdict).drop("_owner", "_state", "_top")


def binding_conflicts(bindings: DataFrame) -> DataFrame:
    """Connections with several sessions, and sessions with several publishers (connection, session_id, publisher_id)."""
    a = bindings.groupBy("connection").agg(F.count_distinct("session_id").alias("n")).where("n > 1").select(F.lit("connection").alias("scope"), F.col("connection").alias("name"), "n")
    b = bindings.groupBy("session_id").agg(F.count_distinct("publisher_id").alias("n")).where("n > 1").select(F.lit("session").alias("scope"), F.col("session_id").alias("name"), "n")
    return a.union(b)


def counters(batches: DataFrame) -> DataFrame:
    """Of each session: batches, points, last sequence, pose of the last batch, last time seen."""
    return batches.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("point_batches"), F.sum("point_count").alias("total_points"), F.max("sequence").alias("last_sequence"), F.max_by("pose_sequence", "sequence").alias("last_pose_sequence"), F.max("ts").alias("last_seen")
    )


def restored(counted: DataFrame) -> DataFrame:
    """Sessions after a restart: counters stay, poses don't, so the next batch needs a fresh one."""
    return counted.withColumn("last_pose_sequence", F.lit(None).cast("bigint"))


def too_wide(cells: DataFrame, most: int = 128) -> DataFrame:
    """Batches (session_id, sequence) that touch more than `most` chunks."""
    return cells.groupBy("session_id", "sequence").agg(F.count_distinct("cx", "cy", "cz").alias("chunks")).where(F.col("chunks") > most)
