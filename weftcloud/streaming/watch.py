"""Alignment that follows a session: new batches extend the keyframes, and the graph is solved again only when a loop closes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import alignment
from ..operators.alignment import Config


class Follower:
    """State in a shared folder: batches seen, keyframes, sampled clouds, accepted loops. Only batches above the last are taken, so a
    retried micro-batch adds nothing."""

    def __init__(self, spark: SparkSession, folder: str, cfg: Config = Config()):
        self.spark, self.folder, self.cfg = spark, folder, cfg

    def table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def _add(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/step={number}")

    def extend(self, batches: DataFrame, points: DataFrame, number: int) -> int:
        """Takes new batches with their points; the number of loops that they close."""
        known = self.table("keyframes")
        known = None if known is None else known.where(f"step < {number}").drop("step")
        fresh = alignment.keyframes(batches, self.cfg) if known is None else alignment.more_keyframes(batches, known, self.cfg)
        self._add(batches, "batches", number)
        self._add(fresh, "keyframes", number)
        new = self.table("keyframes").where(f"step = {number}").drop("step")
        self._add(alignment.clouds(points, new, self.cfg), "clouds", number)
        every = self.table("keyframes").where(f"step <= {number}").drop("step")
        sources = new.select("session_id", new["kf"].alias("source"))
        candidates = alignment.loop_candidates(every, self.cfg).join(sources, ["session_id", "source"], "left_semi")
        self._add(alignment.verified_loops(candidates, every, self.table("clouds").drop("step"), self.cfg), "loops", number)
        return self.table("loops").where(f"step = {number}").count()

    def result(self) -> alignment.Aligned:
        """Corrections from everything seen so far; the same as aligning it all at once."""
        kfs, loops, batches = (self.table(n).drop("step") for n in ("keyframes", "loops", "batches"))
        corrected = alignment.optimised(kfs, loops)
        return alignment.Aligned(kfs, loops, corrected, *alignment.propagated(batches, kfs, corrected))


def watch(batches: DataFrame, points_of: Callable[[DataFrame], DataFrame], follower: Follower, checkpoint: str, install: Callable[[alignment.Aligned], None]) -> StreamingQuery:
    """Follows a stream of batches until it is drained; installs corrections whenever a micro-batch closes a loop."""

    def step(part: DataFrame, number: int) -> None:
        part = part.persist()
        if not part.isEmpty() and follower.extend(part, points_of(part), number):
            install(follower.result())
        part.unpersist()

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
