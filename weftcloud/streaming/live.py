"""Live ingest on Structured Streaming: fused sums are merged by micro-batch, and redelivery changes nothing.

Fusion is associative, so each micro-batch only needs its own partial sums; they are appended with their
micro-batch id and added up on read, or compacted. A micro-batch that is retried writes to the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fusion


def read_batches(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 32) -> DataFrame:
    """Tails a folder of bronze files; offsets live in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(points: DataFrame, out: str, checkpoint: str, chunk: float, fuse: float, interval: str | None = None, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """points: a stream with pose; writes partial sums and lineage. Without an interval it drains what is there and stops."""

    def step(part: DataFrame, number: int) -> None:
        placed = fusion.placed(part, chunk, fuse).persist()
        fusion.fuse(placed).write.mode("overwrite").parquet(f"{out}/voxels/micro_batch={number}")
        fusion.touched(placed).write.mode("overwrite").parquet(f"{out}/lineage/micro_batch={number}")
        if also:
            also(placed, number)
        placed.unpersist()

    writer = points.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def fused_so_far(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.parquet(f"{out}/voxels")
    return parts.groupBy(*fusion.VOXEL).agg(
        *[F.sum(s).alias(s) for s in fusion.SUMS], F.sum("n").alias("n"), F.min(F.struct("first_seq", "first_idx")).alias("first"), F.max("last_seq").alias("last_seq")
    ).select(*fusion.VOXEL, *fusion.SUMS, "n", F.col("first.first_seq").alias("first_seq"), F.col("first.first_idx").alias("first_idx"), "last_seq")


def compact(spark: SparkSession, out: str, to: str) -> None:
    fused_so_far(spark, out).write.mode("overwrite").parquet(to)


def dirty_chunks(spark: SparkSession, out: str, since: int) -> DataFrame:
    """Chunks touched by micro-batches after `since`."""
    return spark.read.parquet(f"{out}/lineage").where(F.col("micro_batch") > since).select(*fusion.CHUNK).distinct()


def monotone_stream(rows: DataFrame, columns: str) -> DataFrame:
    """Drops rows whose sequence isn't above all before it in its session; the state is one number for each session.

    columns: the schema of rows, with session_id and sequence; rows of a micro-batch are taken by arrival.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else 0
        every = pd.concat(list(parts)).sort_values("arrival", kind="stable")
        before = every["sequence"].cummax().shift(fill_value=top).clip(lower=top)
        state.update((int(max(top, every["sequence"].max())),))
        yield every[every["sequence"] > before]

    return rows.groupBy("session_id").applyInPandasWithState(keep, columns, "top bigint", "append", GroupStateTimeout.NoTimeout)


def point_rate(stream: DataFrame, ts: str = "ts", count: str = "point_count", width: str = "1 second") -> DataFrame:
    return stream.groupBy(F.window(ts, width).alias("w")).agg(F.sum(count).alias("points")).select(F.col("w.start").alias("start"), "points")


def newest_points(points: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The newest rows of a ring of that size."""
    return points.orderBy(F.desc("sequence"), F.desc("idx")).limit(most)


def packet_batches(packets: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    """Numbers count windows of packets."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    return packets.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
