"""Bronze and gold tables as Parquet: append-only batches, gold replaced by hash bucket of the chunk, and their listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fusion import CHUNK

BUCKETS = 64


def append_batches(batches: DataFrame, path: str) -> None:
    """Bronze: never rewritten, one folder for each session."""
    batches.write.mode("append").partitionBy("session_id").parquet(path)


def chunk_bucket(n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*CHUNK), F.lit(n)).cast("int")


def write_gold(table: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Gold rows clustered by chunk, so that file statistics prune a read by chunk."""
    table.withColumn("bucket", chunk_bucket(buckets)).repartition("bucket").sortWithinPartitions(*CHUNK).write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_chunks(spark: SparkSession, path: str, changed: DataFrame, chunks: DataFrame, buckets: int = BUCKETS) -> None:
    """Puts new rows of the given chunks in place of old ones; only their buckets are rewritten."""
    touched = chunks.select(*CHUNK).distinct().withColumn("bucket", chunk_bucket(buckets))
    old = spark.read.parquet(path)
    numbers = [r.bucket for r in touched.select("bucket").distinct().collect()]  # `buckets` at most
    stays = old.where(F.col("bucket").isin(numbers)).join(touched.select(*CHUNK), CHUNK, "left_anti")
    out = stays.unionByName(changed.withColumn("bucket", chunk_bucket(buckets)).select(*old.columns)).persist()
    out.count()  # read before its files are replaced
    out.repartition("bucket").sortWithinPartitions(*CHUNK).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    out.unpersist()


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def sessions_listing(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("started_at", "session_id")


def chunks_listing(chunks: DataFrame, session_id: str) -> DataFrame:
    return chunks.where(F.col("session_id") == session_id).orderBy("cx", "cy", "cz")


def batches_listing(batches: DataFrame, session_id: str) -> DataFrame:
    return batches.where(F.col("session_id") == session_id).orderBy("sequence")


def storage_summary(sessions: DataFrame, chunks: DataFrame, batches: DataFrame) -> DataFrame:
    a = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    b = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"))
    c = batches.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("log_bytes"))
    return a.join(b, how="cross").join(c, how="cross")  # three single rows


def logs_without_session(logs: DataFrame, sessions: DataFrame) -> DataFrame:
    return logs.select("session_id").distinct().join(sessions.select("session_id"), "session_id", "left_anti")


def index_conflicts(index: DataFrame, log: DataFrame) -> DataFrame:
    """Index rows that don't agree with the record at their offset."""
    r = log.select(F.col("session_id").alias("of_session"), F.col("sequence").alias("of_sequence"), "log_offset")
    return index.join(r, "log_offset", "left").where(~(F.col("session_id").eqNullSafe(F.col("of_session")) & F.col("sequence").eqNullSafe(F.col("of_sequence"))))


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.current_timestamp().alias("at"))
