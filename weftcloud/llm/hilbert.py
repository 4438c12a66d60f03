"""Sharding along a Hilbert curve: quantise several metadata dimensions, sort by curve index, cut runs.

Each dimension becomes an integer of `bits` bits: numbers by their place on a log scale, strings by a hash. Rows sort by
curve index (ties: id, then a row number, so a crowded cell splits anywhere), and the sorted run is cut into shards of
equal row counts. Global ranks come from a range partitioning that is written once: counts of its
pieces (one row for each partition, not for each row) give offsets, and row numbers inside pieces add up.

Defined cases: a null dimension quantises to 0; null text has size 1 and crc32 0; equal curve indexes and repeated rows get
different slots; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from .store import written


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of an (n, d) array of integers below 2^bits."""
    x = np.array(axes, dtype=np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of each level, from the coarsest
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def quantised(col: Column, kind: str, bits: int) -> Column:
    top = (1 << bits) - 1
    if kind == "number":
        scaled = F.log2(F.greatest(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * (top / 40.0)
        return F.least(scaled.cast("int"), F.lit(top))
    return F.when(col.isNull(), 0).otherwise(F.pmod(F.xxhash64(col.cast("string")), F.lit(top + 1))).cast("int")


def hilbert_shards(docs: DataFrame, dims: list[tuple[str, str]], shards: int = 8, bits: int = 8, id_col: str = "doc_id", carry: list[Column] = ()) -> DataFrame:
    """doc_id, the carried columns, curve, shard and slot for every row; shards differ by one row at most.

    dims: (column, "number" or "string"), d * bits at most 62.
    """
    if not dims or len(dims) * bits > 62:
        raise ValueError("one dimension at least, and 62 bits in all at most")

    @pandas_udf("long")
    def index(axes: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.array(axes.to_list(), np.int64).reshape(len(axes), len(dims)), bits))

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *carry, F.array(*[quantised(F.col(f"`{c}`"), k, bits) for c, k in dims]).alias("axes"), F.monotonically_increasing_id().alias("uid"))
    keyed = written(keyed.withColumn("curve", index("axes")).drop("axes"), "curve")
    pieces = written(keyed.repartitionByRange(parts, "curve", "doc_id", "uid").withColumn("piece", F.spark_partition_id()), "pieces")
    sizes = pieces.groupBy("piece").count()
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition, `parts` at most
    starts = sizes.select(F.col("piece").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(Window.partitionBy()).alias("total"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("piece").orderBy("curve", "doc_id", "uid")) - 1
    ranked = pieces.join(F.broadcast(starts), F.col("piece") == F.col("p")).withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the least rank of a shard
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long")).drop("rank", "p", "start", "total", "piece", "uid")
