"""Exact dedup through an extendible-hash index on shared files (DataFrame functions only).

Every text is hashed to 64 bits; an index entry is a distinct hash with how often it occurs and which row with it is the greatest.
Entries lie in bucket files in the shared folder, dealt out by their leading bits, sorted, so that a task that reads them owns a
range of keys. A bucket with more than its capacity of entries is split: the directory doubles, and the bucket's entries are
written anew by one more bit, until no bucket is overfull. A bucket of local depth d stands in 2^(D-d) cells of the
directory of depth D. To look a row up, the leading D bits of its hash are its cell, the cell names the bucket, and the bucket has the entry.

An entry is a chain of the texts that have its hash, told apart by their bytes (they are the key of an aggregation, which
combines on the map side, so a group that holds a third of all rows reaches its owner as a few texts). Where a chain holds one text, which it
does unless two texts share 64 bits, its rows need no further look; rows of any other find theirs by the bytes again. Rows meet their
entries in joins that adaptive execution can split.

Defined cases: null text counts as empty. Of equal texts the row with the largest doc_id stays; null doc_ids come last and
of rows that repeat the largest doc_id exactly one stays. An empty table gives no rows. Other columns are untouched,
whatever their names.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from .store import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CAPACITY = 1 << 16
SMALL_DIRECTORY = 1 << 16  # cells that are broadcast, at most


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def leading(h: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


class Index:
    """entries: all columns given and depth, bucket; buckets: (depth, bucket) of each bucket; depth: of the directory."""

    def __init__(self, entries: DataFrame, buckets: DataFrame, depth: int):
        self.entries, self.buckets, self.depth = entries, buckets, depth

    @classmethod
    def build(cls, entries: DataFrame, rows: int, capacity: int = CAPACITY) -> Index:
        """entries: distinct hashes h and what belongs to them; rows: how many there are at most."""
        depth = max(math.ceil(math.log2(max(rows, 1) / capacity)), 0)
        # sorted ranges of keys in each file
        now = written(entries.withColumns({"depth": F.lit(depth), "bucket": leading("h", depth)}).repartitionByRange("bucket", "h"), "buckets")
        parts, names = [], []
        while True:
            load = written(now.groupBy("depth", "bucket").agg(F.count(F.lit(1)).alias("load")), "load")
            overfull = load.where(F.col("load") > capacity).select("bucket") if depth < 64 else load.where("false").select("bucket")
            names.append(load.where(F.col("load") <= capacity).select("depth", "bucket") if depth < 64 else load.select("depth", "bucket"))
            if overfull.isEmpty():
                parts.append(now)
                break
            parts.append(now.join(overfull, "bucket", "left_anti").select(now.columns))
            depth += 1
            split = now.join(overfull, "bucket", "left_semi").select(now.columns)
            now = written(split.withColumns({"depth": F.lit(depth), "bucket": leading("h", depth)}).repartitionByRange("bucket", "h"), "buckets")
        whole, all_names = parts[0], names[0]
        for p, n in zip(parts[1:], names[1:], strict=True):
            whole, all_names = whole.unionByName(p), all_names.unionByName(n)
        return cls(whole, all_names, depth)

    def directory(self) -> DataFrame:
        """(cell, depth, bucket) of all cells that have entries."""
        span = F.expr(f"shiftleft(1L, cast({self.depth} - depth as int))")  # cells of one bucket
        return self.buckets.select(F.explode(F.sequence(F.col("bucket") * span, (F.col("bucket") + 1) * span - 1)).alias("cell"), "depth", "bucket")

    def placed(self, keys: DataFrame) -> DataFrame:
        """keys (with h) and the bucket of their cell."""
        directory = self.directory().select("cell", "bucket")
        if 1 << self.depth <= SMALL_DIRECTORY:
            directory = F.broadcast(directory)
        return keys.withColumn("cell", leading("h", self.depth)).join(directory, "cell").drop("cell")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, uid, keep_id, group_size, kept, sha, bucket; row_col: a long that tells rows of a stored table apart."""
    order = F.coalesce("doc_id", F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(Decimal(10) ** 19) + F.col("uid").cast("decimal(19,0)")
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("norm"), (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("uid"))
    picked = picked.withColumn("h", F.xxhash64("norm"))
    if row_col:
        records, texts = written(picked.drop("norm").withColumn("sha", F.lit(None).cast("binary")), "records"), picked
    else:
        records = texts = written(picked.withColumn("sha", F.unhex(F.sha2("norm", 256))), "records")
    entries = records.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("first"), F.max("doc_id").alias("top_id"))
    index = Index.build(entries, records.count(), capacity)
    # the texts of each entry, told apart by their bytes
    chains = index.placed(texts.select("h", "norm", "doc_id", "uid")).groupBy("bucket", "h", "norm").agg(F.max(order).alias("top"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    forked = written(chains.select("bucket", "h"), "chains").groupBy("bucket", "h").count().where("count > 1").select("bucket", "h")
    some = not forked.isEmpty()
    # without forks a plain join of stored tables, which adaptive execution can split
    plain = index.entries.join(forked, ["bucket", "h"], "left_anti") if some else index.entries
    whole = plain.select("bucket", "h", F.col("first").alias("top"), F.col("top_id").alias("keep_id"), F.col("n").alias("size"))
    found = [index.placed(records.select("doc_id", "uid", "h", "sha")).join(whole, ["bucket", "h"])]
    if some:
        by_bytes = chains.join(forked, ["bucket", "h"], "left_semi")
        found.append(index.placed(texts.select("doc_id", "uid", "h", "norm")).join(by_bytes, ["bucket", "h", "norm"]).withColumn("sha", F.unhex(F.sha2("norm", 256))))
    out = [r.select("doc_id", "uid", "keep_id", F.col("size").alias("group_size"), (order == F.col("top")).alias("kept"), "sha", "bucket") for r in found]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns of docs."""
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    keyed = rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"), "rid")
    kept = exact_groups(keyed, row_col="rid").where("kept").select(F.col("uid").alias("rid"))
    return rows.join(kept, "rid").select("row.*")
