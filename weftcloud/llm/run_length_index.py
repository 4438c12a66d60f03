"""Removal of repeated long strings through a run-length compressed Burrows-Wheeler index.

Which strings can repeat is found first, exactly: of the grams (40 bytes) in each 200-byte window the one of least hash is
the window's anchor, so equal windows have equal anchors, wherever they stand. Consecutive windows with one anchor make a
segment. Anchors are counted with a map-side combine, so copies fold into a number at once.
- An anchor of a single segment shares no window with anything; it is left out from there on.
- A segment that occurs twice repeats as a whole.
- Where several different segments share an anchor, one of each goes to the index: their text is sorted into a Burrows-Wheeler
  transform, of which only runs are kept, with samples (text position, common prefix with the neighbour) at run ends. Inside a run the
  common prefix falls by one for each step in the text, so streaming along the text from sample to sample gives the matching
  statistics of every position; those of 200 and more mark windows.
- An anchor with more than HOT different segments is split: the windows of its segments get new anchors of longer grams, and so on
  up to grams of length - 1 bytes, around which at most 65,536 different segments exist. So every mark comes from an index, and no
  index takes more segments than that.

Defined cases: null text is empty; texts of fewer than `length` bytes repeat nothing; overlapping occurrences inside one text count;
repeated rows are occurrences of each other and each keep a result, as do rows with a null doc_id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import dropped, ship, written
from .suffix_array import common_prefixes, sort_suffixes

LENGTH, GRAM, HOT, INDEX_BYTES, BLOCK = 200, 40, 4096, 1 << 20, 1 << 18


def gram_sizes(length: int, gram: int) -> list[int]:
    """Of the anchors at each further split; the last leaves one byte of a window open."""
    return sorted({g for g in (gram, length * 3 // 5, length * 9 // 10, length - 1) if gram <= g < length})


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(row, first window, bytes, anchor hash, segment hash) of the segments of a block of texts."""
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n, width = len(buf) - gram + 1, length - gram + 1
    if len(buf) < length:
        return empty
    grams = tk.Grams(buf, 2 * length)
    h = grams.every(gram)
    bits = np.uint64(24)  # the leftmost of those whose leading bits are least
    value = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = value
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - width + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(buf) + 1, np.int64)  # windows that lie in one row
    long_rows = np.diff(off) >= length
    np.add.at(inside, off[:-1][long_rows], 1)
    np.add.at(inside, off[1:][long_rows] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside)[:windows] > 0)
    if not len(s):
        return empty
    w = where[s]
    new = np.ones(len(s), bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)
    first = s[new]
    last = s[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
    row = np.searchsorted(off, first, "right") - 1
    # adjacent rows: a run of windows may not pass from one to the next
    end = last + length
    return row, first - off[row], end - first, h[w[new]], grams.spans(first, end)


def pieces(col: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in that row, bytes, offsets): blocks of rows, and parts of long rows that share length - 1 bytes."""
    for i, _, buf, off in tk.text_blocks(col, BLOCK):
        if len(buf) <= 2 * BLOCK:
            yield i, 0, buf, off
        else:  # one row
            for a in range(0, len(buf) - length + 1, BLOCK):
                part = buf[a : a + BLOCK + length - 1]
                yield i, a, part, np.array([0, len(part)])


ANCHORS = "id long, th long, at int, size int, ah long, sk long"


def anchor_table(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, from_, buf, off in pieces(batch.column(2), length):
                row, at, size, ah, sk = anchors(buf, off, length, gram)
                yield pa.record_batch([pa.array(ids[i + row]), pa.array(ths[i + row]), pa.array((from_ + at).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(ah.view(np.int64)), pa.array(sk.view(np.int64))], names=["id", "th", "at", "size", "ah", "sk"])
        tk.give_back()

    return texts.select("id", "th", "text").mapInArrow(run, ANCHORS)


class RunLengthIndex:
    """Text as runs of its Burrows-Wheeler transform with samples at both ends of each run."""

    def __init__(self, seq: np.ndarray, depth: int):
        order, levels = sort_suffixes(seq, int(seq.max()) + 1, depth)
        n = self.size = len(seq)
        before = np.where(order > 0, seq[order - 1], -1)
        change = np.ones(n + 1, bool)
        np.not_equal(before[1:], before[:-1], out=change[1:n])
        heads, tails = np.flatnonzero(change[:n]), np.flatnonzero(change[1:])
        self.run_symbols, self.run_starts = before[heads], heads
        self.head_at, self.tail_at = order[heads], order[tails]
        up, down = heads > 0, tails < n - 1
        self.head_match, self.tail_match = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        self.head_match[up] = common_prefixes(levels, order[heads[up]], order[heads[up] - 1])
        self.tail_match[down] = common_prefixes(levels, order[tails[down]], order[tails[down] + 1])

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts anywhere else, streamed from the samples at run ends."""
        at = np.arange(self.size)
        out = np.zeros(self.size, np.int64)
        for where, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            reach, from_ = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
            reach[where] = where + match
            from_[where] = where
            np.maximum.accumulate(from_, out=from_)
            np.maximum(out, reach[from_] - at, out=out)
        return out


def window_marks(segments: list[bytes], length: int) -> list[list[int]]:
    """For each segment the merged ranges [from, to, ...] covered by strings of `length` that start elsewhere in the segments."""
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    seq = np.empty(int((sizes + 1).sum()), np.int64)
    seq[starts + sizes] = 257 + np.arange(len(segments))  # separators that match nothing, so no match passes a segment's end
    seq[tk.ragged(starts, sizes)] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    long_ = RunLengthIndex(seq, int(sizes.max()) + 1).matching_statistics() >= length
    out = []
    for a, n in zip(starts, sizes, strict=True):
        out.append(ranges(np.flatnonzero(long_[a : a + n - length + 1]), length))
    return out


def ranges(starts: np.ndarray, length: int) -> list[int]:
    """Merged [from, to, ...] of the windows at sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length], axis=1).reshape(-1).tolist()


def cut_segments(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(ah, sk, seg) of wanted (id, th, at, size, ah, sk), read from the texts."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "size", "ah", "sk")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(0))
            want = batch.column(1)
            w = want.flatten()
            at, size = (w.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(want)))
            for a in range(0, len(at), 20_000):
                part = slice(a, a + 20_000)
                data = buf[tk.ragged(off[row[part]] + at[part], size[part])]
                yield pa.record_batch([w.field(2)[part], w.field(3)[part], tk.binary_rows(data, np.concatenate([[0], np.cumsum(size[part])]))], names=["ah", "sk", "seg"])

    joined = texts.join(lists, ["id", "th"]).select("text", "want").mapInArrow(run, "ah long, sk long, seg binary")
    return joined


MARKS = "ah long, sk long, marks array<int>"


def indexed_marks(segments: DataFrame, length: int) -> DataFrame:
    """Marks of the segments (ah, sk, seg); all segments of an anchor come to one index, many anchors share one."""

    def done(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        marks = window_marks([r[2] for r in rows], length)
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=["ah", "sk", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if size > INDEX_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield done(held)

    return segments.repartition("ah").sortWithinPartitions("ah").mapInArrow(run, MARKS)


def repeated_marks(texts: DataFrame, length: int = LENGTH, grams: list[int] | None = None, hot: int = HOT) -> DataFrame:
    """(id, th, marks): ranges of bytes to remove, per text that has some; texts: (id, th, text), each pair once."""
    gram, *longer = grams or gram_sizes(length, GRAM)
    table = written(anchor_table(texts, length, gram), "anchors")
    shared = table.groupBy("ah").agg(F.count(F.lit(1)).alias("n"), F.min("sk").alias("x"), F.max("sk").alias("y")).where("n > 1").select("ah", (F.col("x") == F.col("y")).alias("alike"))
    shared = written(shared, "shared")
    found = written(table.join(shared, "ah").select("id", "th", "at", "size", "ah", "sk", "alike"), "found")
    dropped(table, shared)
    order, place = F.xxhash64("id", "th", "at"), F.col("at").cast("long") * 65536 + F.col("size")
    kinds = written(
        found.where("not alike").groupBy("ah", "sk").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", order).alias("id"), F.min_by("th", order).alias("th"), F.min_by(place, order).alias("place")),
        "kinds",
    )
    several = written(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")), "several")
    # one occurrence of each different segment that another may share a window with; of those that occur twice too, as witnesses
    one = written(kinds.join(several, "ah").select("id", "th", F.shiftright("place", 16).cast("int").alias("at"), F.expr("cast(place & 65535 as int)").alias("size"), "ah", "sk", "n", "kinds"), "one")
    segments = written(cut_segments(one.select("id", "th", "at", "size", "ah", "sk"), texts), "segments")
    of_kind = one.select("ah", "sk", "n", "kinds")
    limit = hot if longer else 1 << 62
    few, many = (segments.join(of_kind.where(c).select("ah", "sk"), ["ah", "sk"], "left_semi") for c in (F.col("kinds") <= limit, F.col("kinds") > limit))
    marks = indexed_marks(few, length)
    done = [several, one, segments, kinds, found]
    if not several.where(F.col("kinds") > limit).isEmpty():
        split = written(many.select(F.col("ah").alias("id"), F.col("sk").alias("th"), F.col("seg").alias("text")), "split")
        done.append(split)
        marks = marks.union(repeated_marks(split, length, longer, hot).select(F.col("id").alias("ah"), F.col("th").alias("sk"), "marks"))
    marks = marks.where(F.size("marks") > 0).join(of_kind.where("n > 1").select("ah", "sk"), ["ah", "sk"], "left_anti")
    whole = kinds.where("n > 1").select("ah", "sk", F.lit(None).cast("array<int>").alias("marks"))
    marks = written(whole.unionByName(marks.select("ah", "sk", "marks")), "marks")
    done.append(marks)
    itself = F.array(F.col("at"), F.col("at") + F.col("size"))
    spans = found.where("not alike").join(marks, ["ah", "sk"]).select("id", "th", F.when(F.col("marks").isNull(), itself).otherwise(F.transform("marks", lambda m: m + F.col("at"))).alias("m"))
    spans = found.where("alike").select("id", "th", itself.alias("m")).union(spans)
    out = written(spans, "spans").groupBy("id", "th").agg(F.flatten(F.collect_list("m")).alias("marks"))
    dropped(*done)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grams: list[int] | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256, for every row; grams: anchor sizes of each split, length - 1 the last."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("id"), F.lit(0).cast("long").alias("th"), text.alias("text"))
    texts = written(texts, "texts")  # row numbers must not change
    marks = repeated_marks(texts, length, grams, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(1))
            marks = batch.column(2).to_pylist()
            removed, spans, kept = [], [], []
            for k in range(batch.num_rows):
                data = buf[off[k] : off[k + 1]]
                if marks[k]:
                    m = np.array(marks[k], np.int64).reshape(-1, 2)
                    step = np.zeros(len(data) + 1, np.int64)
                    np.add.at(step, m[:, 0], 1)
                    np.add.at(step, m[:, 1], -1)
                    stay = np.cumsum(step[:-1]) == 0
                    removed.append(int(len(data) - stay.sum()))
                    spans.append(int((~stay[0:1]).sum() + (stay[:-1] & ~stay[1:]).sum()))
                    data = data[stay]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(data.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = texts.join(marks.select("id", "marks"), "id", "left").select("doc_id", "text", "marks")
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
