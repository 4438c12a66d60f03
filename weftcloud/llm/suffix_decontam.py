"""Benchmark decontamination with suffix arrays over the training words.

Each shard (a bounded run of documents) gets a suffix array over its word sequence: words become dense ids, ids pack into
64-bit keys, and ranks of packed keys are packed again until suffixes are ordered by at least `window` words. Every suffix of every
benchmark item is binary-searched in every shard, narrowing its interval word by word; the interval at the window's length holds all
locations of that window. A location whose words before differ from the item's is where a longest match starts; it is extended
word by word. Equal items are one, equal windows mark their locations once. Training text is read where it lies, nothing is shuffled.

The benchmark is a stated query set, worked through in blocks of bounded bytes: one block is on the driver and in the tasks at a time,
one pass over the documents for each, so memory doesn't grow with the benchmark.

Defined cases: null or wordless texts have no words and no hits; a wordless item never occurs; an item shorter than the window
is one window of its own length; repeated items with one id count once; a null item_id is written as an empty string; null doc_ids
and repeated rows keep a result each; an empty table gives no rows, an empty benchmark no hits; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import ship, written
from .suffix_array import sort_suffixes

WINDOW = 10
SHARD_BYTES = 4 << 20
BENCHMARK_BLOCK = 16 << 20


class Suffixes:
    """The suffix array of one shard: words of its documents, each document closed by a separator."""

    def __init__(self, hashes: np.ndarray, word_off: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        docs = len(word_off) - 1
        at = np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(word_off))
        self.seq = np.zeros(len(ids) + docs, np.int64)
        self.seq[at] = ids + 1
        self.doc_start = word_off[:-1] + np.arange(docs)
        self.order, levels = sort_suffixes(self.seq, len(self.vocabulary) + 1, depth)
        self.depth = levels[-1][0]

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, low, high) of the windows that occur: their locations are order[low:high]; and the shard's ids of the items' words."""
        at = np.minimum(np.searchsorted(self.vocabulary, items.words), max(len(self.vocabulary) - 1, 0))
        ids = np.where(self.vocabulary[at] == items.words, at + 1, -1) if len(self.vocabulary) else np.full(len(items.words), -1)
        ids = np.append(ids, -1)[items.seq]  # the last stands for the end of an item
        live = np.arange(len(items.seq))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.order), np.int64)
        out = []
        for k in range(int(items.need.max(initial=0))):
            want = ids[np.minimum(live + k, len(ids) - 1)]
            go = want > 0
            live, want = live[go], want[go]
            if not len(live):
                break
            a = self._bound(low[live], high[live], want, k, False)
            b = self._bound(a, high[live], want, k, True)
            found = a < b
            live = live[found]
            low[live], high[live] = a[found], b[found]
            whole = items.need[items.item[live]] == k + 1
            out.append(live[whole])
            live = live[~whole]
        done = np.concatenate(out) if out else np.empty(0, np.int64)
        return done, low[done], high[done], ids

    def _bound(self, low, high, want, k, after):
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            pos = self.order[np.minimum(mid, len(self.order) - 1)] + k
            there = np.where(pos < len(self.seq), self.seq[np.minimum(pos, len(self.seq) - 1)], 0)
            right = open_ & ((there <= want) if after else (there < want))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low


class Items:
    """A block of benchmark items: their words end to end, each item closed by an end; equal items are one with several names."""

    def __init__(self, names: list[str], texts: pa.Array, window: int):
        buf, off = tk.column_bytes(texts)
        h, wo, _, _ = tk.word_hashes(buf, off, tk.ALNUM)
        of: dict[bytes, set[str]] = {}
        for name, a, b in zip(names, wo[:-1], wo[1:], strict=True):
            if a < b:
                of.setdefault(h[a:b].tobytes(), set()).add(name)
        self.names = [sorted(v) for v in of.values()]
        each = [np.frombuffer(k, np.uint64) for k in of]
        size = np.array([len(x) for x in each], np.int64)
        self.words, ids = np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if each else np.empty(0, np.int64)
        self.seq = np.full(int((size + 1).sum()), -1, np.int32)
        self.seq[tk.ragged(self.start, size)] = ids
        self.item = np.repeat(np.arange(len(each)), size + 1)
        self.need = np.minimum(size, window)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[str], pa.Array]]:
    """The items in blocks of bounded bytes, one block on the driver at a time while they are built."""
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= BENCHMARK_BLOCK:
            yield ids, pa.array(texts, pa.string())
            ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.array(texts, pa.string())


PAIRS = 1 << 20  # locations that are looked at together


def scan_block(texts: pa.Array, items: Items, window: int):
    """Per document of the column: hit runs [start, end) of words, and for each item that occurs its longest match."""
    all_runs, matches = [], []
    for _, _, buf, off in tk.text_blocks(texts, SHARD_BYTES):
        h, wo, _, _ = tk.word_hashes(buf, off, tk.ALNUM)
        n = len(off) - 1
        shard = Suffixes(h, wo, window)
        q, low, high, ids = shard.search(items)
        size = items.need[items.item[q]]
        # equal windows have one interval: it marks its locations once
        _, once = np.unique(np.stack([low, high, size]), axis=1, return_index=True)
        cover = np.zeros(len(shard.seq) + 1, np.int64)
        for a in range(0, len(once), 4096):
            part = once[a : a + 4096]
            at = shard.order[tk.ragged(low[part], high[part] - low[part])]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + np.repeat(size[part], high[part] - low[part]), -1)
        hit = np.cumsum(cover)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        doc_of = np.searchsorted(shard.doc_start, edges[::2], "right") - 1 if len(edges) else np.empty(0, np.int64)
        mine: list[list] = [[] for _ in range(n)]
        for d, s, e in zip(doc_of, edges[::2], edges[1::2], strict=True):
            mine[d].append({"start": int(s - shard.doc_start[d]), "end": int(e - shard.doc_start[d])})
        best: list[dict] = [{} for _ in range(n)]
        spread = np.concatenate([[0], np.cumsum(high - low)])
        for i, j in tk.row_blocks(spread, PAIRS):
            for d, item, length, at, item_at in zip(*longest(shard, items, ids, q[i:j], low[i:j], high[i:j]), strict=True):
                had = best[d].get(item)
                if had is None or (-length, at, item_at) < had:
                    best[d][item] = (-length, at, item_at)
        all_runs.extend(mine)
        matches.extend([{"item": name, "at": at, "item_at": item_at, "size": -less} for item, (less, at, item_at) in sorted(b.items()) for name in items.names[item]] for b in best)
    return all_runs, matches


def longest(shard: Suffixes, items: Items, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """(document, item, words, place in the document, place in the item) of the matches that start at one of the windows and in no window before."""
    at, q = shard.order[tk.ragged(low, high - low)], np.repeat(q, high - low)
    starts = (q == 0) | (at == 0)
    starts[~starts] = (ids[q[~starts] - 1] <= 0) | (ids[q[~starts] - 1] != shard.seq[at[~starts] - 1])
    at, q = at[starts], q[starts]
    length = items.need[items.item[q]].copy()
    live = np.arange(len(at))
    while len(live):
        x, y = at[live] + length[live], q[live] + length[live]
        same = (x < len(shard.seq)) & (y < len(ids))
        same[same] = (ids[y[same]] > 0) & (ids[y[same]] == shard.seq[x[same]])
        live = live[same]
        length[live] += 1
    doc, item = np.searchsorted(shard.doc_start, at, "right") - 1, items.item[q]
    return [x.tolist() for x in (doc, item, length, at - shard.doc_start[doc], q - items.start[item])]


def merged_runs(runs: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["start"], r["end"])):
        if out and r["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], r["end"])}
        else:
            out.append(dict(r))
    return out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
MATCHES = pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("item_at", pa.int64()), ("size", pa.int64())]))
FOUND = "runs array<struct<start:long,end:long>>, matches array<struct<item:string,at:long,item_at:long,size:long>>"


def word_counts(texts: pa.Array) -> np.ndarray:
    buf, off = tk.column_bytes(texts)
    return np.concatenate([np.diff(tk.word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i], tk.ALNUM)[2]) for i, j in tk.row_blocks(off, SHARD_BYTES)] or [np.empty(0, np.int64)])


def hits(texts: DataFrame, items: Items, window: int) -> DataFrame:
    """texts: (key, text). key, n_words, runs, matches."""
    block = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, matches = scan_block(batch.column(1), block.value, window)
            yield pa.record_batch([batch.column(0), pa.array(word_counts(batch.column(1))), pa.array(runs, RUNS), pa.array(matches, MATCHES)], names=["key", "n_words", "runs", "matches"])
        tk.give_back()

    return texts.mapInArrow(run, f"key long, n_words long, {FOUND}")


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Items]:
    for names, texts in blocks_of(benchmark, f"`{id_col}`", f"`{text_col}`"):
        yield Items(names, texts, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, runs of hit words, longest match of each item that occurs (item, at, item_at, size in words) of each document."""
    ship(docs.sparkSession)
    blocks = item_blocks(benchmark, item_col, item_text, window)
    first = next(blocks, Items([], pa.array([], pa.string()), window))
    second = next(blocks, None)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if second is None:
        return hits(texts, first, window).withColumnRenamed("key", "doc_id")
    # one pass for each block; what it finds is written, and its block let go
    rows = written(texts.select(F.col("key").alias("doc_id"), F.monotonically_increasing_id().alias("key"), "text"), "texts")
    found, counts = [], None
    for items in itertools.chain([first, second], blocks):
        got = written(hits(rows.select("key", "text"), items, window).where(F.lit(counts is None) | (F.size("runs") > 0)), "hits")
        found.append(got.where(F.size("runs") > 0))
        counts = counts or got.select("key", "n_words")
    every = functools.reduce(DataFrame.unionByName, found).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(1, "runs", pa.array([merged_runs(r) for r in batch.column(1).to_pylist()], RUNS))

    every = every.mapInArrow(run, f"key long, {FOUND}")
    none = lambda c: F.coalesce(c, F.array().cast(dict(every.dtypes)[c])).alias(c)
    return rows.select("doc_id", "key").join(counts, "key").join(every, "key", "left").select("doc_id", "n_words", none("runs"), none("matches"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, all columns; a narrow pass for each block of the benchmark, nothing is shuffled."""
    spark = ship(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    out = None
    for items in item_blocks(benchmark, item_col, item_text, window):
        if out is not None:
            docs = written(out, "clean")

        def run(batches: Iterator[pa.RecordBatch], block=spark.sparkContext.broadcast(items)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                runs, _ = scan_block(batch.column(at), block.value, window)
                yield batch.filter(pa.array([not r for r in runs], pa.bool_()))
            tk.give_back()

        out = docs.mapInArrow(run, schema)
    return docs if out is None else out


def digests(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["size"])), F.lit(0).cast("long")).alias("longest"))
