"""Near-duplicate groups by min-max hashing.

A document's set is its distinct k-word shingles. One evaluation of each permutation gives two values of a signature, the
least and the greatest hash, so PERMUTATIONS evaluations give twice as many values. Bands of ROWS values over least and over
greatest values make 2 * PERMUTATIONS / ROWS bucket keys; a pair at similarity s misses all of them with probability
(1 - s^ROWS)^bands, 2.4e-7 at 0.8. Documents with the same set are one class from the start (one partial aggregation), so copies
never meet in buckets.

Links between classes are confirmed on the full sets, without emitting all pairs of a bucket:
1. each class is tested against the bucket leader with which it shares most buckets; links are joined to components;
2. classes are tested against all leaders of their buckets that lie in other components;
3. of those that still share a bucket across components, the holders of a rare shingle are tested against its hub, the holder with most
   shingles left from that one on. Whatever a group's middle reaches joins it here, one test for each holder, whichever id leads the buckets.
4. pairs across the components that are left, if they share one of their rarest shingles, are tested; that leaves out no pair at the
   threshold. Inside one component nothing is left to learn.
Steps 2 to 4 leave out pairs whose signatures agree on fewer values than any pair at the threshold would in 8 standard
deviations. A bucket's members meet their leader by joins that adaptive execution can split; nothing is gathered by bucket.

Defined cases: A-Z is lower-cased; a document of fewer than k words has its whole sequence as one shingle; one without words (or
null) has an empty set and is linked with nothing; rows of one doc_id are one document, linked through any of their texts; a
null doc_id is linked with nothing, has a null component and is kept; an empty table gives no rows; other columns of the input are
ignored, or passed through by drop_near_copies, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkit as tk
from .components import components
from .store import dropped, ship, written

PERMUTATIONS, ROWS = 150, 6
HUB_ROUNDS = 3  # at most; what they leave unlinked is tested in step 4
_rng = np.random.default_rng(77001)
_MUL = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row end to end, offsets)."""
    words, wo, _, _ = tk.word_hashes(buf, off, tk.NONSPACE)
    n = np.diff(wo)
    size = np.minimum(n, k)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    so = np.concatenate([[0], np.cumsum(counts)])
    first = tk.ragged(wo[:-1], counts)
    width = np.repeat(size, counts)
    h = width.astype(np.uint64)
    for j in range(k):
        more = width > j
        h[more] = tk.mix(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ words[first[more] + j])
    for a, b in zip(so[:-1], so[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[so[:-1][so[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[so]


def signatures(sets: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) values: (rows with a set) x PERMUTATIONS."""
    starts = so[:-1][np.diff(so) > 0]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low, high = np.empty((PERMUTATIONS, len(starts)), np.uint32), np.empty((PERMUTATIONS, len(starts)), np.uint32)
    if len(starts):
        y = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.bitwise_xor(x, _XOR[p], out=y)
            np.multiply(y, _MUL[p], out=y)
            np.minimum.reduceat(y, starts, out=low[p])
            np.maximum.reduceat(y, starts, out=high[p])
    return low.T, high.T


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    values = np.concatenate([low, high], axis=1).astype(np.uint64)
    bands = values.shape[1] // ROWS
    out = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(values), b + 1, np.uint64)
        for r in range(ROWS):
            acc = tk.mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ values[:, b * ROWS + r])
        out[:, b] = acc
    return out


SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Of every row: doc_id, set size, 128-bit fingerprint of the set, bucket keys, one byte of each signature value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.text_blocks(batch.column(1), 1 << 18):
                sets, so = shingle_sets(buf, off, k)
                n = np.diff(so)
                low, high = signatures(sets, so)
                keys = band_keys(low, high)
                sig = ((np.concatenate([low, high], axis=1) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                there = n > 0
                ko = np.concatenate([[0], np.cumsum(there * keys.shape[1])]).astype(np.int32)
                go = np.concatenate([[0], np.cumsum(there * sig.shape[1])])
                fps = [tk.row_sums(tk.mix(sets ^ np.uint64(s)), so).view(np.int64) for s in (0x1F3D5B79, 0x2E4C6A88)]
                bands = pa.ListArray.from_arrays(pa.array(ko), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n), pa.array(fps[0]), pa.array(fps[1]), bands, tk.binary_rows(sig.reshape(-1), go)], names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"])

    return docs.mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.text_blocks(batch.column(1), 1 << 18):
                sets, so = shingle_sets(buf, off, k)
                yield pa.record_batch([batch.column(0).slice(i, j - i), tk.binary_rows(sets, so)], names=["node", "elems"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, elems binary")


def similar_enough(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Leaves out pairs (a, b) whose signatures agree on too few values for the threshold."""
    values = 2 * PERMUTATIONS
    least = threshold * values - 8 * (values * threshold * (1 - threshold)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (tk.column_bytes(batch.column(k))[0].reshape(batch.num_rows, values) for k in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield batch.select([0, 1]).filter(keep)

    of = lambda side: sigs.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xo), (y, yo) = ((b.view(np.uint64), o // 8) for b, o in (tk.column_bytes(batch.column(k)) for k in (2, 3)))
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                p, q = x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]]
                if len(p) > len(q):
                    p, q = q, p
                if 100 * len(p) < percent * len(q):
                    continue
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep[r] = 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    of = lambda side: sets.select(F.col("node").alias(side), F.col("elems").alias(f"elems_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "elems_a", "elems_b").mapInArrow(run, "a long, b long")


def rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, rest) of nodes: the shingles of which two sets that reach the threshold share one.

    With shingles in one order for all, rarest first, two sets of the wanted similarity share one of their first
    n - ceil(percent * n / 100) + 1. A shingle that no other node has takes a place and makes no pair, so a set with
    enough shingles of its own is compared with nothing, however large the group that it is in. rest: how many shared shingles a
    set has from this one on; if it is the first that two sets share, that bounds their intersection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(1))
            n = np.diff(off) // 8
            for i, j in tk.row_blocks(off, 1 << 22):
                row = pa.array(np.repeat(np.arange(i, j), n[i:j]))
                part = np.ascontiguousarray(buf[off[i] : off[j]]).view(np.int64)
                yield pa.record_batch([batch.column(0).take(row), pa.array(np.repeat(n[i:j], n[i:j])), pa.array(part)], names=["node", "n", "token"])

    tokens = written(nodes.join(sets, "node").select("node", "elems").mapInArrow(run, "node long, n long, token long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = written(tokens.join(shared, "token"), "common")
    dropped(tokens)
    # one sort by node serves the places and the counts: large tables aren't joined and sorted again for them
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    each = Window.partitionBy("node")
    ranked = common.withColumn("at", F.row_number().over(each.orderBy("df", "token"))).withColumn("m", F.count(F.lit(1)).over(each))
    prefix = ranked.where(F.col("at") <= places - (F.col("n") - F.col("m"))).select("token", "node", "n", (F.col("m") - F.col("at") + 1).alias("rest"))
    prefix = written(prefix, "prefix")
    dropped(common)
    return prefix


def enough(percent: int) -> Column:
    """Whether a and b can reach the threshold if they share nothing before the shingle that they meet in."""
    return F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def with_hubs(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, b the hub of a shingle of both: no more than prefix (token, node, n, rest, comp) has rows."""
    hub = F.max(F.struct("rest", (-F.col("node")).alias("node"), "n", "comp"))
    hubs = prefix.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), hub.alias("hub")).where("x <> y")
    hubs = hubs.select("token", F.col("hub.rest").alias("rb"), (-F.col("hub.node")).alias("b"), F.col("hub.n").alias("nb"), F.col("hub.comp").alias("cb"))
    a = prefix.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("comp").alias("ca"))
    return a.join(hubs, "token").where("ca <> cb").where(enough(percent)).select("a", "b").distinct()


def sharing_rare(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of prefix (token, node, n, rest, comp) and can reach the threshold."""
    mixed = prefix.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    # of two sets that reach the threshold, the one with more left of itself has at least 2 * percent / (100 + percent) of it left: others don't meet one another
    full = F.col("rest") * (100 + percent) >= F.col("n") * 2 * percent
    prefix = prefix.join(mixed, "token", "left_semi").withColumn("full", full)
    side = lambda x: prefix.select("token", *[F.col(c).alias(c[0] + x) for c in ("comp", "n", "rest", "full")], F.col("node").alias(x))
    a, b = side("a").where("fa"), side("b")
    return a.join(b, "token").where("ca <> cb and (not fb or a > b)").where(enough(percent)).select("a", "b").distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = written(sketches(texts, k), "sketches")
    real = table.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"))
    # rows of one doc_id that hold several sets tie their classes together
    several = real.groupBy("doc_id").agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).where("x <> y").select("doc_id")
    nodes = written(real.join(classes.select(F.col("node").alias("doc_id"), "fp1", "fp2"), ["doc_id", "fp1", "fp2"], "left_semi").select(F.col("doc_id").alias("node"), "bands", "sig"), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("top")).where("leader < top").select("key", "leader")
    members = written(keys.join(leaders, "key").select("key", "node", "leader"), "members")
    involved = members.select("node").distinct()
    sets = written(full_sets(texts.join(involved, texts["doc_id"] == F.col("node"), "left_semi"), k), "sets")
    sigs = nodes.select("node", "sig")
    # 1. the leader with most buckets in common
    shared = members.where("node <> leader").groupBy("node", "leader").count()
    best = shared.groupBy("node").agg(F.max(F.struct("count", (-F.col("leader")).alias("l"))).alias("x")).select(F.col("node").alias("a"), (-F.col("x.l")).alias("b"))
    links = written(confirmed(best, sets, percent), "links")
    tied = several.join(real, "doc_id").join(classes, ["fp1", "fp2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    links = written(links.union(tied), "links")
    comps = components(links)

    def labelled(rows: DataFrame, node: str, comp: str) -> DataFrame:
        return rows.join(comps.select(F.col("node").alias(node), F.col("comp").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))

    # 2. the other leaders, across components
    cross = labelled(labelled(shared.select(F.col("node").alias("a"), F.col("leader").alias("b")), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    cross = written(similar_enough(cross.join(best, ["a", "b"], "left_anti"), sigs, percent / 100), "cross")
    new = written(confirmed(cross, sets, percent), "links")
    if not new.isEmpty():
        links = links.union(new)
        comps = components(links)
    # 3. whatever still shares a bucket across components, against the hubs of its rare shingles
    held = labelled(members.select("key", "node"), "node", "comp")
    split = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_ = written(held.join(split, "key", "left_semi").select("node").distinct(), "open")
    prefix = rare_shingles(open_, sets, percent)

    def tested(pairs: DataFrame) -> DataFrame:
        likely = written(similar_enough(pairs, sigs, percent / 100), "cross")
        new = written(confirmed(likely, sets, percent), "links")
        dropped(likely)
        return new

    for _ in range(HUB_ROUNDS):
        new = tested(with_hubs(labelled(prefix, "node", "comp"), percent))
        if new.isEmpty():
            break
        links = links.union(new)
        comps = components(links)
    # 4. against one another
    new = tested(sharing_rare(labelled(prefix, "node", "comp"), percent))
    if not new.isEmpty():
        comps = components(links.union(new))
    to_class = table.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    to_class = to_class.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    out = to_class.join(comps, "node", "left").select("doc_id", "n_shingles", F.least("doc_id", F.coalesce("comp", "node")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no kept document of a smaller id makes superfluous, with all columns of docs."""
    gone = near_groups(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_weft_dropped")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == F.col("_weft_dropped"), "left_anti")
