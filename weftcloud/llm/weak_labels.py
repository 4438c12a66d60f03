"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Heuristic labellers each vote 1, 0 or nothing on two questions of each document: is it prose of good quality, is it toxic. Given labels,
where there are some, are one more labeller. Expectation-maximisation estimates how each labeller votes within either
class, from the counts of vote patterns over all documents (a few thousand patterns at most, whatever the corpus). Posteriors of a bounded
sample (SAMPLE documents of at most SAMPLE_BYTES, the only bounded part) then train a linear scorer over hashed words and binned
statistics, which scores every whole text. A document stays if it is of good quality and not toxic. The sample is drawn after labels are
joined, from documents labelled toxic, other labelled ones and unlabelled ones separately; a row counts as many times as it stands for rows of its kind.

The list of toxic words is learnt from all labelled rows by smoothed log-odds; rarer words on it count half. Words that fewer than TOXIC_SHARE of
the documents labelled toxic hold are not listed, which bounds the list whatever the corpus.

Defined cases: null text is empty; an empty text votes nothing but on length and is scored like any other; without labels the
labellers alone decide, and nothing is toxic; repeated rows and repeated labels count as often as they occur in votes, labels once by
doc_id (the largest); a null doc_id has no label; an empty table gives no rows; other columns pass through keep_good
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import ship, written

SAMPLE, SAMPLE_BYTES, BUCKETS = 8000, 1 << 15, 1 << 18
SMALL = 1_000_000  # labels that are broadcast, at most
GIVEN = 0.98  # accuracy of given labels
TOXIC_SHARE = 0.02  # of the documents labelled toxic that a listed word occurs in, at least
NO_WORDS = np.empty(0, np.uint64), np.empty(0, np.int64)
QUALITY, TOXIC = 6, 3  # labellers of either question, besides given labels
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122))
_SYMBOL = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~((_ASCII >= 48) & (_ASCII <= 57)) & ~np.isin(_ASCII, [ord(c) for c in ".,'-"])
_PIPE = _ASCII == ord("|")
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_EDGES = {
    "upper": [0.1, 0.15, 0.3, 0.6], "symbol": [0.01, 0.03, 0.05, 0.1, 0.2], "pipe": [0.005, 0.03], "again": [0.02, 0.05, 0.2, 0.5],
    "distinct": [0.1, 0.3, 0.45, 0.5, 0.6], "width": [3.5, 6.5, 9, 15], "digit": [0.02, 0.1, 0.3], "words": [1, 5, 20, 200], "hits": [0.5, 1.5, 2.5, 5], "rate": [1e-6, 0.002, 0.01, 0.05],
}


@dataclass
class Block:
    stats: dict[str, np.ndarray]
    hashes: np.ndarray  # distinct word hashes of each row
    off: np.ndarray


def measure(buf: np.ndarray, off: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> Block:
    """Statistics of each text of a block; lexicon: sorted hashes of toxic words and their weights."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    count = lambda table: tk.row_sums(table[buf].astype(np.int64), off)
    raw, wo, s, e = tk.word_hashes(buf, off, tk.NONSPACE)
    words = np.diff(wo)
    again = np.zeros(len(raw), np.int64)
    again[1:] = raw[1:] == raw[:-1]
    again[wo[:-1][wo[:-1] < len(raw)]] = 0
    h, ho, _, _ = tk.word_hashes(buf, off, tk.ALNUM)
    row = np.repeat(np.arange(n), np.diff(ho))
    weight = np.zeros(len(h), np.int64)
    half = (h >> np.uint64(17) & np.uint64(1)).astype(np.int64)
    if len(lexicon[0]) and len(h):
        at = np.minimum(np.searchsorted(lexicon[0], h), len(lexicon[0]) - 1)
        weight = np.where(lexicon[0][at] == h, lexicon[1][at], 0)
    order = np.lexsort((h, row))
    h, row, weight, half = h[order], row[order], weight[order], half[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    all_hits = np.bincount(row, weights=weight > 0, minlength=n)
    hits = np.bincount(row[new], weights=weight[new], minlength=n)
    parts = [np.bincount(row[new], weights=weight[new] * (half[new] == k), minlength=n) for k in (0, 1)]
    distinct = np.bincount(row[new], minlength=n)
    plain = np.maximum(np.diff(ho), 1)
    letters = np.maximum(count(_LETTER), 1)
    stats = {
        "upper": count(_UPPER) / letters, "symbol": count(_SYMBOL) / size, "pipe": count(_PIPE) / size, "again": tk.row_sums(again, wo) / np.maximum(words, 1),
        "distinct": distinct / plain, "width": tk.row_sums((e - s).astype(np.int64), wo) / np.maximum(words, 1), "digit": count(_DIGIT) / size, "words": words.astype(float), "hits": hits.astype(float), "rate": all_hits / plain,
        "one": parts[0], "other": parts[1],
    }
    return Block(stats, h[new], np.concatenate([[0], np.cumsum(distinct)]))


def votes(b: Block) -> np.ndarray:
    """(rows, QUALITY + TOXIC) votes: 0, 1 or 2 (nothing)."""
    s = b.stats
    pick = lambda no, yes: np.where(no, 0, np.where(yes, 1, 2))
    some = s["words"] >= 1
    out = [
        pick(s["upper"] > 0.3, some & (s["upper"] < 0.15)),
        pick(s["symbol"] > 0.05, some & (s["symbol"] < 0.03)),
        pick(s["pipe"] > 0.03, some & (s["pipe"] < 0.005)),
        pick(s["again"] > 0.2, some & (s["again"] < 0.05)),
        pick((s["distinct"] < 0.45) & (s["words"] >= 30) & (s["words"] < 3000), some & (s["distinct"] > 0.5)),
        pick((s["width"] > 15) | (s["words"] < 1), (s["width"] < 7) & some),
        pick(s["one"] < 1, s["one"] >= 2),  # either half of the list of toxic words has a labeller, and how dense they are
        pick(s["other"] < 1, s["other"] >= 2),
        pick(s["rate"] <= 0, s["rate"] > 0.002),
    ]
    return np.stack(out, axis=1)


def keys_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def votes_of(keys: np.ndarray, n: int) -> np.ndarray:
    return keys[:, None] // 3 ** np.arange(n)[None, :] % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 50, given: float | None = None, even: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each pattern, (labellers, 2, 3) vote shares by class, prior of either class), by expectation-maximisation from `start`.

    given: accuracy that the last labeller, given labels, is held to; how often it votes is estimated. even: both classes have the
    prior 1/2 throughout, so that a rare class isn't given up for few votes.
    """
    posterior = start.astype(float)
    shares, prior = np.full((patterns.shape[1], 2, 3), 1 / 3), np.full(2, 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        if not even:
            prior = np.clip(weight.sum(axis=1) / max(counts.sum(), 1), 1e-4, 1 - 1e-4)
        for k in range(patterns.shape[1]):
            for c in range(2):
                seen = np.bincount(patterns[:, k], weights=weight[c], minlength=3)[:3] + 0.1
                shares[k, c] = seen / seen.sum()
        if given is not None:
            for c in range(2):
                some = shares[-1, c, :2].sum()
                shares[-1, c, :2] = some * (1 - given), some * (1 - given)
                shares[-1, c, c] = some * given
        new = posteriors(patterns, shares, prior)
        if np.abs(new - posterior).max(initial=0) < 1e-6:
            break
        posterior = new
    return posterior, shares, prior


def posteriors(votes_: np.ndarray, shares: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Of class 1, by the accuracies that expectation-maximisation has found."""
    logs = np.log(prior)[:, None] + sum(np.log(shares[k][:, votes_[:, k]]) for k in range(votes_.shape[1]))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, row offsets): hashed words scaled by the root of their number, and a bucket for the bin of each statistic."""
    n = len(b.off) - 1
    binned = np.stack([k * 16 + np.searchsorted(_EDGES[name], b.stats[name], "right") for k, name in enumerate(_EDGES)], axis=1)
    extra = binned.shape[1]
    words = np.diff(b.off)
    off = b.off + np.arange(n + 1) * extra
    index, value = np.empty(int(off[-1]), np.int64), np.ones(int(off[-1]), np.float32)
    at = tk.ragged(off[:-1], words)
    index[at] = (b.hashes % np.uint64(BUCKETS)).astype(np.int64) + 256
    value[at] = np.repeat(1 / np.sqrt(np.maximum(words, 1)), words)
    index[(off[1:, None] - extra + np.arange(extra)[None, :])] = binned
    return index, value, off


def train(index: np.ndarray, value: np.ndarray, off: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, by full-batch steps with per-weight rates; soft targets; weight: how often each row counts, 1 in the mean."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    n = max(len(off) - 1, 1)
    w, speed = np.zeros(BUCKETS + 256), np.full(BUCKETS + 256, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[index] * value, minlength=n), -30, 30)))
        g = np.bincount(index, weights=((p - target) * weight)[rows] * value, minlength=len(w)) / n + decay * w
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
    return w


@dataclass
class Scorer:
    lexicon: tuple[np.ndarray, np.ndarray]
    good: np.ndarray
    toxic: np.ndarray
    accuracies: dict[str, list]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good quality, probability of toxicity) of each whole text."""
        out: tuple[list, list] = ([], [])
        for _, _, buf, off in tk.text_blocks(texts, 1 << 20):
            index, value, at = features(measure(buf, off, self.lexicon))
            for into, w in zip(out, (self.good, self.toxic), strict=True):
                z = tk.row_sums((w[index] * value).astype(np.float64), at)
                into.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def learn_lexicon(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, with weights, of words much more frequent in documents labelled toxic (1) than in others (0); labelled: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        words, counts = empty, np.zeros((2, 0))
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, off in tk.text_blocks(batch.column(0), 1 << 20):
                b = measure(buf, off, NO_WORDS)
                row = np.repeat(toxic[i:j], np.diff(b.off))
                words, where = np.unique(np.concatenate([words, b.hashes.view(np.int64)]), return_inverse=True)
                counts = np.stack([np.bincount(where, weights=np.concatenate([counts[c], row == c]), minlength=len(words)) for c in (0, 1)])
                if len(words) > 1 << 20:
                    yield pa.record_batch([pa.array(words), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", "n0", "n1"])
                    words, counts = empty, np.zeros((2, 0))
        yield pa.record_batch([pa.array(words), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", "n0", "n1"])
        tk.give_back()

    clean, of_toxic = (labelled.where(F.col("toxic") == c).count() for c in (0, 1))
    counts = labelled.select("text", "toxic").mapInArrow(run, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (of_toxic + 1)) - F.log((F.col("n0") + 0.5) / (clean + 1))
    found = counts.where((F.col("n1") >= max(4, TOXIC_SHARE * of_toxic)) & (odds > 3.0)).toPandas()
    words = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.where(found["n1"].to_numpy(float)[order] >= 4 * TOXIC_SHARE * of_toxic, 2, 1)


def parts_taken(sizes: list[int]) -> list[float]:
    """Which part of the documents labelled toxic, of other labelled ones and of unlabelled ones the sample takes; about SAMPLE rows together."""
    toxic, clean, plain = sizes
    take = [min(toxic, SAMPLE // 4)]
    room = SAMPLE - take[0]
    take.append(min(clean, max(room * clean // max(clean + plain, 1), room // 4)))
    take.append(min(plain, room - take[1]))
    return [min(1.0, t / max(n, 1)) for t, n in zip(take, sizes, strict=True)]


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if labels is None:
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = written(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "labels")
    if labels.count() <= SMALL:
        labels = F.broadcast(labels)  # else texts are dealt out by doc_id
    joined = texts.join(labels, "doc_id", "left").withColumn("kind", F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 1).otherwise(2))
    lexicon = learn_lexicon(texts.join(labels.where("toxic is not null"), "doc_id").select("text", "toxic"))
    shipped = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(votes(measure(buf, off, shipped.value))) for _, _, buf, off in tk.text_blocks(batch.column(1), 1 << 20)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], names=["doc_id", "votes"])
        tk.give_back()

    cast = texts.mapInArrow(run, "doc_id long, votes long").join(labels, "doc_id", "left")
    counts = cast.groupBy("votes", "quality", "toxic").count().toPandas()  # patterns, 3 ** labellers at most
    patterns = votes_of(counts["votes"].to_numpy(np.int64), QUALITY + TOXIC)
    n = counts["count"].to_numpy(float)
    given = [np.where(counts[c].isna(), 2, counts[c].fillna(0).astype(int).clip(0, 1)).astype(np.int64) for c in ("quality", "toxic")]
    good = np.column_stack([patterns[:, :QUALITY], given[0]])
    bad = np.column_stack([patterns[:, QUALITY:], given[1]])
    _, *good_model = estimate(good, n, (good != 0).all(axis=1), given=GIVEN, even=True)
    _, *bad_model = estimate(bad, n, (bad == 1).any(axis=1), given=GIVEN, even=True)
    if len(lexicon[0]) == 0:
        bad_model[0][:] = 1 / 3
    small = joined.where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES)
    count = {r.kind: r["count"] for r in small.groupBy("kind").count().collect()}
    sizes = [count.get(k, 0) for k in range(3)]
    limit = [int(1_000_000 * x) for x in parts_taken(sizes)]
    place = F.xxhash64("doc_id")
    some = small.where(F.pmod(place, F.lit(1_000_000)) < F.element_at(F.array(*map(F.lit, limit)), F.col("kind") + 1)).orderBy(place, "doc_id", "text").limit(2 * SAMPLE)
    models = spark.sparkContext.broadcast((good_model, bad_model))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task: the sample is bounded and stays off the driver."""
        targets, parts, kinds = ([], []), [], []
        for batch in batches:
            labels_ = [np.where(np.isnan(x), 2, np.nan_to_num(x)).astype(np.int64).clip(0, 2) for x in (batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (1, 2))]
            kinds.append(batch.column(3).to_numpy())
            for i, j, buf, off in tk.text_blocks(batch.column(0), 1 << 20):
                b = measure(buf, off, shipped.value)
                v = votes(b)
                for into, mine, model, label in zip(targets, (v[:, :QUALITY], v[:, QUALITY:]), models.value, labels_, strict=True):
                    into.append(posteriors(np.column_stack([mine, label[i:j]]), *model))
                parts.append(features(b))
        if not parts:
            return
        kind = np.concatenate(kinds)
        weight = (np.array(sizes) / np.maximum(np.bincount(kind, minlength=3), 1))[kind]
        weight = weight / weight.mean()
        index, value = np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
        weights = [train(index, value, off, np.concatenate(t), weight).astype(np.float32).tobytes() for t in targets]
        yield pa.record_batch([pa.array([x]) for x in weights], names=["good", "toxic"])
        tk.give_back()

    found = some.select("text", "quality", "toxic", "kind").mapInArrow(learn, "good binary, toxic binary").collect()
    nothing = np.zeros(BUCKETS + 256, np.float32)
    w_good, w_toxic = (np.frombuffer(bytes(x), np.float32).copy() for x in found[0]) if found else (nothing, nothing - 1)
    if not len(lexicon[0]):
        w_toxic = nothing.copy()
        w_toxic[:256] = -1.0
    return Scorer(lexicon, w_good, w_toxic, {"quality": good_model[0].tolist(), "toxic": bad_model[0].tolist()})


def score_documents(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality (probability), toxicity (probability), kept for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, toxic = model.value.score(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(good), pa.array(toxic), pa.array((good >= 0.5) & (toxic < 0.5))], names=["doc_id", "quality", "toxicity", "kept"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality double, toxicity double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, all columns; a narrow pass."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, toxic = model.value.score(batch.column(at))
            yield batch.filter(pa.array((good >= 0.5) & (toxic < 0.5)))
        tk.give_back()

    return docs.mapInArrow(run, docs.schema)
