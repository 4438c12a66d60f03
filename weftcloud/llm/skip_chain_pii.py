"""Personal data with a skip-chain conditional random field.

Base spans come from four patterns, found in linear time. The field's nodes are units of text that look like an address or a long number;
their labels are nothing or one of the four kinds. Node potentials come from features of a unit's own shape, chain potentials join neighbours
of one document, and skip potentials join units with equal or similar content (the same digits up to punctuation and
country prefix, the same address up to case and spelt-out signs), however far apart: each to the next such unit, so a thousand
repetitions make a thousand edges. Units inside base spans are evidence. Hub edges, with the same potential, join the first evidence of each kind
to all other units of its content in the document, so that distance along the chain does not matter. Loopy sum-product messages then carry labels
along the edges until they settle, so what was recognised once is marked wherever it comes back in a form that the patterns miss. All documents of a
block are one graph.

Potentials are trained here, on a bounded sample (SAMPLE documents of at most SAMPLE_BYTES bytes): node weights by logistic regression, chain and skip
potentials from counts of label pairs.

Defined cases: null text is empty; overlapping spans of different kinds all stand; equal rows keep a result each; texts of any
length are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import ship

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_BYTES = 3000, 1 << 16
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            end = m.end()
            out.append((s, end))
        else:
            end = max(end, at)  # nothing before this sign can start a later match
        at = text.find("@", max(end, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CHAIN.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, s, e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){1,8}", re.I)
_SIGN = re.compile(r"@|\(at\)|\[at\]", re.I)
_NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")


def units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, content) of the nodes; equal content is what skip edges join."""
    out = []
    if "@" in text or "at)" in text.lower() or "at]" in text.lower():
        end = 0
        for sign in _SIGN.finditer(text):
            s = sign.start()
            if s < end:
                continue
            s -= s > end and text[s - 1] == " "
            low = max(end, s - 64)
            while s > low and text[s - 1] in _LOCAL:
                s -= 1
            m = _ADDRESS.match(text, s)
            if m:
                end = m.end()
                content = m.group().lower().replace(" ", "")
                content = content.replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", ".")
                out.append((m.start(), end, content))
    for m in _NUMBER.finditer(text):
        digits = _DIGITS.sub("", m.group())
        four = m.group().split(".")
        is_ip = len(four) == 4 and all(p.isdigit() for p in four)
        out.append((m.start(), m.end(), "ip" + ".".join(p.lstrip("0") or "0" for p in four) if is_ip else "n" + (digits if len(digits) > 15 else digits[-9:])))
    return sorted(out)


FEATURES = 48


def features(text: str, s: int, e: int) -> list[int]:
    """Indexes of the features of a unit; none is the exact condition of a base pattern."""
    unit = text[s:e]
    digits = sum(c.isdigit() for c in unit)
    out = [0, 1 + min(digits, 20)]
    out.append(22 + ("@" in unit))
    out.append(24 + (unit[0] == "+"))
    out.append(26 + min(unit.count("."), 4))
    out.append(31 + (" " in unit) + 2 * ("-" in unit) + 4 * ("(" in unit))
    out.append(39 + min((e - s) // 8, 5))
    out.append(45 + (s > 0 and text[s - 1].isalnum()) + (e < len(text) and text[e].isalnum()))
    return out


class Graph:
    """Units of many documents: features, evidence, chain, skip and hub edges."""

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.feature: list[list[int]] = []
        self.label: list[int] = []
        chain, skip, hub = [], [], []
        for d, text in enumerate(texts):
            last: dict[str, int] = {}
            group: dict[str, list[int]] = {}
            before = -1
            base = sorted((s, e, k) for k, s, e in bases[d])
            at, open_ = 0, []
            for s, e, content in units(text):
                me = len(self.spans)
                self.spans.append((d, s, e))
                self.feature.append(features(text, s, e))
                while at < len(base) and base[at][0] < e:
                    open_.append(base[at])
                    at += 1
                open_ = [b for b in open_ if b[1] > s]
                over = [b for b in open_ if b[0] < e]
                self.label.append(max(over, key=lambda b: min(e, b[1]) - max(s, b[0]))[2] + 1 if over else 0)
                if before >= 0:
                    chain.append((before, me))
                if content in last:
                    skip.append((last[content], me))
                before = last[content] = me
                group.setdefault(content, []).append(me)
            for members in group.values():
                first: dict[int, int] = {}
                for k, u in enumerate(members):
                    if self.label[u]:
                        first.setdefault(self.label[u], k)
                hub += [(members[k], u) for k in first.values() for i, u in enumerate(members) if abs(i - k) > 1 and not self.label[u]]
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.hub = np.array(hub, np.int64).reshape(-1, 2)  # not counted in training


class Field:
    """Log potentials: node weights (FEATURES, labels), chain and skip (labels, labels)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    @classmethod
    def train(cls, graph: Graph, rounds: int = 200) -> Field:
        labels = len(KINDS) + 1
        node = np.zeros((FEATURES, labels))
        if graph.spans:
            f, y = np.array(graph.feature), np.eye(labels)[graph.label]
            speed = np.full(node.shape, 1e-8)
            for _ in range(rounds):
                z = node[f].sum(axis=1)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                g = np.zeros(node.shape)
                np.add.at(g, f.reshape(-1), np.repeat(p - y, f.shape[1], axis=0) / len(f))
                g += 1e-3 * node
                speed += g * g
                node -= 0.3 * g / np.sqrt(speed)
        return cls(node, cls.pairs(graph, graph.chain, 20.0, 0.5), cls.pairs(graph, graph.skip, 1.0, 0.99) + 4 * np.eye(labels))

    @staticmethod
    def pairs(graph: Graph, edges: np.ndarray, prior: float, agree: float) -> np.ndarray:
        """Log of how much more often two labels meet on an edge than by chance, smoothed towards a share of equal labels."""
        n = len(KINDS) + 1
        label = np.array(graph.label, np.int64)
        both = np.full((n, n), prior * (1 - agree) / (n * (n - 1)))
        np.fill_diagonal(both, prior * agree / n)
        if len(edges):
            np.add.at(both, (label[edges[:, 0]], label[edges[:, 1]]), 1)
        both = (both + both.T) / 2
        p = both / both.sum()
        return np.clip(np.log(p / np.outer(p.sum(axis=0), p.sum(axis=0))), -4, 4)

    def marginals(self, graph: Graph, rounds: int = 1000) -> np.ndarray:
        """Label probabilities of all units by loopy sum-product, all messages that still change at once; rounds only ends what never settles."""
        n, labels = len(graph.spans), len(KINDS) + 1
        if not n:
            return np.zeros((0, labels))
        own = self.node[np.array(graph.feature)].sum(axis=1)
        given = np.array(graph.label)
        own = np.where((given > 0)[:, None], np.where(np.arange(labels)[None, :] == given[:, None], 20.0, -20.0), own)
        edges = np.concatenate([graph.chain, graph.skip, graph.hub])
        kind = np.repeat([0, 1], [len(graph.chain), len(graph.skip) + len(graph.hub)])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        kind = np.concatenate([kind, kind])
        potential = np.stack([self.chain, self.skip])
        message = np.zeros((len(src), labels))
        total = own.copy()
        out, at = np.argsort(src, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])  # edges that leave each unit
        live = np.arange(len(src))
        for _ in range(rounds):
            if not len(live):
                break
            into = np.where((given[src[live]] > 0)[:, None], own[src[live]], total[src[live]] - message[back[live]])  # nothing outvotes evidence
            raw = into[:, :, None] + potential[kind[live]]
            top = raw.max(axis=1)
            new = top + np.log(np.exp(raw - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            step = 0.5 * (new - message[live])
            moved = np.abs(step).max(axis=1) >= 5e-5
            message[live] += step
            np.add.at(total, dst[live], step)
            units_ = np.unique(dst[live[moved]])
            live = np.union1d(live[moved], out[tk.ragged(at[units_], at[units_ + 1] - at[units_])])
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def found_in(texts: list[str], field: Field, sure: float = 0.9) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text; spans that the field adds are surely labelled and overlap no base span of their kind."""
    bases = [base_spans(t) for t in texts]
    graph = Graph(texts, bases)
    every = [list(b) for b in bases]
    if graph.spans:
        p = field.marginals(graph)
        best = p.argmax(axis=1)
        for u in np.flatnonzero((best > 0) & (p.max(axis=1) >= sure) & (np.array(graph.label) == 0)):
            d, s, e = graph.spans[u]
            if not any(k == best[u] - 1 and a < e and s < b for k, a, b in bases[d]):
                every[d].append((int(best[u]) - 1, s, e))
    return bases, [sorted(x) for x in every]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def fit(docs: DataFrame, id_col: str, text_col: str) -> Field:
    total = docs.count()
    key = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.lit(4)), F.lit(1_000_000))
    small = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) <= SAMPLE_BYTES
    sample = docs.where((key < int(1_000_000 * min(1.0, SAMPLE / max(total, 1)))) & small).select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).limit(2 * SAMPLE)
    texts = [r.text for r in sample.collect()]
    return Field.train(Graph(texts, [base_spans(t) for t in texts]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans), spans (all spans) of every row, as kind:start:end in code points."""
    spark = ship(docs.sparkSession)
    model = spark.sparkContext.broadcast(field or fit(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.column_bytes(batch.column(1))
            for i, j in tk.row_blocks(off, 1 << 20):
                texts = [buf[off[k] : off[k + 1]].tobytes().decode() for k in range(i, j)]
                bases, every = found_in(texts, model.value)
                counts = [[sum(k == c for k, _, _ in b) for b in bases] for c in range(len(KINDS))]
                base = [joined(b) for b in bases]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([joined(x) for x in every], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
