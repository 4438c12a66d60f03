"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode with a UTF-8 state machine.

A token sequence is the merge result of a byte string exactly if each adjacent pair is: encoding the pair's own bytes
gives that pair back. So every prefix has one last token: the only suffix in the vocabulary that is compatible with the last token
of what stands before it. The byte automaton that follows all tokens that may have begun is determinised as it is run: a state is what was
read from the first place where a token may have begun, and is built when first met; there are no more of them than prefixes of tokens. The
transducer is in such a state and holds the last token of each pending prefix. A byte leads to the next state, which knows the
longest token that ends there; that or a shorter one is compatible. Tokens common to the paths to all places at which a longer
token may still have begun are emitted, so lookahead is bounded by the longest token; the rest follow at the end of a piece.
Pieces are remembered by their bytes, within bounds. Decoding feeds the tokens' bytes to an incremental UTF-8 machine, which gives out the text.

Text is cut by the tokenizer's pattern first; a piece that is a token itself is emitted as such, as the tiktoken library does.

Defined cases: null text is empty and encodes to no ids; any text round-trips, also with NUL bytes or lone combining marks; very
long pieces use memory in proportion to their length only; repeated rows keep a result each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import ship

MOST_PAIRS = 1_000_000
MOST_PIECES = 400_000
STREAM = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.opens = {t[:i] for t in ranks for i in range(1, len(t))}  # proper prefixes of tokens
        self.forget()
        self.parts: dict[int, tuple[int, int] | None] = {}
        # states of the determinised byte automaton: what was read, from where a token can have begun; one for each prefix of a token at most
        self.node: dict[bytes, int] = {b"": 0}
        self.name: list[bytes] = [b""]
        self.ending: list[tuple] = [()]  # (token, its size, its known left neighbours) of the tokens that end there, longest first
        self.begun: list[tuple[int, ...]] = [()]  # how many bytes ago a longer token may have begun, longest first
        self.step: list[dict[int, int]] = [{}]

    def forget(self) -> None:
        self.known: dict[int, dict[int, bool]] = {}  # by token and left neighbour
        self.pairs = 0

    def read(self, node: int, byte: int) -> int:
        data = self.name[node] + bytes((byte,))
        while data not in self.opens and data not in self.ranks:
            data = data[1:]
            if not data:
                raise ValueError("the vocabulary lacks a byte")
        to = self.node.get(data)
        if to is None:
            to = self.node[data] = len(self.name)
            self.name.append(data)
            ends = [self.ranks[data[i:]] for i in range(len(data)) if data[i:] in self.ranks]
            self.ending.append(tuple((t, self.size[t], self.known.setdefault(t, {})) for t in ends))
            self.begun.append(tuple(len(data) - i for i in range(len(data)) if data[i:] in self.opens))
            self.step.append({})
        self.step[node][byte] = to
        return to

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The merge rule itself, for short strings: join the adjacent pair of least rank until none is in the vocabulary."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens that the rule joins last for t: (-1, -1) for a byte, None if the rule never makes t."""
        if t not in self.parts:
            data = self.token[t]
            if len(data) == 1:
                self.parts[t] = (-1, -1)
            else:
                two = self.merged(data, 2)
                self.parts[t] = (self.ranks[two[0]], self.ranks[two[1]]) if len(two) == 2 else None
        return self.parts[t]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the rule keeps left | right apart.

        Towards earlier merges the tokens that touch the boundary shrink: those on the left to their last part, those on the
        right to their first. The boundary breaks if two that exist at one time join before either joins its own neighbour.
        """
        if self.pairs > MOST_PAIRS:
            for row in self.known.values():
                row.clear()
            self.pairs = 0
        known = self.split(right) is not None
        if known and left >= 0:
            ranks, token, split = self.ranks, self.token, self.split
            x, y, x_until, y_until = left, right, 1 << 60, 1 << 60
            while True:
                joined = ranks.get(token[x] + token[y])
                if joined is not None and joined < x_until and joined <= y_until:
                    known = False
                    break
                x_parts, y_parts = split(x), split(y)
                x_since, y_since = (x if x_parts[0] >= 0 else -1), (y if y_parts[0] >= 0 else -1)
                if x_since < 0 and y_since < 0:
                    break
                if y_since >= x_since:
                    y, y_until = y_parts[0], y
                else:
                    x, x_until = x_parts[1], x
        self.known.setdefault(right, {})[left] = known
        self.pairs += 1
        return known

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of each piece; in sorted order each piece starts where it parts from the one before."""
        done = []
        step, ending, ranks, compatible = self.step, self.ending, self.ranks, self.compatible
        nodes: list[int] = [0]
        lasts: list[int] = []  # last token of each prefix of what isn't emitted yet
        last = b""
        for piece in pieces:
            whole = ranks.get(piece)
            if whole is not None:
                done.append([whole])
                continue
            n = 0
            for x, y in zip(last, piece):
                if x != y:
                    break
                n += 1
            del nodes[n + 1 :], lasts[n:]
            out: list[int] = []
            node, before, check = nodes[-1], -1, 2 * self.longest
            for byte in piece[n:] if n else piece:
                to = step[node].get(byte)
                node = self.read(node, byte) if to is None else to
                n += 1
                for t, size, known in ending[node]:
                    k = n - size
                    left = lasts[k - 1] if k else before
                    ok = known.get(left)
                    if ok or ok is None and compatible(left, t):
                        break
                lasts.append(t)
                nodes.append(node)
                if n >= check:
                    at = self.settled(node, lasts)
                    if at:
                        out += self.path(lasts, at)
                        before, n = out[-1], n - at
                        del lasts[:at], nodes[:at]
                    check = max(2 * self.longest, 2 * n)
            done.append(out + self.path(lasts, n))
            last = piece
            if out:  # what was emitted can't be shared
                nodes, lasts, last = [0], [], b""
        return done

    def settled(self, node: int, lasts: list[int]) -> int:
        """The last place that the paths to all places where a token may still begin have in common."""
        size, at = self.size, len(lasts)
        for ago in self.begun[node]:
            other = len(lasts) - ago
            while at != other:
                if at > other:
                    at -= size[lasts[at - 1]]
                else:
                    other -= size[lasts[other - 1]]
        return at

    def path(self, lasts: list[int], at: int) -> list[int]:
        """The tokens up to a place."""
        out = []
        while at:
            out.append(lasts[at - 1])
            at -= self.size[lasts[at - 1]]
        return out[::-1]


class Cutter:
    """The pieces of public_tokenizers.PATTERN as spans, found for whole blocks at once from code point classes.

    Runs of letters, of numbers and of other marks are pieces, with one space before them if there is one. Of white space the
    last character stands alone unless it is such a space or ends the text. A lone quote opens a contraction.
    """

    LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self):
        import regex

        self.table = np.full(0x110000, self.OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
                self.table[a:b] = kind

    def starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """code: code points of texts end to end; first: where each text starts. The starts of all pieces."""
        n = len(code)
        if not n:
            return np.empty(0, np.int64)
        kind = self.table[code]
        opens = np.zeros(n + 1, bool)
        opens[first[first < n]] = True
        opens[n] = True
        edge = np.empty(n, bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= opens[:n]
        space = kind == self.SPACE
        # the last of a run of white space that some other text follows
        last = space.copy()
        last[:-1] &= ~space[1:]
        last &= ~opens[1:]
        lead = last & (code == 32)
        start = edge | last
        after = np.flatnonzero(lead) + 1
        start[after] = False
        # contractions: a quote that starts a piece and is followed by one of the endings
        q = np.flatnonzero((code == 39) & start)
        if len(q):
            nxt = np.concatenate([code, [0, 0]])
            a, b = nxt[q + 1], nxt[q + 2]
            in_one, in_two = ~opens[np.minimum(q + 1, n)], ~opens[np.minimum(q + 2, n)]
            one = in_one & np.isin(a, [ord(c) for c in "stmd"])
            two = in_one & in_two & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
            for hit, size in ((q[one], 2), (q[two], 3)):
                start[hit + 1] = False
                end = hit + size
                end = end[end < n]
                start[end[kind[end] == self.LETTER]] = True
                if size == 3:
                    start[hit + 2] = False
        return np.flatnonzero(start)


class Utf8Stream:
    """Incremental UTF-8: feed byte chunks cut anywhere, get the text that is complete so far.

    The state is the bytes of an unfinished code point and how many more it needs; a malformed byte raises.
    """

    def __init__(self):
        self.held, self.need = b"", 0

    @staticmethod
    def length(lead: int) -> int:
        if lead < 0x80:
            return 1
        if 0xC2 <= lead <= 0xDF:
            return 2
        if 0xE0 <= lead <= 0xEF:
            return 3
        if 0xF0 <= lead <= 0xF4:
            return 4
        raise ValueError("malformed UTF-8")

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        if len(data) < self.need:
            self.held = data
            return ""
        end, back = len(data), 1
        while back <= min(3, end) and 0x80 <= data[end - back] < 0xC0:  # to the lead byte of the last code point
            back += 1
        self.held, self.need = b"", 0
        if back <= end:
            size = self.length(data[end - back]) if not 0x80 <= data[end - back] < 0xC0 else 0
            if size > back:
                self.held, self.need, data = data[end - back :], size, data[: end - back]
        return data.decode()

    def close(self) -> None:
        if self.held:
            raise ValueError("UTF-8 ends inside a code point")


class Codec:
    """Encodes and decodes columns; keeps its transducer for the life of the worker."""

    _kept: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], most_pieces: int = MOST_PIECES):
        self.machine, self.cutter, self.most_pieces = Transducer(ranks), Cutter(), most_pieces
        by_id = sorted((v, k) for k, v in ranks.items())
        top = by_id[-1][0] + 1
        self.length = np.zeros(top, np.int64)
        self.length[[i for i, _ in by_id]] = [len(k) for _, k in by_id]
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(k for _, k in by_id), np.uint8)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._kept:
            cls._kept[path] = cls(load_ranks(path))
        return cls._kept[path]

    def forget(self) -> None:
        """Pieces with their ids as bytes, the newer half and the older half."""
        self.piece: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def drop_caches(self) -> None:
        self.forget()
        for row in self.machine.known.values():
            row.clear()
        self.machine.pairs = 0

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte offsets of the starts of all pieces of UTF-8 rows end to end, and the end."""
        head = (buf & 0xC0) != 0x80
        where = np.flatnonzero(head)
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.searchsorted(where, off[:-1])
        return np.append(where[self.cutter.starts(code, first)], len(buf))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, offsets)."""
        cuts = self.pieces(buf, off)
        if len(cuts) == 1:
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        if len(self.piece) > self.most_pieces // 2:
            self.piece, self.older = {}, self.piece
        data, known, older, ends = buf.tobytes(), self.piece, self.older, cuts.tolist()
        names = [data[a:b] for a, b in zip(ends, ends[1:])]  # looked up by their bytes
        found = list(map(known.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = {names[k] for k in missing}
        for p in new & older.keys():
            known[p] = older[p]
        fresh = sorted(new - older.keys())
        known.update(zip(fresh, (array("I", ids).tobytes() for ids in self.machine.encode_all(fresh))))
        for k in missing:
            found[k] = known[names[k]]
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2)])
        return np.frombuffer(b"".join(found), np.uint32), total[np.searchsorted(cuts[:-1], off)]

    def token_bytes(self, ids: np.ndarray) -> bytes:
        return self.blob[tk.ragged(self.at[ids], self.length[ids])].tobytes()

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each row, by a UTF-8 machine that is fed STREAM tokens at a time."""
        out = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            machine, parts = Utf8Stream(), []
            for k in range(a, b, STREAM):
                parts.append(machine.feed(self.token_bytes(ids[k : min(k + STREAM, b)])))
            machine.close()
            out.append("".join(parts))
        return out


def stream_text(codec: Codec, ids: Iterator[int]) -> Iterator[str]:
    """Decodes a stream of ids to text, each piece as soon as it is complete."""
    state = Utf8Stream()
    for i in ids:
        if part := state.feed(codec.token_bytes(np.array([i]))):
            yield part
    state.close()


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = 2 << 20, keep: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary), decoded (string) of each document.

    keep: whether Python workers keep what they remember between tasks, which is faster but holds memory that other stages on the same
    executors may need.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path)
        gc.disable()  # the caches hold no cycles
        for batch in batches:
            for i, j, buf, off in tk.text_blocks(batch.column(1), block):
                ids, at = codec.encode(buf, off)
                yield pa.record_batch([batch.column(0).slice(i, j - i), tk.binary_rows(ids.astype("<u4"), at), pa.array(codec.decode(ids, at), pa.string())], names=["doc_id", "ids", "decoded"])
        if not keep:
            codec.drop_caches()
        tk.give_back()

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(trips: DataFrame) -> DataFrame:
    return trips.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
