"""Packed point formats: Column arithmetic for decoded fields, and vectorised coders of whole payloads.

xyz_rgb_i_v1: 18 bytes (three float32, three uint8, uint16, padding); xyzi_q4_v2: 7 bytes (three int16 of 4 mm, uint8);
q8_chunk_v2: 7 bytes (three uint8 of 1/256 chunk edge, three uint8 of colour, uint8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from .geometry import Triple, half_up

STEP = 0.004
STRIDES = {"xyz_rgb_i_v1": 18, "xyzi_q4_v2": 7, "q8_chunk_v2": 7}
V1 = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("intensity", "<u2"), ("pad", "u1")])
Q4 = np.dtype([("x", "<i2"), ("y", "<i2"), ("z", "<i2"), ("intensity", "u1")])
Q8 = np.dtype([("x", "u1"), ("y", "u1"), ("z", "u1"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("intensity", "u1")])
POINTS = "x float, y float, z float, r short, g short, b short, intensity int, idx int"


def q4_encode(v: Column) -> Column:
    return F.greatest(F.least(half_up(v / STEP), F.lit(32767)), F.lit(-32768)).cast("int")


def q4_encode_even(v: Column) -> Column:
    """The publishers' variant, which rounds halves to even."""
    return F.greatest(F.least(F.rint(v / STEP), F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def q4_decode(q: Column) -> Column:
    return (q * STEP).cast("float")


def grey(intensity8: Column) -> tuple[Triple, Column]:
    """Colour and 16-bit intensity of a q4 point."""
    return (intensity8, intensity8, intensity8), F.shiftleft(intensity8.cast("int"), 8)


def intensity16(intensity8: Column) -> Column:
    """The sensors' expansion of 8 to 16 bits."""
    return intensity8.cast("int") * 257


def intensity8(intensity16: Column) -> Column:
    return F.shiftright(intensity16.cast("int"), 8)


def q8_encode(v: Column, origin: Column, size: float) -> Column:
    return F.greatest(F.least(F.floor((v - origin) * 256.0 / size), F.lit(255)), F.lit(0)).cast("int")


def q8_decode(q: Column, origin: Column, size: float) -> Column:
    """The centre of a quantum."""
    return origin + (q + 0.5) * (size / 256.0)


def heat(t: Column) -> Triple:
    """A blue to green to red ramp of a value in [0, 1], with plateaus: each colour falls off at four times the distance from its centre."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    part = lambda quarters: half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.5) - F.abs(inside * 4.0 - quarters))) * 255.0).cast("int")
    return part(3.0), part(2.0), part(1.0)


def shade(value: Column, most: Column) -> Column:
    """Brightness 55 to 255 by the share of the greatest value."""
    return (F.lit(255) - half_up(F.coalesce(value / F.nullif(most, F.lit(0.0)), F.lit(0.0)) * 200.0)).cast("int")


def unpack(payload: bytes, kind: str) -> np.ndarray:
    """Payload bytes as V1 rows."""
    if kind == "xyz_rgb_i_v1":
        return np.frombuffer(payload, V1)
    raw = np.frombuffer(payload, Q4)
    out = np.zeros(len(raw), V1)
    for axis in "xyz":
        out[axis] = raw[axis].astype(np.float64) * STEP
    for c in "rgb":
        out[c] = raw["intensity"]
    out["intensity"] = raw["intensity"].astype(np.uint16) << 8
    return out


def pack(rows: np.ndarray, kind: str, origin: tuple[float, float, float] = (0, 0, 0), size: float = 2.0) -> bytes:
    if kind == "xyz_rgb_i_v1":
        return rows.astype(V1).tobytes()
    out = np.zeros(len(rows), Q4 if kind == "xyzi_q4_v2" else Q8)
    for k, axis in enumerate("xyz"):
        v = rows[axis].astype(np.float64)
        if kind == "xyzi_q4_v2":
            out[axis] = np.clip(np.floor(v / STEP + 0.5), -32768, 32767)
        else:
            out[axis] = np.clip(np.floor((v - origin[k]) * 256 / size), 0, 255)
    if kind == "q8_chunk_v2":
        for c in "rgb":
            out[c] = rows[c]
    out["intensity"] = rows["intensity"] >> 8
    return out.tobytes()


BLOCK = 1 << 21  # bytes of payload decoded at a time


def decode_batches(batches: DataFrame, keep: tuple[str, ...] = ("session_id", "sequence", "pose_sequence")) -> DataFrame:
    """One row for each point of each batch (payload, point_format): the kept columns, the point and its position.

    Payloads are decoded many at a time, up to BLOCK bytes or one payload.
    """

    def decoded(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kinds = [k or "xyz_rgb_i_v1" for k in part.column("point_format").to_pylist()]
        for kind in dict.fromkeys(kinds):
            rows = np.array([k for k, other in enumerate(kinds) if other == kind])
            stride = 18 if kind == "xyz_rgb_i_v1" else 7
            payloads = part.column("payload").take(pa.array(rows))
            sizes = payloads.cast(pa.large_binary()).buffers()[1]
            sizes = np.diff(np.frombuffer(sizes, np.int64)[: len(rows) + 1])
            if payloads.null_count or (sizes % stride).any():
                raise ValueError(f"payload size doesn't fit {kind}")
            ends = np.cumsum(sizes)
            first = 0
            while first < len(rows):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + BLOCK, "right")))
                n = sizes[first:last] // stride
                points = unpack(b"".join(payloads.slice(first, last - first).to_pylist()), kind)
                own = part.select(list(keep)).take(pa.array(np.repeat(rows[first:last], n)))
                idx = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
                cols = [*(points[c].astype(np.float32) for c in "xyz"), *(points[c].astype(np.int16) for c in "rgb"), points["intensity"].astype(np.int32), idx.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), *(pa.array(c) for c in cols)], names=[*keep, *(c.split()[0] for c in POINTS.split(", "))])
                first = last

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from decoded(part)

    kept = ", ".join(f"{c} {batches.schema[c].dataType.simpleString()}" for c in keep)
    return batches.select(*keep, "point_format", "payload").mapInArrow(run, f"{kept}, {POINTS}")


def group_starts(keys: list[pa.Array]) -> np.ndarray:
    """Where the rows of sorted keys start a new group; nulls are equal."""
    new = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        a, b = k.slice(0, len(k) - 1), k.slice(1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def packed(points: DataFrame, keys: tuple[str, ...], kind: str, order: str = "idx", origin: tuple[str, str, str] | None = None, size: float = 2.0) -> DataFrame:
    """The reverse: one payload for each group of points, in order; groups are batches or chunks, bounded by their definition.

    Sorted rows are packed as they come, all groups of an Arrow batch at once; only the last group waits for the next batch.
    """
    names = [f"_k{k}" for k in range(len(keys))]

    def pack_rows(part: pa.RecordBatch, starts: np.ndarray, end: int) -> pa.RecordBatch:
        n = np.diff(np.append(starts, end))
        rows = np.zeros(end, V1)
        for c in V1.names[:-1]:
            rows[c] = part.column(f"_{c}").slice(0, end).to_numpy(zero_copy_only=False)
        at = tuple(np.repeat(part.column(f"_o{k}").to_numpy(zero_copy_only=False).astype(float)[starts], n) for k in range(3)) if origin else (0, 0, 0)
        data = pack(rows, kind, at, size)
        bounds = (np.append(starts, end) * STRIDES[kind]).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])
        first = pa.array(starts)
        return pa.RecordBatch.from_arrays([*(part.column(k).take(first) for k in names), pa.array(n.astype(np.int32)), payload], names=[*keys, "point_count", "payload"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one group, which may go on
        for part in parts:
            if not part.num_rows:
                continue
            if held and len(group_starts([pa.concat_arrays([held[0].column(k).slice(0, 1), part.column(k).slice(part.num_rows - 1)]) for k in names])) == 1:
                held.append(part)
                continue
            whole = _joined([*held, part])
            starts = group_starts([whole.column(k) for k in names])
            if len(starts) > 1:
                yield pack_rows(whole, starts[:-1], int(starts[-1]))
            held = [whole.slice(int(starts[-1]))]
        if held:
            whole = _joined(held)
            yield pack_rows(whole, np.zeros(1, np.int64), whole.num_rows)

    kept = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys)
    rows = points.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(order).alias("_order"), *[F.col(c).alias(f"_{c}") for c in V1.names[:-1]], *[F.col(c).alias(f"_o{k}") for k, c in enumerate(origin or ())])
    return rows.repartition(*names).sortWithinPartitions(*names, F.asc_nulls_last("_order")).drop("_order").mapInArrow(run, f"{kept}, point_count int, payload binary")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


@pandas_udf(BooleanType())
def payload_finite(payload: pd.Series, kind: pd.Series) -> pd.Series:
    """Whether all coordinates of a payload are finite."""

    def one(p: bytes, k: str) -> bool:
        if k != "xyz_rgb_i_v1" or len(p) % 18:
            return True
        rows = np.frombuffer(p, V1)
        return bool(np.isfinite(rows["x"]).all() and np.isfinite(rows["y"]).all() and np.isfinite(rows["z"]).all())

    return pd.Series([one(p, k or "xyz_rgb_i_v1") for p, k in zip(payload, kind, strict=True)], dtype=bool)
