"""Spinning-lidar packets: decoding to points, azimuth interpolation, timing, calibration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PACKET_BYTES, BLOCKS, CHANNELS = 1206, 12, 32
BLOCK = np.dtype([("flag", "<u2"), ("azimuth", "<u2"), ("returns", [("distance", "<u2"), ("intensity", "u1")], CHANNELS)])
FIRING_S, LASER_S = 55.296e-6, 2.304e-6
HOUR_US = 3_600_000_000
#: fixed values: the sixteen beams' vertical angles in degrees, by laser
VLP16_VERTICAL = [-15, 1, -13, 3, -11, 5, -9, 7, -7, 9, -5, 11, -3, 13, -1, 15]
SENSORS = {"vlp16": (16, 2, 0.002), "vlp32": (32, 1, 0.004)}  # lasers, firings in a block, metres of a distance step
RETURNS = "packet_id long, block int, firing int, laser int, azimuth double, distance double, intensity int, packet_us long, offset_s double"


def vertical_fixture(lasers: int) -> pd.DataFrame:
    angles = VLP16_VERTICAL if lasers == 16 else [-25 + 40 * k / (lasers - 1) for k in range(lasers)]
    return pd.DataFrame({"laser": range(lasers), "vertical": [float(a) for a in angles], "rotational": 0.0, "offset": 0.0})


def load_calibration(spark: SparkSession, path: str, lasers: int) -> DataFrame:
    """(laser, vertical, rotational, offset) of a JSON file {"lasers": [...]}: exact count, ids 0..n-1, finite angles."""
    rows = spark.read.option("multiLine", True).schema("lasers array<struct<laserId:int,verticalDegrees:double,rotationalDegrees:double,distanceOffsetMeters:double>>").json(path)
    out = rows.select(F.explode("lasers").alias("l")).select(
        F.col("l.laserId").alias("laser"), F.col("l.verticalDegrees").alias("vertical"), F.coalesce("l.rotationalDegrees", F.lit(0.0)).alias("rotational"), F.coalesce("l.distanceOffsetMeters", F.lit(0.0)).alias("offset")
    )
    return checked_calibration(out, lasers)


def checked_calibration(rows: DataFrame, lasers: int) -> DataFrame:
    found = rows.orderBy("laser").limit(lasers + 1).collect()  # a dimension of `lasers` rows
    if [r.laser for r in found] != list(range(lasers)):
        raise ValueError(f"a calibration needs the laser ids 0 to {lasers - 1}, each once")
    if not all(r[c] is not None and np.isfinite(r[c]) for r in found for c in ("vertical", "rotational", "offset")):
        raise ValueError("calibration values must be finite")
    return rows.sparkSession.createDataFrame(found, rows.schema)


def interpolated(azimuth: np.ndarray, firings: int, reuse_last: bool = True) -> np.ndarray:
    """Degrees for each block and firing. The step to the next block is shared by a block's firings; steps of ten degrees
    and more are gaps and count as none. The last block repeats the step before it, or has none."""
    degrees = azimuth.astype(np.float64) / 100.0
    step = np.zeros(len(degrees))
    if len(degrees) > 1:
        step[:-1] = (degrees[1:] - degrees[:-1]) % 360.0
        step[:-1][step[:-1] >= 10.0] = 0.0
        if reuse_last:
            step[-1] = step[-2]
    return (degrees[:, None] + step[:, None] * np.arange(firings)[None, :] / firings) % 360.0


def decode_packets(packets: DataFrame, sensor: str = "vlp16", reuse_last: bool = True) -> DataFrame:
    """Returns of packets (packet_id, packet): other sizes and blocks without the flag are left out, as are zero distances."""
    lasers, firings, step = SENSORS[sensor]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RETURNS.split(", ")]
        for part in parts:
            for pid, data in zip(part["packet_id"], part["packet"], strict=True):
                if data is None or len(data) != PACKET_BYTES:
                    continue
                blocks = np.frombuffer(data, BLOCK, BLOCKS)
                us = int.from_bytes(data[1200:1204], "little")
                angle = interpolated(blocks["azimuth"], firings, reuse_last)
                b, f, l = np.meshgrid(np.arange(BLOCKS), np.arange(firings), np.arange(lasers), indexing="ij")  # noqa: E741
                distance = blocks["returns"]["distance"].reshape(BLOCKS, firings, lasers)
                intensity = blocks["returns"]["intensity"].reshape(BLOCKS, firings, lasers)
                keep = (distance > 0) & (blocks["flag"] == 0xEEFF)[:, None, None]
                late = (b * firings + f) * FIRING_S + l * LASER_S
                yield pd.DataFrame(dict(zip(names, (pid, b[keep], f[keep], l[keep], angle[b, f][keep], distance[keep] * step, intensity[keep].astype(np.int32) * 257, us, late[keep]), strict=True)))

    return packets.select("packet_id", "packet").mapInPandas(run, RETURNS)


def to_cartesian(returns: DataFrame, calibration: DataFrame) -> DataFrame:
    """x, y, z of returns by the calibration of their laser, a dimension of at most 128 rows; non-positive distances go."""
    out = returns.join(F.broadcast(calibration), "laser")
    d = F.col("distance") + F.col("offset")
    v, a = F.radians("vertical"), F.radians(F.col("azimuth") + F.col("rotational"))
    return out.where(d > 0).withColumns({"x": d * F.cos(v) * F.sin(a), "y": d * F.cos(v) * F.cos(a), "z": d * F.sin(v)}).drop("vertical", "rotational", "offset")


def packet_time(packet: Column) -> Column:
    """Microseconds past the hour: the little-endian u32 at byte 1200; null for other sizes."""
    from .batch_log import u32

    return F.when(F.octet_length(packet) == PACKET_BYTES, u32(packet, 1200))


def local_bounds(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def merged_bounds(bounds: DataFrame, *keys: str) -> DataFrame:
    return bounds.groupBy(*keys).agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


def unrolled_time(rows: DataFrame, by: list[str], order: list[str], us: str, wrap: int = HOUR_US) -> DataFrame:
    """Adds t_us, which doesn't fall back when the hour ends: a fall of more than half a wrap is a new hour."""
    w = Window.partitionBy(*by).orderBy(*order)
    turned = F.when(F.col(us) + wrap // 2 < F.lag(us).over(w), wrap).otherwise(0)
    return rows.withColumn("_turn", turned).withColumn("t_us", F.col(us) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def spins(rows: DataFrame, by: list[str], order: list[str], azimuth: str = "azimuth", least: int = 1000) -> DataFrame:
    """Adds spin_id where a revolution is whole: the first and the unfinished last one, and those of few rows, go."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = rows.withColumn("_new", F.when(F.col(azimuth) + 180 < F.lag(azimuth).over(w), 1).otherwise(0)).withColumn("spin_id", F.sum("_new").over(running))
    sized = flagged.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "spin_id"))).withColumn("_last", F.max("spin_id").over(Window.partitionBy(*by)))
    return sized.where((F.col("spin_id") > 0) & (F.col("spin_id") < F.col("_last")) & (F.col("_n") >= least)).drop("_new", "_n", "_last")


def spin_fraction(rows: DataFrame, by: list[str], t: str, order: list[str]) -> DataFrame:
    """Adds fraction: place of a row's time within its spin, 0 to 1; evenly spaced (end excluded) if the spin takes no time."""
    w = Window.partitionBy(*by)
    low, high = F.min(t).over(w), F.max(t).over(w)
    even = (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w)
    return rows.withColumn("fraction", F.when(high > low, (F.col(t) - low) / (high - low)).otherwise(even))


def azimuth_steps(blocks: DataFrame, reuse_last: bool = True) -> DataFrame:
    """The interpolation step of blocks (packet_id, block, azimuth in degrees) as a window."""
    w = Window.partitionBy("packet_id").orderBy("block")
    raw = F.pmod(F.lead("azimuth").over(w) - F.col("azimuth"), F.lit(360.0))
    step = F.when(raw >= 10.0, 0.0).otherwise(raw)
    out = blocks.withColumn("step", step)
    return out.withColumn("step", F.coalesce("step", F.lag("step").over(w) if reuse_last else F.lit(0.0), F.lit(0.0)))


def packet(azimuth: int | list[int], us: int = 0, distance: int = 500, intensity: int = 10) -> bytes:
    """A test packet."""
    blocks = np.zeros(BLOCKS, BLOCK)
    blocks["flag"], blocks["azimuth"] = 0xEEFF, azimuth
    blocks["returns"]["distance"], blocks["returns"]["intensity"] = distance, intensity
    return blocks.tobytes() + us.to_bytes(4, "little") + b"\x37\x22"


def calibration_json(lasers: int) -> str:
    rows = vertical_fixture(lasers)
    return json.dumps({"lasers": [{"laserId": int(r.laser), "verticalDegrees": r.vertical} for r in rows.itertuples()]})
