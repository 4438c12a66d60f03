"""Seeded synthetic scans: a box-shaped room seen by a ring sensor, a drifting loop through it, and a moving shell."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.formats import heat
from ..functions.geometry import from_yaw, half_up, rotate

ROOM = (10.0, 8.0, 3.0)


def to_wall(origin: tuple[Column, ...], direction: tuple[Column, ...], room: tuple[float, float, float] = ROOM) -> Column:
    """Distance along a ray from inside a box at the origin to its nearest wall."""
    far = F.lit(float("inf"))
    planes = [F.when(d > 0, (F.lit(size) - o) / d).when(d < 0, -o / d).otherwise(far) for o, d, size in zip(origin, direction, room, strict=True)]
    return F.least(*planes)


def room_scans(poses: DataFrame, rings: int = 16, per_ring: int = 360, noise: float = 0.01, seed: int = 7) -> DataFrame:
    """Sensor-frame points of scans from poses (sequence, pose): rings x per_ring for each, a fixed-size expansion."""
    grid = poses.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(rings * per_ring - 1))))
    elevation = F.radians(F.lit(-15.0) + F.floor(F.col("idx") / per_ring) * (30.0 / max(rings - 1, 1)))
    azimuth = F.radians((F.col("idx") % per_ring) * (360.0 / per_ring))
    ray = (F.cos(elevation) * F.cos(azimuth), F.cos(elevation) * F.sin(azimuth), F.sin(elevation))
    pose = F.col("pose")
    world = rotate((pose["qx"], pose["qy"], pose["qz"], pose["qw"]), ray)
    reach = to_wall((pose["tx"], pose["ty"], pose["tz"]), world) + F.randn(seed) * noise
    return grid.withColumn("reach", reach).select("sequence", "idx", *[(r * F.col("reach")).cast("float").alias(n) for r, n in zip(ray, "xyz", strict=True)])


def loop_path(steps: int = 81, step: float = 0.25, yaw_bias_deg: float = 0.15, scale: float = 1.02) -> list[dict]:
    """A closed walk through the room: true poses, and odometry that drifts by a yaw bias and a scale error.

    Rows: k, pose_sequence 2k+1, sequence 2k+2, and (x, y, yaw) true and drifted.
    """
    side = steps * step / 4
    corners = [(5 - side / 2, 4 - side / 2), (5 + side / 2, 4 - side / 2), (5 + side / 2, 4 + side / 2), (5 - side / 2, 4 + side / 2)]
    true = []
    for k in range(steps):
        at = (k / (steps - 1)) * 4 if steps > 1 else 0.0
        leg, part = min(int(at), 3), at - min(int(at), 3)
        a, b = corners[leg], corners[(leg + 1) % 4]
        true.append((a[0] + (b[0] - a[0]) * part, a[1] + (b[1] - a[1]) * part, math.atan2(b[1] - a[1], b[0] - a[0])))
    out, x, y, yaw = [], *true[0]
    for k, (tx, ty, tyaw) in enumerate(true):
        if k:
            px, py, pyaw = true[k - 1]
            dx, dy = tx - px, ty - py
            fx, fy = dx * math.cos(-pyaw) - dy * math.sin(-pyaw), dx * math.sin(-pyaw) + dy * math.cos(-pyaw)
            x, y = x + scale * (fx * math.cos(yaw) - fy * math.sin(yaw)), y + scale * (fx * math.sin(yaw) + fy * math.cos(yaw))
            yaw += tyaw - pyaw + math.radians(yaw_bias_deg)
        out.append({"k": k, "pose_sequence": 2 * k + 1, "sequence": 2 * k + 2, "x": x, "y": y, "yaw": yaw, "true_x": tx, "true_y": ty, "true_yaw": tyaw})
    return out


def loop_poses(spark: SparkSession, **shape) -> DataFrame:
    rows = spark.createDataFrame([tuple(r.values()) for r in loop_path(**shape)], "k int, pose_sequence bigint, sequence bigint, x double, y double, yaw double, true_x double, true_y double, true_yaw double")
    height = F.lit(1.5)
    return rows.select("pose_sequence", "sequence", from_yaw(F.col("true_yaw"), (F.col("true_x"), F.col("true_y"), height)).alias("true_pose"), from_yaw(F.col("yaw"), (F.col("x"), F.col("y"), height)).alias("pose"))


def shell(spark: SparkSession, n: int, t: float, seed: int = 1) -> DataFrame:
    """n points on a sphere whose radius breathes with time, coloured by height."""
    z = F.rand(seed) * 2 - 1
    a = F.rand(seed + 1) * 2 * math.pi
    radius = 2.0 + 0.5 * math.sin(t)
    flat = F.sqrt(1 - F.col("u") * F.col("u"))
    rows = spark.range(n).select(F.col("id").cast("int").alias("idx"), z.alias("u"), a.alias("a"))
    r, g, b = heat((F.col("u") + 1) / 2)
    return rows.select("idx", (flat * F.cos("a") * radius).cast("float").alias("x"), (flat * F.sin("a") * radius).cast("float").alias("y"), (F.col("u") * radius).cast("float").alias("z"), r.alias("r"), g.alias("g"), b.alias("b"), half_up(F.rand(seed + 2) * 65535).cast("int").alias("intensity"))


def bench_spin(n: int = 28_800, seed: int = 0) -> np.ndarray:
    """One spin of a small room as packed rows."""
    from ..functions.formats import V1

    rng = np.random.default_rng(seed)
    az, el = np.arange(n) % (n // 16) * (2 * np.pi / (n // 16)), np.radians(-15 + 2 * (np.arange(n) // (n // 16)))
    ray = np.stack([np.cos(el) * np.cos(az), np.cos(el) * np.sin(az), np.sin(el)], axis=1)
    half = np.array([4.0, 4.0, 1.35])
    with np.errstate(divide="ignore"):
        reach = (half / np.abs(ray)).min(axis=1) + rng.normal(0, 0.01, n)
    out = np.zeros(n, V1)
    for k, c in enumerate("xyz"):
        out[c] = ray[:, k] * reach
    for c in "rgb":
        out[c] = 128
    out["intensity"] = 1000
    return out
