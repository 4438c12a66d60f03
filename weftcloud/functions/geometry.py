"""Rigid-transform and grid arithmetic as Column expressions; they stay inside whole-stage code generation.

A pose is a struct<tx,ty,tz,qx,qy,qz,qw: double>, world_T_sensor with a unit quaternion.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

POSE = "struct<tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>"
Triple = tuple[Column, Column, Column]


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def pose_of(t: Sequence[float | Column], q: Sequence[float | Column]) -> Column:
    return F.struct(*[num(v).cast("double").alias(n) for n, v in zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), (*t, *q), strict=True)])


def rotate(q: Sequence[Column], v: Triple) -> Triple:
    """v + w t + q x t, with t = 2 (q x v)."""
    (x, y, z), (qx, qy, qz, qw) = v, q
    tx, ty, tz = (qy * z - qz * y) * 2.0, (qz * x - qx * z) * 2.0, (qx * y - qy * x) * 2.0
    return x + qw * tx + (qy * tz - qz * ty), y + qw * ty + (qz * tx - qx * tz), z + qw * tz + (qx * ty - qy * tx)


def quaternion(pose: Column) -> tuple[Column, Column, Column, Column]:
    return pose["qx"], pose["qy"], pose["qz"], pose["qw"]


def to_world(pose: Column, v: Triple) -> Triple:
    x, y, z = rotate(quaternion(pose), v)
    return x + pose["tx"], y + pose["ty"], z + pose["tz"]


def multiply(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column, Column]:
    """The Hamilton product of two quaternions in x, y, z, w order."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; nested pose arithmetic would else repeat it in every term."""
    return F.element_at(F.transform(F.array(value), use), 1)


def compose(a: Column, b: Column) -> Column:
    """a after b."""
    product = lambda p: pose_of(to_world(p["a"], (p["b"]["tx"], p["b"]["ty"], p["b"]["tz"])), multiply(quaternion(p["a"]), quaternion(p["b"])))
    return bound(F.struct(a.alias("a"), b.alias("b")), product)


def inverse(pose: Column) -> Column:
    def back(p: Column) -> Column:
        qx, qy, qz, qw = quaternion(p)
        turn = (-qx, -qy, -qz, qw)
        x, y, z = rotate(turn, (p["tx"], p["ty"], p["tz"]))
        return pose_of((-x, -y, -z), turn)

    return bound(pose, back)


def relative(source: Column, target: Column) -> Column:
    """target_T_source of two world poses."""
    return compose(inverse(target), source)


def rotation_angle(pose: Column) -> Column:
    """Radians."""
    return 2.0 * F.acos(F.least(F.lit(1.0), F.abs(pose["qw"])))


def from_yaw(yaw: Column, t: Triple) -> Column:
    return pose_of(t, (F.lit(0.0), F.lit(0.0), F.sin(yaw / 2.0), F.cos(yaw / 2.0)))


def pose_matrix(pose: Column) -> Column:
    """The 4 x 4 matrix in row order, as an array of 16."""
    x, y, z, w = quaternion(pose)
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), pose["tx"], 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), pose["ty"], 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), pose["tz"]]
    return F.array(*[c.cast("double") for c in rows], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def moved(a: Column, b: Column, tolerance: float, reach: float = 25.0) -> Column:
    """Whether two poses differ by more than the tolerance in place, or at `reach` metres by their rotation."""
    import math

    dx, dy, dz = (a[k] - b[k] for k in ("tx", "ty", "tz"))
    dot = F.abs(a["qx"] * b["qx"] + a["qy"] * b["qy"] + a["qz"] * b["qz"] + a["qw"] * b["qw"])
    angle = tolerance / (2.0 * reach)  # 2 acos(dot) reach > tolerance, without the arc cosine
    return (dx * dx + dy * dy + dz * dz > tolerance * tolerance) | (F.least(F.lit(1.0), dot) < (math.cos(angle) if angle < math.pi else -2.0))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


def with_cells(points, size: float, names: Sequence[str], axes: Sequence[str] = ("x", "y", "z")):
    return points.withColumns({n: cell(F.col(a), size) for n, a in zip(names, axes, strict=True)})


def key_text(*cells: Column | str) -> Column:
    return F.concat_ws("_", *[F.col(c) if isinstance(c, str) else c for c in cells])


def key_cells(key: Column) -> Triple:
    parts = F.split(key, "_")
    return tuple(parts[k].cast("bigint") for k in range(3))


def box(cells: Triple, size: float) -> tuple[Triple, Triple]:
    low = tuple(c.cast("double") * float(size) for c in cells)
    return low, tuple(c + float(size) for c in low)


def half_up(v: Column) -> Column:
    """Rounds halves towards plus infinity, unlike round()."""
    return F.floor(v + 0.5)


def level_edge(fuse: float, levels: int, level: Column) -> Column:
    inside = F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1))
    return F.lit(float(fuse)) * F.pow(F.lit(2.0), F.lit(levels - 1) - inside)


def level_for(desired: Column, fuse: float, levels: int) -> Column:
    """The level whose voxel edge is the coarsest within the desired size; finest for sizes that aren't positive.

    floor(log2(r)) is the number of powers of two up to r, which needs no logarithm.
    """
    steps = sum((F.when(desired >= fuse * 2.0**k, 1).otherwise(0) for k in range(1, levels)), F.lit(0))
    return F.when(desired.isNull() | F.isnan(desired) | ~(desired > 0), F.lit(levels - 1)).otherwise(F.lit(levels - 1) - steps).cast("int")


def micro(v: Column) -> Column:
    """A double as an exact integer of millionths, for sums that don't depend on order."""
    return F.floor(v * 1e6 + 0.5).cast("bigint")
