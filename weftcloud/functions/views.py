"""Cameras and their frusta. Planes are computed once for each view on the driver and become literals in the plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from .geometry import Triple, level_for

Vector = tuple[float, float, float]
TARGET_PX = 1.5


def _dot(a: Vector, b: Vector) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(a: Vector) -> Vector:
    size = math.sqrt(_dot(a, a))
    if not size > 0:
        raise ValueError("a direction must not be zero")
    return a[0] / size, a[1] / size, a[2] / size


def _sum(a: Vector, b: Vector, times: float = 1.0) -> Vector:
    return a[0] + times * b[0], a[1] + times * b[1], a[2] + times * b[2]


@dataclass(frozen=True)
class Camera:
    position: Vector
    forward: Vector
    up: Vector = (0.0, 0.0, 1.0)
    fov_y: float = math.pi / 3
    viewport: tuple[float, float] = (1280.0, 720.0)
    near: float = 0.1
    far: float = 1000.0
    name: str = "view"
    planes: tuple = field(init=False, default=())

    def __post_init__(self):
        every = (*self.position, *self.forward, *self.up, self.fov_y, *self.viewport, self.near, self.far)
        if not all(math.isfinite(v) for v in every):
            raise ValueError("camera values must be finite")
        if not 0 < self.fov_y < math.pi or not 0 < self.near < self.far or min(self.viewport) <= 0:
            raise ValueError("field of view, viewport or near and far are out of range")
        object.__setattr__(self, "planes", self._planes())

    @property
    def tan_y(self) -> float:
        return math.tan(self.fov_y / 2)

    def _planes(self) -> tuple[tuple[float, float, float, float], ...]:
        """Six planes (a, b, c, d) with a x + b y + c z + d >= 0 inside."""
        ahead = _unit(self.forward)
        side = next((s for s in (_cross(ahead, u) for u in (self.up, (0.0, 0.0, 1.0), (0.0, 1.0, 0.0))) if math.sqrt(_dot(s, s)) >= 1e-9))
        side = _unit(side)
        above = _unit(_cross(side, ahead))
        ty = self.tan_y
        tx = ty * self.viewport[0] / self.viewport[1]
        out = []
        for normal, through in ((ahead, _sum(self.position, ahead, self.near)), (tuple(-v for v in ahead), _sum(self.position, ahead, self.far))):
            out.append((*normal, -_dot(normal, through)))
        for axis, t in ((side, tx), (above, ty)):  # a side plane holds the eye and leans by the half angle
            for sign in (1.0, -1.0):
                normal = _sum((ahead[0] * t, ahead[1] * t, ahead[2] * t), axis, sign)
                out.append((*normal, -_dot(normal, self.position)))
        return tuple(out)


def sees_point(camera: Camera, p: Triple) -> Column:
    out = F.lit(True)
    for a, b, c, d in camera.planes:
        out &= p[0] * a + p[1] * b + p[2] * c + d >= 0
    return out


def sees_box(camera: Camera, low: Triple, high: Triple) -> Column:
    """False only if the box lies wholly outside some plane: its corner farthest along the normal is tested."""
    out = F.lit(True)
    for *normal, d in camera.planes:
        x, y, z = (h if n >= 0 else lo for n, lo, h in zip(normal, low, high, strict=True))
        out &= x * normal[0] + y * normal[1] + z * normal[2] + d >= 0
    return out


def distance_to_box(point: Vector, low: Triple, high: Triple) -> Column:
    parts = [F.greatest(lo - p, F.lit(0.0), F.lit(p) - hi) for p, lo, hi in zip(point, low, high, strict=True)]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def chunk_level(camera: Camera, low: Triple, high: Triple, fuse: float, levels: int, target_px: float = TARGET_PX) -> Column:
    """The level of detail for a box, null if it is culled."""
    away = distance_to_box(camera.position, low, high)
    desired = F.greatest(away, F.lit(camera.near)) * (target_px * 2 * camera.tan_y / camera.viewport[1])
    return F.when(sees_box(camera, low, high) & (away <= camera.far), level_for(desired, fuse, levels))
