"""Loop closure: keyframes, candidate pairs, registration, pose-graph optimisation, and corrections for every batch.

Keyframe choice compares with the last chosen one, so it runs in order within a session, as a stream; registration runs per
candidate pair, in parallel. The graph of one session has hundreds to thousands of nodes and is solved by numpy in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.formats import group_starts


@dataclass(frozen=True)
class Config:
    keyframe_m: float = 0.5
    keyframe_deg: float = 10.0
    radius_m: float = 3.0
    min_gap: int = 20
    candidates: int = 2
    voxel_m: float = 0.1
    coarse_m: float = 1.0
    fine_m: float = 0.3
    min_fitness: float = 0.4
    max_rmse: float = 0.15
    max_correction_m: float | None = None
    range_m: float | None = None
    iterations: int = 60


def matrix(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, y, z, w = q / np.linalg.norm(q)
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = t
    return out


def pose_row(m: np.ndarray) -> list[float]:
    """[tx, ty, tz, qx, qy, qz, qw] of a rigid matrix."""
    r = m[:3, :3]
    vals = np.array([1 + r[0, 0] - r[1, 1] - r[2, 2], 1 - r[0, 0] + r[1, 1] - r[2, 2], 1 - r[0, 0] - r[1, 1] + r[2, 2], 1 + np.trace(r)])
    k = int(vals.argmax())
    q = np.empty(4)
    q[k] = vals[k]
    if k == 3:
        q[:3] = r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]
    else:
        i, j = (k + 1) % 3, (k + 2) % 3
        q[i], q[j], q[3] = r[i, k] + r[k, i], r[j, k] + r[k, j], r[j, i] - r[i, j]
    q /= np.linalg.norm(q)
    return [*m[:3, 3].tolist(), *(q if q[3] >= 0 else -q).tolist()]


def angle_deg(m: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip((np.trace(m[:3, :3]) - 1) / 2, -1, 1))))


POSES = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
_FLAT = "tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def _matrices(part: pd.DataFrame, prefix: str = "") -> list[np.ndarray]:
    v = part[[prefix + p for p in POSES]].to_numpy(float)
    return [matrix(r[:3], r[3:]) for r in v]


class Chooser:
    """Picks keyframes among the batches of one session, which come in order.

    Plain numbers decide: the turn follows from the dot product of two quaternions. Where these come near a limit, or aren't finite, the
    matrices of `_stays` do, so that rounding doesn't show.
    """

    def __init__(self, cfg: Config, last: list[float] | None = None):
        self.cfg, self.last = cfg, last
        self.least2 = cfg.keyframe_m**2 if cfg.keyframe_m > 0 else -1.0
        self.turn = 2.0 if cfg.keyframe_deg <= 0 else -2.0 if cfg.keyframe_deg > 180 else float(np.cos(np.radians(cfg.keyframe_deg)))

    def _stays(self, pose: list[float]) -> bool:
        a, b = np.array(self.last), np.array(pose)
        step = np.linalg.inv(matrix(a[:3], a[3:])) @ matrix(b[:3], b[3:])
        return bool(np.linalg.norm(step[:3, 3]) < self.cfg.keyframe_m and angle_deg(step) < self.cfg.keyframe_deg)

    def pick(self, poses: list[list[float]], counts: list) -> list[int]:
        """Places of the keyframes among these batches; counts: their numbers of points."""
        out, least2, turn = [], self.least2, self.turn
        scale = 1e-11 * (1 + abs(least2))
        last = self.last
        for k, pose in enumerate(poses):
            if counts[k] == 0:
                continue
            if last is not None:
                x, y, z, a, b, c, d = pose
                lx, ly, lz, la, lb, lc, ld = last
                d2 = (x - lx) * (x - lx) + (y - ly) * (y - ly) + (z - lz) * (z - lz) - least2
                near = scale * (1 + abs(x) + abs(y) + abs(z) + abs(lx) + abs(ly) + abs(lz))
                if not d2 > near:
                    dot, norm = a * la + b * lb + c * lc + d * ld, (a * a + b * b + c * c + d * d) * (la * la + lb * lb + lc * lc + ld * ld)
                    cosine = (2 * dot * dot / norm - 1 if norm > 0 else np.nan) - turn
                    if not cosine < -1e-9:
                        if d2 < -near and cosine > 1e-9 or self._stays(pose):
                            continue
            out.append(k)
            last = self.last = pose
        return out


def _picked(part: pd.DataFrame, last: list[float] | None, number: int, cfg: Config) -> pd.DataFrame:
    """Keyframes among the batches of one session, given the last one and its successor's number."""
    part = part.sort_values("sequence").reset_index(drop=True)
    at = Chooser(cfg, last).pick(part[POSES].to_numpy(float).tolist(), part["point_count"].tolist())
    out = part.iloc[at].assign(kf=np.arange(number, number + len(at)), batch_index=at)
    return out[["session_id", "kf", "batch_index", "sequence", *POSES]]


KEYFRAMES = f"session_id string, kf int, batch_index int, sequence bigint, {_FLAT}"


def _flat_poses(batches: DataFrame) -> DataFrame:
    return batches.select("session_id", "sequence", "point_count", *[F.col(f"pose.{p}").alias(p) for p in POSES])


def keyframes(batches: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(session_id, kf, batch_index, sequence, pose columns): the first batch with points, then each that moved enough since the last chosen.

    batches: session_id, sequence, pose_sequence, point_count, pose. Each choice hangs on the one before, so a session is walked by one
    task, but as a sorted stream: no task holds a session.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, chooser, number, index = None, None, 0, 0
        for part in parts:
            sessions = part.column("session_id").to_pylist()
            poses = np.stack([part.column(p).to_numpy(zero_copy_only=False).astype(float) for p in POSES], axis=1).tolist()
            counts = part.column("point_count").to_pylist()
            at, kfs, indexes, start = [], [], [], 0
            while start < len(sessions):
                if chooser is None or sessions[start] != session:
                    session, chooser, number, index = sessions[start], Chooser(cfg), 0, 0
                end = len(sessions) if sessions[-1] == session else next(k for k in range(start, len(sessions)) if sessions[k] != session)
                got = chooser.pick(poses[start:end], counts[start:end])
                at += [start + k for k in got]
                kfs.append(np.arange(number, number + len(got), dtype=np.int32))
                indexes.append(np.array(got, np.int32) + np.int32(index))
                number, index, start = number + len(got), index + end - start, end
            if at:
                own = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column("session_id"), pa.array(np.concatenate(kfs)), pa.array(np.concatenate(indexes)), own.column("sequence"), *(own.column(p) for p in POSES)], names=["session_id", "kf", "batch_index", "sequence", *POSES])

    return _flat_poses(batches).repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("sequence")).mapInArrow(run, KEYFRAMES)


def more_keyframes(batches: DataFrame, known: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Keyframes among new batches, going on from the last known one of each session (batch_index counts new batches only)."""
    newest = known.groupBy("session_id").agg(F.max("kf").alias("kf"))
    last = known.join(newest, ["session_id", "kf"]).select("session_id", "kf", *POSES)

    def pick(key, part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame([], columns=["session_id", "kf", "batch_index", "sequence", *POSES])
        return _picked(part, before[POSES].to_numpy(float)[0].tolist() if len(before) else None, int(before["kf"].iloc[0]) + 1 if len(before) else 0, cfg)

    return _flat_poses(batches).groupBy("session_id").cogroup(last.groupBy("session_id")).applyInPandas(pick, KEYFRAMES)


FINEST = 6  # halvings of the radius
PAIRS = 1 << 21  # distances held at a time
NEAR = "session_id string, source int, target int, d2 double, rank int"


def _ranked(s: np.ndarray, t: np.ndarray, xyz: np.ndarray, kf: np.ndarray, cfg: Config) -> tuple[np.ndarray, ...]:
    d = xyz[s] - xyz[t]
    d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
    near = d2 <= cfg.radius_m * cfg.radius_m
    s, t, d2 = s[near], t[near], d2[near]
    by = np.lexsort((kf[t], d2, s))
    s, t, d2 = s[by], t[by], d2[by]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    best = rank < cfg.candidates
    return s[best], t[best], d2[best], rank[best] + 1


def nearest_before(group: np.ndarray, cube: np.ndarray, xyz: np.ndarray, kf: np.ndarray, source: np.ndarray, cfg: Config) -> tuple[np.ndarray, ...]:
    """(row, row of its target, squared distance, rank): the nearest targets in the group of each source, min_gap before it and within the radius.

    cube: a group's cube, which has its sources; its targets are there and in the 26 cubes around. Cells start as fine as the group is
    dense, and double until a source has its number of targets within a cell's width. Targets of a cell are in order of kf, so those
    that come too late for a source are not looked at; PAIRS are, or those of one source.
    """
    order = np.flatnonzero(~source)
    order = order[np.argsort(kf[order], kind="stable")]
    active = np.flatnonzero(source)
    early = np.searchsorted(kf[order], kf[active] - cfg.min_gap, "right")  # so many targets come early enough
    rank_bits, group_bits = int(len(order) + 1).bit_length(), int(group.max(initial=0) + 1).bit_length()
    finest = max(0, min(FINEST, (62 - rank_bits - group_bits) // 3 - 3))
    dense = np.bincount(group[order], minlength=int(group.max(initial=0)) + 1)
    start = np.clip(np.floor(np.log2(np.maximum(dense / 32, 1)) / 3), 0, finest).astype(np.int64)[group]
    steps = [(x, y, z) for x in (0, 1, 2) for y in (0, 1, 2) for z in (0, 1, 2)]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    for level in range(finest, -1, -1):
        mine = np.flatnonzero(start[active] >= level)
        if not len(mine):
            continue
        cell = np.floor(xyz / cfg.radius_m * 2.0**level).astype(np.int64) - ((cube - 1) << level)

        def keys(rows: np.ndarray, step: tuple[int, int, int], cell: np.ndarray = cell, bits: int = level + 3) -> np.ndarray:
            c = cell[rows]
            return (((group[rows] << bits | c[:, 0] + step[0]) << bits | c[:, 1] + step[1]) << bits | c[:, 2] + step[2]) << rank_bits

        own = keys(order, (1, 1, 1)) | np.arange(len(order))
        by = np.argsort(own)
        own = own[by]
        left = np.ones(len(mine), bool)
        for a in range(0, len(mine), 1 << 15):
            rows, most = active[mine[a : a + (1 << 15)]], early[mine[a : a + (1 << 15)]]
            base = np.stack([keys(rows, step) for step in steps], axis=1)
            lo = np.searchsorted(own, base)
            n = np.maximum(np.searchsorted(own, base + most[:, None]) - lo, 0)
            ends = np.cumsum(n.sum(axis=1))
            x = 0
            while x < len(rows):
                y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS, "right")))
                size = n[x:y].ravel()
                at = np.repeat(lo[x:y].ravel() - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found = _ranked(np.repeat(rows[x:y], n[x:y].sum(axis=1)), order[by[at]], xyz, kf, cfg)
                if level:
                    inside = found[2] <= (cfg.radius_m * 0.5**level) ** 2 * (1 - 1e-9)
                    done = np.bincount(found[0][inside], minlength=len(group)) >= cfg.candidates
                    found = tuple(v[done[found[0]]] for v in found)
                    left[a + x : a + y] = ~done[rows[x:y]]
                else:
                    left[a + x : a + y] = False
                out.append(found)
                x = y
        keep = np.ones(len(active), bool)
        keep[mine[~left]] = False
        active, early = active[keep], early[keep]
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def loop_candidates(kfs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(session_id, source, target, distance, rank): for each keyframe the nearest ones at least min_gap before it, within the radius.

    Positions are dealt to cubes as wide as the radius; targets go to the cubes around theirs too. A task streams its cubes and searches
    them in finer cells, so neither rows nor memory grow with the pairs within the radius.
    """
    far = F.lit(float("inf"))
    base = kfs.where(F.col("session_id").isNotNull() & F.col("kf").isNotNull())
    for c in ("tx", "ty", "tz"):
        base = base.where(F.abs(c) < far)  # others are within no distance
    base = base.select("session_id", F.col("kf").cast("long").alias("kf"), *[F.col(c).cast("double").alias(c) for c in ("tx", "ty", "tz")], *[F.floor(F.col(c) / cfg.radius_m).cast("bigint").alias(g) for c, g in zip(("tx", "ty", "tz"), ("gx", "gy", "gz"), strict=True)])
    around = base.withColumn("source", F.lit(False))
    for g in ("gx", "gy", "gz"):
        around = around.withColumn("_s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(g, F.col(g) + F.col("_s")).drop("_s")
    keys = ["session_id", "gx", "gy", "gz"]

    def search(part: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        get = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        source = get("source").astype(bool)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, part.num_rows)))
        used = np.flatnonzero((np.bincount(group[source], minlength=len(starts)) > 0)[group])
        kf = get("kf")
        s, t, d2, rank = nearest_before(group[used], np.stack([get(g)[used] for g in keys[1:]], axis=1), np.stack([get(c)[used] for c in ("tx", "ty", "tz")], axis=1), kf[used], source[used], cfg)
        s, t = used[s], used[t]
        return pa.RecordBatch.from_arrays([part.column("session_id").take(pa.array(s)), pa.array(kf[s].astype(np.int32)), pa.array(kf[t].astype(np.int32)), pa.array(d2), pa.array(rank.astype(np.int32))], names=["session_id", "source", "target", "d2", "rank"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, 1 << 18
        for part in parts:
            held, rows = [*held, part], rows + part.num_rows
            if rows >= most:
                whole = pa.concat_batches(held)
                starts = group_starts([whole.column(k) for k in keys])
                cut = int(starts[-1])
                if cut:
                    yield search(whole.slice(0, cut), starts[:-1])
                held, rows = [whole.slice(cut)], whole.num_rows - cut
                most = max(1 << 18, 2 * rows)
        if rows:
            whole = pa.concat_batches(held)
            yield search(whole, group_starts([whole.column(k) for k in keys]))

    found = base.withColumn("source", F.lit(True)).unionByName(around).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, NEAR)
    return found.select("session_id", "source", "target", F.sqrt("d2").alias("distance"), "rank")


def odometry_edges(kfs: DataFrame) -> DataFrame:
    """Each keyframe with the next one."""
    w = Window.partitionBy("session_id").orderBy("kf")
    return kfs.withColumn("next_kf", F.lead("kf").over(w)).where("next_kf is not null").select("session_id", F.col("next_kf").alias("source"), F.col("kf").alias("target"))


def down_sampled(points: np.ndarray, edge: float) -> np.ndarray:
    if not len(points):
        return points
    _, which = np.unique(np.floor(points / edge).astype(np.int64), axis=0, return_inverse=True)
    which = which.reshape(-1)
    n = np.bincount(which)
    return np.stack([np.bincount(which, weights=points[:, k]) / n for k in range(3)], axis=1)


class Grid:
    """Nearest neighbours by hashing points to cubes of the search radius."""

    def __init__(self, points: np.ndarray, radius: float):
        self.points, self.radius = points, radius
        self.cubes = np.floor(points / radius).astype(np.int64)
        self.low = self.cubes.min(axis=0) - 2 if len(points) else np.zeros(3, np.int64)
        self.span = (self.cubes.max(axis=0) - self.low + 4) if len(points) else np.ones(3, np.int64)
        key = self._key(self.cubes)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _key(self, cubes: np.ndarray) -> np.ndarray:
        c = np.clip(cubes - self.low, 0, self.span - 1)
        return (c[:, 0] * self.span[1] + c[:, 1]) * self.span[2] + c[:, 2]

    def nearest(self, queries: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances) of the k nearest within the radius; -1 and inf where there are fewer."""
        home = np.floor(queries / self.radius).astype(np.int64)
        best = np.full((len(queries), k), np.inf)
        which = np.full((len(queries), k), -1, np.int64)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for dz in (-1, 0, 1):
                    key = self._key(home + (dx, dy, dz))
                    a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
                    for step in range(int((b - a).max(initial=0))):
                        rows = np.flatnonzero(a + step < b)
                        p = self.order[a[rows] + step]
                        d = ((self.points[p] - queries[rows]) ** 2).sum(axis=1)
                        ok = d < np.minimum(best[rows, -1], self.radius**2)
                        rows, p, d = rows[ok], p[ok], d[ok]
                        best[rows, -1], which[rows, -1] = d, p
                        if k > 1:
                            o = np.argsort(best[rows], axis=1)
                            best[rows], which[rows] = np.take_along_axis(best[rows], o, 1), np.take_along_axis(which[rows], o, 1)
        return which, best


def normals(points: np.ndarray, radius: float, k: int = 16) -> np.ndarray:
    """Direction of least spread among each point's neighbours."""
    which, _ = Grid(points, radius).nearest(points, k)
    there = which >= 0
    n = np.maximum(there.sum(axis=1), 1)
    near = np.where(there[:, :, None], points[which], 0.0)
    mean = near.sum(axis=1) / n[:, None]
    d = np.where(there[:, :, None], near - mean[:, None, :], 0.0)
    cov = np.einsum("nki,nkj->nij", d, d) / n[:, None, None]
    return np.linalg.eigh(cov)[1][:, :, 0]


def exp_se3(v: np.ndarray) -> np.ndarray:
    """v: rotation vector, then translation."""
    out, w = np.eye(4), v[:3]
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if a < 1e-9:
        out[:3, :3] += k
    else:
        out[:3, :3] += np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * (k @ k)
    out[:3, 3] = v[3:]
    return out


def log_se3(m: np.ndarray) -> np.ndarray:
    """The small-motion coordinates that exp_se3 takes."""
    r = m[:3, :3]
    a = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return np.concatenate([axis * (0.5 if a < 1e-9 else a / (2 * np.sin(a)) if np.sin(a) > 1e-9 else 0.5), m[:3, 3]])


def register(source: np.ndarray, target: np.ndarray, start: np.ndarray, cfg: Config = Config()) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(target_T_source, fitness, rmse, 6 x 6 information) by coarse and then fine point-to-plane registration of sampled clouds."""
    m = start.copy()
    if not len(source) or not len(target):
        return m, 0.0, 0.0, np.eye(6)
    normal = normals(target, 5 * cfg.voxel_m)
    fitness = rmse = 0.0
    information = np.eye(6)
    for radius in (cfg.coarse_m, cfg.fine_m):
        grid = Grid(target, radius)
        before = (-1.0, -1.0)
        for _ in range(cfg.iterations):
            moved = source @ m[:3, :3].T + m[:3, 3]
            which, d2 = grid.nearest(moved)
            hit = which[:, 0] >= 0
            if hit.sum() < 6:
                return m, 0.0, 0.0, np.eye(6)
            p, q, n = moved[hit], target[which[hit, 0]], normal[which[hit, 0]]
            fitness, rmse = hit.mean(), float(np.sqrt(d2[hit, 0].mean()))
            j = np.concatenate([np.cross(p, n), n], axis=1)
            step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(6), -j.T @ ((p - q) * n).sum(axis=1), rcond=None)[0]
            m = exp_se3(step) @ m
            if abs(fitness - before[0]) < 1e-6 and abs(rmse - before[1]) < 1e-6:
                break
            before = fitness, rmse
        g = np.zeros((len(q), 3, 6))
        g[:, 0, 1], g[:, 0, 2], g[:, 1, 0], g[:, 1, 2], g[:, 2, 0], g[:, 2, 1] = q[:, 2], -q[:, 1], -q[:, 2], q[:, 0], q[:, 1], -q[:, 0]
        g[:, 0, 3] = g[:, 1, 4] = g[:, 2, 5] = 1
        information = np.einsum("nki,nkj->ij", g, g)
    if not np.isfinite(information).all() or np.trace(information) <= 0:
        information = np.eye(6)
    return m, float(fitness), rmse, information


CLOUD = "session_id string, kf int, cloud array<double>"


def clouds(points: DataFrame, kfs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Sampled sensor-frame clouds of the keyframes; one scan is one group, bounded by the batch limit."""
    own = points.join(kfs.select("session_id", "sequence", "kf"), ["session_id", "sequence"])
    if cfg.range_m:
        own = own.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= cfg.range_m**2)

    def sample(part: pd.DataFrame) -> pd.DataFrame:
        p = down_sampled(part[["x", "y", "z"]].to_numpy(float), cfg.voxel_m)
        return pd.DataFrame({"session_id": [part["session_id"].iloc[0]], "kf": [part["kf"].iloc[0]], "cloud": [p.reshape(-1)]})

    return own.select("session_id", "kf", "x", "y", "z").groupBy("session_id", "kf").applyInPandas(sample, CLOUD)


LOOPS = f"session_id string, source int, target int, {_FLAT}, fitness double, rmse double, correction double, information array<double>"


def verified_loops(candidates: DataFrame, kfs: DataFrame, sampled: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidates whose registration fits well and stays near its start: target_T_source, fitness, rmse, information."""
    side = lambda n: kfs.join(sampled, ["session_id", "kf"]).select("session_id", F.col("kf").alias(n), *[F.col(p).alias(f"{n}_{p}") for p in POSES], F.col("cloud").alias(f"{n}_cloud"))
    pairs = candidates.select("session_id", "source", "target").join(side("source"), ["session_id", "source"]).join(side("target"), ["session_id", "target"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, (s, t) in enumerate(zip(_matrices(part, "source_"), _matrices(part, "target_"), strict=True)):
                row = part.iloc[k]
                start = np.linalg.inv(t) @ s
                m, fitness, rmse, info = register(np.asarray(row["source_cloud"]).reshape(-1, 3), np.asarray(row["target_cloud"]).reshape(-1, 3), start, cfg)
                rows.append((row["session_id"], row["source"], row["target"], *pose_row(m), fitness, rmse, float(np.linalg.norm((np.linalg.inv(start) @ m)[:3, 3])), info.reshape(-1)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOOPS.split(", ")])

    most = cfg.radius_m if cfg.max_correction_m is None else cfg.max_correction_m
    found = pairs.repartition("session_id", "source", "target").mapInPandas(run, LOOPS)
    return found.where((F.col("fitness") >= cfg.min_fitness) & (F.col("rmse") <= cfg.max_rmse) & (F.col("correction") <= most))


def optimise(nodes: list[np.ndarray], edges: list[tuple[int, int, np.ndarray, np.ndarray, bool]], rounds: int = 50, prune: float = 0.25, scale: float = 1.0) -> list[np.ndarray]:
    """World poses of nodes that satisfy edges (source, target, target_T_source, information, uncertain), node 0 fixed.

    Levenberg-Marquardt over small motions; uncertain edges have a line-process weight (mu / (mu + error))^2, and those below `prune`
    at the end are dropped for a last pass.
    """
    poses = [n.copy() for n in nodes]
    edges = [(s, t, z, i / max(np.trace(i) / 6, 1e-12), u) for s, t, z, i, u in edges]

    def errors() -> list[np.ndarray]:
        return [log_se3(np.linalg.inv(z) @ np.linalg.inv(poses[t]) @ poses[s]) for s, t, z, _, _ in edges]

    def weights(e: list[np.ndarray]) -> list[float]:
        return [(scale / (scale + float(x @ i @ x))) ** 2 if u else 1.0 for x, (_, _, _, i, u) in zip(e, edges, strict=True)]

    for final in (False, True):
        damping = 1e-4
        e = errors()
        for _ in range(rounds):
            w = weights(e)
            cost = sum(k * float(x @ i @ x) for k, x, (_, _, _, i, _) in zip(w, e, edges, strict=True))
            n = 6 * (len(poses) - 1)
            h, g = np.zeros((n, n)), np.zeros(n)
            for k, x, (s, t, z, i, _) in zip(w, e, edges, strict=True):
                # right perturbation of both ends: the source moves the error directly, the target by the adjoint of the inverse
                rel = np.linalg.inv(poses[s]) @ poses[t]
                r, p = rel[:3, :3], rel[:3, 3]
                skew = np.array([[0, -p[2], p[1]], [p[2], 0, -p[0]], [-p[1], p[0], 0]])
                adj = np.zeros((6, 6))
                adj[:3, :3], adj[3:, 3:], adj[3:, :3] = r, r, skew @ r
                # translation of the error is measured in the frame of the edge's source
                turn = np.eye(6)
                turn[3:, 3:] = exp_se3(np.concatenate([x[:3], np.zeros(3)]))[:3, :3]
                blocks = [(s, turn), (t, -turn @ adj)]
                for a, ja in blocks:
                    if a == 0:
                        continue
                    ra = slice(6 * a - 6, 6 * a)
                    g[ra] += k * ja.T @ i @ x
                    for b, jb in blocks:
                        if b:
                            h[ra, 6 * b - 6 : 6 * b] += k * ja.T @ i @ jb
            step = np.linalg.lstsq(h + damping * np.eye(n), -g, rcond=None)[0]
            kept = poses
            poses = [poses[0], *[poses[a] @ exp_se3(step[6 * a - 6 : 6 * a]) for a in range(1, len(poses))]]
            e2 = errors()
            cost2 = sum(k * float(x @ i @ x) for k, x, (_, _, _, i, _) in zip(weights(e2), e2, edges, strict=True))
            if cost2 <= cost:
                e, damping = e2, max(damping / 10, 1e-9)
                if cost - cost2 < 1e-10 * max(cost, 1e-12):
                    break
            else:
                poses, damping = kept, damping * 10
                if damping > 1e6:
                    break
        if not final:
            w = weights(errors())
            strong = [x for k, x in zip(w, edges, strict=True) if not x[4] or k >= prune]
            if len(strong) == len(edges):
                break
            edges = strong
    return poses


CORRECTED = f"session_id string, kf int, {_FLAT}"


def optimised(kfs: DataFrame, loops: DataFrame, odometry_weight: float = 100.0) -> DataFrame:
    """Corrected keyframe poses of each session, from its odometry chain and accepted loops."""

    def solve(key, nodes: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("kf").reset_index(drop=True)
        poses = _matrices(nodes)
        edges = [(k + 1, k, np.linalg.inv(poses[k]) @ poses[k + 1], odometry_weight * np.eye(6), False) for k in range(len(poses) - 1)]
        for row, z in zip(found.itertuples(), _matrices(found), strict=True):
            edges.append((int(row.source), int(row.target), z, np.asarray(row.information).reshape(6, 6), True))
        out = optimise(poses, edges) if len(found) else poses
        rows = [(key[0], int(k), *pose_row(m)) for k, m in zip(nodes["kf"], out, strict=True)]
        return pd.DataFrame(rows, columns=["session_id", "kf", *POSES])

    return kfs.groupBy("session_id").cogroup(loops.groupBy("session_id")).applyInPandas(solve, CORRECTED)


def as_of(batches: DataFrame, kfs: DataFrame) -> DataFrame:
    """Adds kf, the keyframe at or before each batch; batches before the first have none."""
    marked = batches.join(kfs.select("session_id", "sequence", F.col("kf").alias("_own")), ["session_id", "sequence"], "left")
    w = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("kf", F.last("_own", ignorenulls=True).over(w)).drop("_own")


def propagated(batches: DataFrame, kfs: DataFrame, corrected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrections of all batches, tails): each batch keeps its place relative to its keyframe."""
    from ..functions.geometry import compose, inverse

    pose = lambda p="": F.struct(*[F.col(p + c).alias(c) for c in POSES])
    change = kfs.select("session_id", "kf", pose().alias("old")).join(corrected.select("session_id", "kf", pose().alias("new")), ["session_id", "kf"])
    change = change.select("session_id", "kf", compose(F.col("new"), inverse(F.col("old"))).alias("change"))
    out = as_of(batches, kfs).join(change, ["session_id", "kf"]).select("session_id", "pose_sequence", compose(F.col("change"), F.col("pose")).alias("corrected"))
    tails = change.groupBy("session_id").agg(F.max_by("change", "kf").alias("tail"))
    return out, tails


def drift(kfs: DataFrame, corrected: DataFrame) -> DataFrame:
    """The greatest move of a keyframe in each session."""
    j = kfs.alias("a").join(corrected.alias("b"), ["session_id", "kf"])
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in ("ty", "tz")), (F.col("a.tx") - F.col("b.tx")) ** 2))
    return j.groupBy("session_id").agg(F.max(d).alias("max_correction_m"))


def accuracy(estimated: DataFrame, true: DataFrame) -> DataFrame:
    """Mean and last position error; both (session_id, sequence, pose)."""
    j = estimated.select("session_id", "sequence", F.col("pose").alias("e")).join(true.select("session_id", "sequence", F.col("pose").alias("t")), ["session_id", "sequence"])
    d = F.sqrt(sum(((F.col(f"e.{c}") - F.col(f"t.{c}")) ** 2 for c in ("ty", "tz")), (F.col("e.tx") - F.col("t.tx")) ** 2))
    return j.withColumn("d", d).groupBy("session_id").agg(F.avg("d").alias("mean_error"), F.max_by("d", "sequence").alias("end_error"))


@dataclass
class Aligned:
    keyframes: DataFrame
    loops: DataFrame
    corrected: DataFrame
    poses: DataFrame
    tails: DataFrame


def align(batches: DataFrame, points: DataFrame, cfg: Config = Config()) -> Aligned:
    """The whole of it; batches: session_id, sequence, pose_sequence, point_count, pose."""
    kfs = keyframes(batches, cfg).persist()
    loops = verified_loops(loop_candidates(kfs, cfg), kfs, clouds(points, kfs, cfg), cfg).persist()
    corrected = optimised(kfs, loops).persist()
    return Aligned(kfs, loops, corrected, *propagated(batches, kfs, corrected))


def chained(steps: DataFrame) -> DataFrame:
    """World poses as the running product of relative poses (session_id, k, pose columns), in order."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k").reset_index(drop=True)
        m, rows = np.eye(4), []
        for k, step in zip(part["k"], _matrices(part), strict=True):
            m = m @ step
            rows.append((part["session_id"][0], int(k), *pose_row(m)))
        return pd.DataFrame(rows, columns=["session_id", "k", *POSES])

    return steps.groupBy("session_id").applyInPandas(run, f"session_id string, k int, {_FLAT}")
