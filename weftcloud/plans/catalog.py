"""The registered queries of the engine's own operators over the driver's tables, with their SQL twins.

Floating aggregates are summed as whole micro-units, so results don't depend on the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import formats, geometry as geo
from ..functions.geometry import micro
from ..functions.views import Camera, distance_to_box
from ..operators import alignment, corrections, fusion, observation, serving, sessions
from ..sources import batch_log, packets, synthetic
from . import fixtures as fx
from .fixtures import CHUNK, CTES, FUSE, LEVELS, LOCAL_SQL, POSES_SQL, WORLD_SQL, micro_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def placed(spark: SparkSession, d: str) -> DataFrame:
    """World points with cells, coordinates in whole micro-units."""
    out = fusion.placed(fx.posed(spark, d), CHUNK, FUSE)
    return out.withColumns({a: micro(F.col(a)) for a in "xyz"})


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """Fused voxels with ordinals, sums in metres again."""
    fused = fusion.fuse(placed(spark, d))
    return fusion.with_ordinal(fused.withColumns({s: F.col(s) / 1e6 for s in ("sx", "sy", "sz")}))


VOX = "session_id, cx, cy, cz, vx, vy, vz"
CHK = "session_id, cx, cy, cz"
_REP = "CAST(sx / n AS FLOAT) AS x, CAST(sy / n AS FLOAT) AS y, CAST(sz / n AS FLOAT) AS z, " + ", ".join(f"CAST(greatest(least(floor(s{c[0]} / CAST(n AS DOUBLE) + 0.5), {t}), 0) AS INTEGER) AS {c}" for c, t in (("r", 255), ("g", 255), ("b", 255), ("intensity", 65535)))


def rep_micro(rows: DataFrame) -> DataFrame:
    return rows.withColumns({a: micro(F.col(a).cast("double")) for a in "xyz"})


def rep_micro_sql(inner: str, cols: str) -> str:
    return f"SELECT {cols}, " + ", ".join(f"{micro_sql(f'CAST({a} AS DOUBLE)')} AS {a}" for a in "xyz") + f", r, g, b, intensity FROM ({inner})"


@query("voxel-fusion", CTES + f"SELECT {VOX}, sx, sy, sz, sr, sg, sb, si, n, first_seq, first_idx, last_seq FROM fused")
def voxel_fusion(spark, d):
    return fusion.fuse(placed(spark, d))


@query("local-to-world", f"WITH {POSES_SQL}, {LOCAL_SQL}, {WORLD_SQL} SELECT session_id, sequence, idx, {', '.join(f'{micro_sql(a)} AS {a}' for a in 'xyz')} FROM world")
def local_to_world(spark, d):
    return placed(spark, d).select("session_id", "sequence", "idx", "x", "y", "z")


@query("pose-join-missing", "SELECT l_orderkey AS pose_sequence, count(*) AS points FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL GROUP BY 1")
def pose_join_missing(spark, d):
    known = fx.poses(spark, d).where("pose_sequence % 7 <> 0").withColumn("session_id", F.lit("s"))
    return sessions.without_pose(fx.points(spark, d).withColumn("session_id", F.lit("s")), known).groupBy("pose_sequence").agg(F.count(F.lit(1)).alias("points"))


_R = fx.rotate_sql("a.", ("b.tx", "b.ty", "b.tz"))
_MUL = ("a.qw * b.qx + a.qx * b.qw + a.qy * b.qz - a.qz * b.qy", "a.qw * b.qy - a.qx * b.qz + a.qy * b.qw + a.qz * b.qx", "a.qw * b.qz + a.qx * b.qy - a.qy * b.qx + a.qz * b.qw", "a.qw * b.qw - a.qx * b.qx - a.qy * b.qy - a.qz * b.qz")


@query("pose-compose", f"WITH {POSES_SQL} SELECT a.pose_sequence, " + ", ".join(f"{micro_sql(f'({r} + a.t{c})')} AS t{c}" for r, c in zip(_R, "xyz", strict=True)) + ", " + ", ".join(f"{micro_sql(f'({m})')} AS q{c}" for m, c in zip(_MUL, "xyzw", strict=True)) + " FROM poses a JOIN poses b ON b.pose_sequence = a.pose_sequence + 1")
def pose_compose(spark, d):
    p = fx.poses(spark, d)
    b = p.select((F.col("pose_sequence") - 1).alias("pose_sequence"), F.col("pose").alias("b"))
    out = p.select("pose_sequence", F.col("pose").alias("a")).join(b, "pose_sequence").withColumn("c", geo.compose(F.col("a"), F.col("b")))
    return out.select("pose_sequence", *[micro(F.col(f"c.{k}")).alias(k) for k in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])


_INV = fx.rotate_sql("", ("tx", "ty", "tz"), back=True)


@query("pose-inverse", f"WITH {POSES_SQL} SELECT pose_sequence, " + ", ".join(f"{micro_sql(f'(-{r})')} AS t{c}" for r, c in zip(_INV, "xyz", strict=True)) + " FROM poses")
def pose_inverse(spark, d):
    return fx.poses(spark, d).withColumn("i", geo.inverse(F.col("pose"))).select("pose_sequence", *[micro(F.col(f"i.{k}")).alias(k) for k in ("tx", "ty", "tz")])


@query("chunk-keys", CTES + "SELECT DISTINCT session_id, cx || '_' || cy || '_' || cz AS chunk_key, cx * CAST(16.0 AS DOUBLE) AS low_x, (cx + 1) * CAST(16.0 AS DOUBLE) AS high_x FROM placed")
def chunk_keys(spark, d):
    keys = placed(spark, d).select("session_id", geo.key_text("cx", "cy", "cz").alias("chunk_key")).distinct()
    low, high = geo.box(geo.key_cells(F.col("chunk_key")), CHUNK)
    return keys.select("session_id", "chunk_key", low[0].alias("low_x"), high[0].alias("high_x"))


_Q4 = {a: f"CAST(greatest(least(floor({e} / CAST(0.004 AS DOUBLE) + CAST(0.5 AS DOUBLE)), 32767), -32768) AS INTEGER)" for a, e in (("x", "l_quantity"), ("y", "l_extendedprice / CAST(500.0 AS DOUBLE)"), ("z", "(l_discount + l_tax)"))}


@query("format-q4", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{e} AS q{a}" for a, e in _Q4.items()) + ", CAST(((l_partkey * 37 % 65536) // 256) AS INTEGER) AS i8, CAST(((l_partkey * 37 % 65536) // 256) * 256 AS INTEGER) AS i16, " + micro_sql(f"CAST(CAST({_Q4['x']} * CAST(0.004 AS DOUBLE) AS FLOAT) AS DOUBLE)") + " AS back_x FROM lineitem")
def format_q4(spark, d):
    li = fx.table(spark, d, "lineitem")
    q = {a: formats.q4_encode(e) for a, e in (("x", F.col("l_quantity")), ("y", F.col("l_extendedprice") / 500.0), ("z", F.col("l_discount") + F.col("l_tax")))}
    i8 = formats.intensity8(F.col("l_partkey") * 37 % 65536)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(f"q{a}") for a, v in q.items()], i8.alias("i8"), formats.grey(i8)[1].alias("i16"), micro(formats.q4_decode(q["x"]).cast("double")).alias("back_x"))


@query("format-q8", CTES + "SELECT session_id, sequence, idx, CAST(greatest(least(floor((x - cx * CAST(16.0 AS DOUBLE)) * CAST(256.0 AS DOUBLE) / CAST(16.0 AS DOUBLE)), 255), 0) AS INTEGER) AS qx, " + micro_sql("(cx * CAST(16.0 AS DOUBLE) + (CAST(greatest(least(floor((x - cx * CAST(16.0 AS DOUBLE)) * CAST(256.0 AS DOUBLE) / CAST(16.0 AS DOUBLE)), 255), 0) AS INTEGER) + CAST(0.5 AS DOUBLE)) * CAST(0.0625 AS DOUBLE))") + " AS back_x FROM placed")
def format_q8(spark, d):
    p = fusion.placed(fx.posed(spark, d), CHUNK, FUSE)
    origin = F.col("cx") * F.lit(CHUNK)
    q = formats.q8_encode(F.col("x"), origin, CHUNK)
    return p.select("session_id", "sequence", "idx", q.alias("qx"), micro(formats.q8_decode(q, origin, CHUNK)).alias("back_x"))


@query("colour-range-shade", "SELECT event_id, CAST(255 - floor(coalesce(value / nullif(max(value) OVER (PARTITION BY user_id), 0), 0) * CAST(200.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS shade FROM events")
def colour_range_shade(spark, d):
    top = F.max("value").over(Window.partitionBy("user_id"))
    return fx.table(spark, d, "events").select("event_id", formats.shade(F.col("value"), top).alias("shade"))


@query("voxel-ordinals", CTES + f"SELECT {VOX}, ordinal, first_seq, first_idx FROM voxels")
def voxel_ordinals(spark, d):
    return voxels(spark, d).select(*fusion.VOXEL, F.col("ordinal").cast("bigint").alias("ordinal"), "first_seq", "first_idx")


@query("representatives", CTES + rep_micro_sql(f"SELECT {VOX}, n, {_REP} FROM voxels", f"{VOX}, n"))
def representatives(spark, d):
    return rep_micro(fusion.representatives(voxels(spark, d)))


@query("chunk-stats", CTES + f"SELECT {CHK}, count(*) AS point_count, count(*) * 18 AS bytes, max(last_seq) AS applied_sequence, " + ", ".join(f"{micro_sql(f'{f}(s{a} / n)')} AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + f" FROM voxels GROUP BY {CHK}")
def chunk_stats(spark, d):
    out = fusion.chunk_stats(voxels(spark, d))
    return out.withColumns({f"{n}_{a}": micro(F.col(f"{n}_{a}")) for a in "xyz" for n in ("min", "max")})


def lod_sql(level: int) -> str:
    edge = FUSE * 2 ** (LEVELS - 1 - level)
    cells = ", ".join(f"CAST(floor(CAST({a} AS DOUBLE) / CAST({edge} AS DOUBLE)) AS BIGINT) AS v{a}" for a in "xyz")
    return f""", fine AS (SELECT {CHK}, ordinal, {_REP} FROM voxels),
coarse AS (SELECT {CHK}, vx, vy, vz, sum(CAST(x AS DOUBLE)) AS sx, sum(CAST(y AS DOUBLE)) AS sy, sum(CAST(z AS DOUBLE)) AS sz, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(intensity) AS si, count(*) AS n, min(ordinal) AS first
 FROM (SELECT *, {cells} FROM fine) GROUP BY {CHK}, vx, vy, vz)
"""


for _level in range(LEVELS - 1):

    @query(f"level-of-detail-{_level}", CTES + lod_sql(_level) + rep_micro_sql(f"SELECT {VOX}, n, first, {_REP} FROM coarse", f"{VOX}, n, first"))
    def level_of_detail(spark, d, level=_level):
        out = fusion.level_of_detail(voxels(spark, d), level, LEVELS, FUSE)
        return rep_micro(out).withColumn("first", F.col("first").cast("bigint"))


@query("delta-since", CTES + lod_sql(1) + f"SELECT {CHK}, count(*) AS added, CAST(min(first) AS BIGINT) AS first FROM coarse WHERE first >= 50 GROUP BY {CHK}")
def delta_since(spark, d):
    fresh = fusion.delta(fusion.level_of_detail(voxels(spark, d), 1, LEVELS, FUSE), 50)
    return fresh.groupBy(*fusion.CHUNK).agg(F.count(F.lit(1)).alias("added"), F.min("first").cast("bigint").alias("first"))


@query("observation-hits", CTES + f"SELECT {VOX}, n FROM voxels WHERE n >= 2")
def observation_hits(spark, d):
    return fusion.observed(voxels(spark, d), 2).select(*fusion.VOXEL, "n")


@query("lineage", CTES + "SELECT DISTINCT session_id, sequence, cx, cy, cz FROM placed")
def lineage(spark, d):
    return fusion.touched(placed(spark, d))


@query("fan-out-guard", CTES + "SELECT session_id, sequence, count(DISTINCT (cx, cy, cz)) AS chunks FROM placed GROUP BY 1, 2 HAVING count(DISTINCT (cx, cy, cz)) > 3")
def fan_out_guard(spark, d):
    return sessions.too_wide(placed(spark, d), 3)


@query("replay-idempotence", CTES + f"SELECT session_id, sequence, count(*) AS points FROM placed JOIN (SELECT {CHK}, CAST(max(sequence) AS BIGINT) AS applied FROM placed WHERE sequence % 3 = 0 GROUP BY {CHK}) USING (session_id, cx, cy, cz) WHERE sequence > applied GROUP BY 1, 2")
def replay_idempotence(spark, d):
    p = placed(spark, d)
    applied = p.where("sequence % 3 = 0").groupBy(*fusion.CHUNK).agg(F.max("sequence").alias("applied_sequence"))
    return fusion.only_chunks(fusion.not_applied(p, applied), applied).groupBy("session_id", "sequence").agg(F.count(F.lit(1)).alias("points"))


@query("fusion-merge", CTES + f"SELECT {VOX}, sx, sy, sz, n, first_seq, last_seq FROM fused")
def fusion_merge(spark, d):
    p = placed(spark, d)
    return fusion.merged(fusion.fuse(p.where("sequence % 2 = 0")), fusion.fuse(p.where("sequence % 2 = 1"))).select(*fusion.VOXEL, "sx", "sy", "sz", "n", "first_seq", "last_seq")


@query("cells-union", CTES + f"SELECT DISTINCT {CHK} FROM placed WHERE sequence % 2 = 0 OR sequence % 3 = 0")
def cells_union(spark, d):
    p = placed(spark, d)
    return fusion.all_cells(p.where("sequence % 2 = 0"), p.where("sequence % 3 = 0"))


@query("live-over-stored", CTES + f"SELECT {CHK}, (max(CASE WHEN sequence % 2 = 0 THEN 1 ELSE 0 END) = 1) AS live FROM placed GROUP BY {CHK}")
def live_over_stored(spark, d):
    p = placed(spark, d)
    a, b = (p.where(f"sequence % 2 = {k}").select(*fusion.CHUNK).distinct().withColumn("live", F.lit(k == 0)) for k in (0, 1))
    return fusion.each_once(a, b)


CAMERAS = (Camera((10.0, 5.0, 5.0), (1.0, 0.2, 0.1), fov_y=1.0, viewport=(1280.0, 720.0), near=0.1, far=80.0, name="east"), Camera((40.0, 40.0, 10.0), (-1.0, -1.0, 0.0), fov_y=0.7, viewport=(800.0, 600.0), near=0.5, far=60.0, name="back"))


def _num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def sees_box_sql(c: Camera, low: list[str], high: list[str]) -> str:
    return " AND ".join(f"({' + '.join(f'({h if n >= 0 else lo}) * {_num(n)}' for n, lo, h in zip(p[:3], low, high, strict=True))} + {_num(p[3])} >= 0)" for p in c.planes)


def distance_sql(c: Camera, low: list[str], high: list[str]) -> str:
    parts = [f"greatest({lo} - {_num(p)}, 0, {_num(p)} - {hi})" for p, lo, hi in zip(c.position, low, high, strict=True)]
    return f"sqrt({' + '.join(f'{p} * {p}' for p in parts)})"


_LOW = [f"(c{a} * CAST(16.0 AS DOUBLE))" for a in "xyz"]
_HIGH = [f"(c{a} * CAST(16.0 AS DOUBLE) + CAST(16.0 AS DOUBLE))" for a in "xyz"]


def level_sql(c: Camera, px: float) -> str:
    away = distance_sql(c, _LOW, _HIGH)
    desired = f"(greatest({away}, {_num(c.near)}) * {_num(px * 2 * c.tan_y / c.viewport[1])})"
    steps = " + ".join(f"CASE WHEN {desired} >= {_num(FUSE * 2.0**k)} THEN 1 ELSE 0 END" for k in range(1, LEVELS))
    return f"SELECT '{c.name}' AS viewer_id, {CHK}, CAST({LEVELS - 1} - ({steps}) AS INTEGER) AS level FROM cells WHERE {sees_box_sql(c, _LOW, _HIGH)} AND {away} <= {_num(c.far)}"


_PX = 60.0
VIEW_SQL = CTES + f", cells AS (SELECT DISTINCT {CHK} FROM placed), visible AS (" + " UNION ALL ".join(level_sql(c, _PX) for c in CAMERAS) + ")\n"


def visible(spark: SparkSession, d: str) -> DataFrame:
    return serving.in_view(fusion.all_cells(placed(spark, d)), CAMERAS, CHUNK, FUSE, LEVELS, _PX)


@query("view-selection", VIEW_SQL + "SELECT * FROM visible")
def view_selection(spark, d):
    return visible(spark, d)


def held_of(v: DataFrame, even: bool = True) -> DataFrame:
    """A made-up viewer state: half of the visible chunks, some with another level."""
    return v.where("(cx + cy + cz) % 2 = 0").select("viewer_id", *fusion.CHUNK, F.when(F.col("cx") % 3 == 0, 0).otherwise(F.col("level")).alias("level"))


@query("view-diff", VIEW_SQL + f", held AS (SELECT viewer_id, {CHK}, CASE WHEN cx % 3 = 0 THEN 0 ELSE level END AS held_level FROM visible WHERE (cx + cy + cz) % 2 = 0), now AS (SELECT * FROM visible WHERE cz >= 0) "
       "SELECT viewer_id, session_id, cx, cy, cz, coalesce(level, -1) AS level, coalesce(held_level, -1) AS held_level, CASE WHEN level IS NULL THEN 'chunk_drop' ELSE 'chunk_keyframe' END AS action FROM now FULL JOIN held USING (viewer_id, session_id, cx, cy, cz) WHERE level IS NULL OR held_level IS NULL OR level <> held_level")  # fmt: skip
def view_diff(spark, d):
    v = visible(spark, d)
    return serving.view_diff(v.where("cz >= 0"), held_of(v)).fillna(-1, ["level", "held_level"])


_TOTALS = f"totals AS (SELECT viewer_id, {CHK}, v.level, count(*) AS version, count(*) AS total, sum(CASE WHEN ordinal >= 20 THEN 1 ELSE 0 END) AS added FROM visible v JOIN voxels USING (session_id, cx, cy, cz) GROUP BY viewer_id, {CHK}, v.level)"


@query("refresh-decision", VIEW_SQL + f", {_TOTALS}, held AS (SELECT viewer_id, {CHK}, CASE WHEN cx % 3 = 0 THEN 0 ELSE level END AS held_level, 20 AS held_version, CASE WHEN cy % 3 = 0 THEN 19 ELSE 20 END AS held_count, 15 AS keyframe_version FROM visible WHERE (cx + cy + cz) % 2 = 0), now AS (SELECT * FROM visible WHERE cz >= 0) "
       "SELECT viewer_id, session_id, cx, cy, cz, CASE WHEN n.level IS NULL THEN 'chunk_drop' WHEN held_level IS NULL OR held_level <> n.level OR total <> held_count + added OR version >= 30 THEN 'chunk_keyframe' WHEN added = 0 THEN 'advance' ELSE 'chunk_delta' END AS action FROM now n FULL JOIN held USING (viewer_id, session_id, cx, cy, cz) LEFT JOIN totals t USING (viewer_id, session_id, cx, cy, cz)")  # fmt: skip
def refresh_decision(spark, d):
    v, vox = visible(spark, d), voxels(spark, d)
    totals = v.join(vox, fusion.CHUNK).groupBy("viewer_id", *fusion.CHUNK).agg(F.count(F.lit(1)).alias("version"), F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("ordinal") >= 20, 1).otherwise(0)).alias("added"))
    held = held_of(v).select("*", F.lit(20).alias("version"), F.when(F.col("cy") % 3 == 0, 19).otherwise(20).alias("count"), F.lit(15).alias("keyframe_version"))
    return serving.refresh(v.where("cz >= 0"), held, totals).select("viewer_id", *fusion.CHUNK, "action")


def sees_point_sql(c: Camera) -> str:
    return " AND ".join(f"(x * {_num(p[0])} + y * {_num(p[1])} + z * {_num(p[2])} + {_num(p[3])} >= 0)" for p in c.planes)


@query("live-overlay", CTES + ", seen AS (" + " UNION ALL ".join(f"SELECT '{c.name}' AS viewer_id, session_id, sequence, idx FROM world WHERE {sees_point_sql(c)}" for c in CAMERAS) + "), numbered AS (SELECT *, row_number() OVER (PARTITION BY viewer_id, session_id, sequence ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY viewer_id, session_id, sequence) AS n FROM seen) "
       "SELECT viewer_id, session_id, sequence, idx FROM numbered WHERE n <= 3 OR EXISTS (SELECT 1 FROM (VALUES (0), (1), (2)) j(j) WHERE j * n // 3 = i)")  # fmt: skip
def live_overlay(spark, d):
    world = fusion.placed(fx.posed(spark, d), CHUNK, FUSE)
    return serving.overlay(world, CAMERAS, 3).select("viewer_id", "session_id", "sequence", "idx")


@query("box-distance", CTES + f"SELECT DISTINCT {CHK}, {micro_sql(distance_sql(CAMERAS[0], _LOW, _HIGH))} AS away FROM placed")
def box_distance(spark, d):
    low, high = geo.box((F.col("cx"), F.col("cy"), F.col("cz")), CHUNK)
    return fusion.all_cells(placed(spark, d)).select(*fusion.CHUNK, micro(distance_to_box(CAMERAS[0].position, low, high)).alias("away"))


@query("bootstrap", CTES + f"SELECT {CHK}, count(*) AS point_count, 'chunk_bootstrap' AS action FROM voxels GROUP BY {CHK}")
def bootstrap(spark, d):
    points = voxels(spark, d).select(*fusion.CHUNK, "ordinal", *fusion.representative())
    return serving.bootstrap(points).drop("points")


@query("traffic", VIEW_SQL + "SELECT 'level ' || level AS action, count(*) AS messages, CAST(sum(18 * version) AS BIGINT) AS bytes FROM visible JOIN (SELECT session_id, cx, cy, cz, count(*) AS version FROM voxels GROUP BY ALL) USING (session_id, cx, cy, cz) GROUP BY 1")
def traffic(spark, d):
    sent = visible(spark, d).join(fusion.versions(voxels(spark, d)), fusion.CHUNK)
    return serving.traffic(sent.select(F.concat(F.lit("level "), F.col("level")).alias("action"), (F.col("version") * 18).alias("bytes")))


# corrections

_CORR = f"""corr AS (SELECT pose_sequence AS cp, tx + 3 AS ntx FROM poses WHERE o_orderpriority = '1-URGENT' AND pose_sequence % 5 = 0),
lastc AS (SELECT max(cp) AS lc FROM corr)"""
_EFF = f"""WITH {POSES_SQL}, {_CORR}, eff AS (SELECT s.session_id, p.pose_sequence, coalesce(ntx, tx) AS tx, CASE WHEN cp IS NULL AND s.session_id = 'A' AND p.pose_sequence > lc THEN ty + 1 ELSE ty END AS ty, tz, qx, qy, qz, qw
 FROM (SELECT DISTINCT l_returnflag AS session_id, l_orderkey AS pose_sequence FROM lineitem) s JOIN poses p USING (pose_sequence) LEFT JOIN corr ON cp = p.pose_sequence CROSS JOIN lastc)"""


@query("effective-pose", _EFF + f" SELECT session_id, pose_sequence, {', '.join(f'{micro_sql(f't{a}')} AS t{a}' for a in 'xyz')} FROM eff")
def effective_pose(spark, d):
    out = corrections.effective(fx.batches(spark, d), *fx.corrections(spark, d))
    return out.select("session_id", "pose_sequence", *[micro(F.col(f"effective.t{a}")).alias(f"t{a}") for a in "xyz"])


@query("moved-batches", _EFF + " SELECT session_id, eff.pose_sequence AS sequence FROM eff JOIN poses p USING (pose_sequence) WHERE (eff.tx - p.tx) * (eff.tx - p.tx) + (eff.ty - p.ty) * (eff.ty - p.ty) > 1.0")
def moved_batches(spark, d):
    b = corrections.effective(fx.batches(spark, d), *fx.corrections(spark, d)).withColumn("fused", F.col("pose"))
    return corrections.changed(b, FUSE / 2).select("session_id", "sequence")


_RW = fx.rotate_sql("", ("lx", "ly", "lz"))


@query("partial-rebuild", _EFF + f""", {LOCAL_SQL}, used AS (SELECT eff.session_id, eff.pose_sequence, CASE WHEN (eff.tx - p.tx) * (eff.tx - p.tx) + (eff.ty - p.ty) * (eff.ty - p.ty) > 1.0 THEN eff.tx ELSE p.tx END AS tx, CASE WHEN (eff.tx - p.tx) * (eff.tx - p.tx) + (eff.ty - p.ty) * (eff.ty - p.ty) > 1.0 THEN eff.ty ELSE p.ty END AS ty, p.tz, p.qx, p.qy, p.qz, p.qw FROM eff JOIN poses p USING (pose_sequence)),
w AS (SELECT l.session_id, sequence, {_RW[0]} + tx AS x, {_RW[1]} + ty AS y, {_RW[2]} + tz AS z FROM local l JOIN used u ON u.session_id = l.session_id AND u.pose_sequence = l.pose_sequence)
SELECT session_id, {fx.cells_sql()}, count(*) AS n, min(sequence) AS first_seq, max(sequence) AS last_seq FROM w GROUP BY ALL""")  # fmt: skip
def partial_rebuild(spark, d):
    b = corrections.effective(fx.batches(spark, d), *fx.corrections(spark, d)).select("session_id", "sequence", F.col("pose").alias("fused"), "effective")
    before = placed(spark, d)
    out = corrections.rebuild(fx.points(spark, d), b, fusion.fuse(before), fusion.touched(before), CHUNK, FUSE)
    return out.voxels.select(*fusion.VOXEL, "n", "first_seq", "last_seq")


@query("replay-set", _EFF + f""", {LOCAL_SQL}, {WORLD_SQL}, placed AS (SELECT *, {fx.cells_sql()} FROM world), moved AS (SELECT eff.session_id, eff.pose_sequence AS sequence FROM eff JOIN poses p USING (pose_sequence) WHERE (eff.tx - p.tx) * (eff.tx - p.tx) + (eff.ty - p.ty) * (eff.ty - p.ty) > 1.0),
span AS (SELECT DISTINCT session_id, cx, cy, cz FROM placed SEMI JOIN moved USING (session_id, sequence)) SELECT DISTINCT session_id, sequence FROM placed SEMI JOIN span USING (session_id, cx, cy, cz)""")  # fmt: skip
def replay_set(spark, d):
    b = corrections.effective(fx.batches(spark, d), *fx.corrections(spark, d)).withColumn("fused", F.col("pose"))
    moved = corrections.changed(b, FUSE / 2).select("session_id", "sequence")
    span = fusion.touched(placed(spark, d))
    old = span.join(moved, ["session_id", "sequence"], "left_semi")
    return corrections.replay_set(span, corrections.affected_chunks(old, old), moved)


@query("correction-problems", "SELECT o_custkey AS pose_sequence, 'pose sequence occurs twice' AS reason FROM orders WHERE o_custkey > 0 GROUP BY o_custkey HAVING count(*) > 1")
def correction_problems(spark, d):
    p = fx.poses(spark, d).select(F.lit("s").alias("session_id"), (F.col("o_custkey")).alias("pose_sequence"), F.col("pose").alias("corrected"))
    return corrections.problems(p.where("pose_sequence > 0")).select("pose_sequence", "reason")


# observation

_FOV = observation.FieldOfView(-15.0, 15.0, 30.0, 2.0)
_LO, _HI = (math.sin(math.radians(v)) for v in (-17.0, 17.0))


def fov_sql() -> str:
    local = fx.rotate_sql("", ("dx", "dy", "dz"), back=True)
    steps = "(VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(1.0 AS DOUBLE)))"
    inside = " AND ".join(f"t{a} BETWEEN c{a} * CAST(16.0 AS DOUBLE) AND c{a} * CAST(16.0 AS DOUBLE) + CAST(16.0 AS DOUBLE)" for a in "xyz")
    return f"""touched AS (SELECT DISTINCT session_id, cx, cy, cz, sequence FROM placed), born AS (SELECT session_id, cx, cy, cz, min(sequence) AS born FROM touched GROUP BY ALL),
stood AS (SELECT DISTINCT session_id, sequence, tx, ty, tz, qx, qy, qz, qw FROM placed JOIN poses USING (pose_sequence)), kinds AS (SELECT DISTINCT session_id, tx, ty, tz, qx, qy, qz, qw FROM stood),
lattice AS (SELECT *, cx * CAST(16.0 AS DOUBLE) + i.i * CAST(16.0 AS DOUBLE) - tx AS dx, cy * CAST(16.0 AS DOUBLE) + j.j * CAST(16.0 AS DOUBLE) - ty AS dy, cz * CAST(16.0 AS DOUBLE) + k.k * CAST(16.0 AS DOUBLE) - tz AS dz FROM born JOIN kinds USING (session_id), {steps} i(i), {steps} j(j), {steps} k(k)),
local_z AS (SELECT *, dx * dx + dy * dy + dz * dz AS r2, {local[2]} AS lz FROM lattice),
views AS (SELECT DISTINCT session_id, cx, cy, cz, born, tx, ty, tz, qx, qy, qz, qw FROM local_z WHERE ({inside}) OR (r2 <= 900 AND lz >= sqrt(r2) * {_num(_LO)} AND lz <= sqrt(r2) * {_num(_HI)})),
seen AS (SELECT session_id, cx, cy, cz, sequence FROM views JOIN stood USING (session_id, tx, ty, tz, qx, qy, qz, qw) WHERE sequence >= born UNION SELECT session_id, cx, cy, cz, sequence FROM touched)
"""


def qualifying(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    every = placed(spark, d)
    return every, observation.qualifying(fx.batches(spark, d), fusion.touched(every), CHUNK, _FOV)


@query("opportunities", CTES + ", " + fov_sql() + f"SELECT {CHK}, count(*) AS opportunities FROM seen GROUP BY {CHK}")
def opportunities(spark, d):
    return observation.counted(fx.batches(spark, d), fusion.touched(placed(spark, d)), CHUNK, _FOV)


@query("voxel-baseline", CTES + ", " + fov_sql() + f", run AS (SELECT *, count(*) OVER (PARTITION BY {CHK} ORDER BY sequence) AS so_far, count(*) OVER (PARTITION BY {CHK}) AS opportunities FROM seen), vox AS (SELECT {VOX}, count(*) AS n, min(sequence) AS first_seq FROM placed GROUP BY ALL) SELECT {VOX}, n, so_far AS o0, opportunities FROM vox JOIN run USING (session_id, cx, cy, cz) WHERE run.sequence = first_seq AND n / CAST(greatest(opportunities - so_far + 1, 1) AS DOUBLE) >= 0.1")
def voxel_baseline(spark, d):
    every = placed(spark, d)
    counters = observation.with_counters(fusion.fuse(every), fx.batches(spark, d), fusion.touched(every), CHUNK, _FOV)
    return fusion.observed(counters, 1, 0.1).select(*fusion.VOXEL, "n", "o0", "opportunities")


# sessions and messages

_EV = "ev AS (SELECT user_id, event_id, event_type, value, ts, CAST(floor(value) AS BIGINT) % 50 AS seq FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").withColumn("seq", (F.floor("value").cast("bigint") % 50))


@query("monotone-dedupe", f"WITH {_EV} SELECT event_id, user_id, seq FROM (SELECT *, coalesce(max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM ev) WHERE seq > top")
def monotone_dedupe(spark, d):
    return sessions.monotone(events(spark, d), "user_id", "seq", "event_id").select("event_id", "user_id", "seq")


@query("strict-sequence", f"""WITH RECURSIVE {_EV}, acc AS (SELECT user_id, CAST(1 AS BIGINT) AS n, min(event_id) AS took FROM ev WHERE seq = 1 GROUP BY user_id
 UNION ALL SELECT a.user_id, a.n + 1, min(e.event_id) FROM acc a JOIN ev e ON e.user_id = a.user_id AND e.seq = a.n + 1 AND e.event_id > a.took GROUP BY a.user_id, a.n)
SELECT event_id, (SELECT count(*) FROM acc WHERE acc.user_id = ev.user_id AND acc.took < ev.event_id) + 1 AS expected, event_id IN (SELECT took FROM acc) AS in_order FROM ev""")
def strict_sequence(spark, d):
    return sessions.strict_sequence(events(spark, d), "user_id", "seq", "event_id").select("event_id", "expected", "in_order")


@query("pose-retention", "SELECT session_id, pose_sequence FROM (SELECT l_returnflag AS session_id, l_orderkey AS pose_sequence, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey DESC) AS n FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem)) WHERE n <= 64")
def pose_retention(spark, d):
    return sessions.newest_poses(fx.points(spark, d).select("session_id", "pose_sequence").distinct())


@query("session-counters", "SELECT l_returnflag AS session_id, count(*) AS point_batches, CAST(sum(n) AS BIGINT) AS total_points, max(l_orderkey) AS last_sequence, max(l_orderkey) AS last_pose_sequence FROM (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def session_counters(spark, d):
    return sessions.counters(fx.batches(spark, d).withColumn("ts", F.lit(None).cast("timestamp"))).drop("last_seen")


@query("batch-validation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 7 = 6 THEN 'unknown point format' WHEN l_linenumber % 2 = 1 AND l_suppkey % 5 = 0 THEN 'stride doesn''t fit the format' WHEN l_quantity > 45 THEN 'bad point count' WHEN l_partkey % 11 = 0 THEN 'payload size doesn''t fit' WHEN l_linestatus = 'O' AND l_suppkey % 3 = 0 THEN 'bad encoding' END AS reason FROM lineitem")
def batch_validation(spark, d):
    li = fx.table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 7 == 6, "other").when(F.col("l_linenumber") % 2 == 1, "xyzi_q4_v2").otherwise("xyz_rgb_i_v1")
    stride = F.when((F.col("l_linenumber") % 2 == 1) & (F.col("l_suppkey") % 5 == 0), 18).when(F.col("l_linenumber") % 2 == 1, 7).otherwise(18)
    rows = li.withColumns({"point_format": kind, "stride_bytes": stride, "point_count": F.col("l_quantity").cast("int"), "pose_sequence": F.col("l_orderkey") + 1, "compression": F.lit("none")})
    rows = rows.withColumn("payload_bytes", F.col("point_count") * F.col("stride_bytes") + F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0))
    rows = rows.withColumn("encoding", F.when((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 == 0), "text").otherwise("binary_le"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sessions.batch_reason(45).alias("reason"))


@query("pose-validation", "SELECT s_suppkey, CASE WHEN abs(sqrt(q * q + CAST(0.64 AS DOUBLE)) - 1) <= 0.05 THEN NULL ELSE 'quaternion isn''t normalised' END AS reason FROM (SELECT s_suppkey, (s_suppkey % 10) / CAST(10.0 AS DOUBLE) AS q FROM supplier)")
def pose_validation(spark, d):
    q = (F.col("s_suppkey") % 10) / F.lit(10.0)
    rows = fx.table(spark, d, "supplier").withColumn("pose", geo.pose_of((0.0, 0.0, 0.0), (0.0, 0.0, q, 0.8)))
    return rows.select("s_suppkey", sessions.checked_pose(F.col("pose"))[0].alias("reason"))


@query("identifier-check", r"SELECT c_custkey, regexp_matches(replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '#' ELSE '-' END), '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS ok FROM customer")
def identifier_check(spark, d):
    name = F.replace(F.col("c_name"), F.lit("#"), F.when(F.col("c_custkey") % 2 == 0, "#").otherwise("-"))
    return fx.table(spark, d, "customer").select("c_custkey", sessions.identifier_ok(name).alias("ok"))


@query("message-kind", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 2 THEN 'batch' ELSE 'invalid' END AS kind FROM events")
def message_kind(spark, d):
    """Control messages with a type, with a number as type and without; frames whose header is JSON and isn't; and no JSON."""
    k, header = F.col("event_id") % 6, F.when(F.col("event_id") % 6 == 2, F.lit('{"sequence":1}')).otherwise(F.lit("{sequence"))
    text = F.when(k == 0, F.to_json(F.struct(F.col("event_type").alias("type")))).when(k == 1, F.col("props")).when(k == 3, F.to_json(F.struct(F.col("event_id").alias("type")))).otherwise(F.lit("not json"))
    framed = batch_log.frame_of(header, F.col("props").cast("binary"))
    return fx.table(spark, d, "events").select("event_id", batch_log.message_kind(F.when(k.isin(2, 5), framed).otherwise(text.cast("binary"))).alias("kind"))


@query("binding-conflicts", "SELECT 'session' AS scope, CAST(l_suppkey AS VARCHAR) AS name, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1 UNION ALL SELECT 'connection', CAST(l_partkey AS VARCHAR), count(DISTINCT l_suppkey) FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def binding_conflicts(spark, d):
    li = fx.table(spark, d, "lineitem")
    return sessions.binding_conflicts(li.select(F.col("l_partkey").cast("string").alias("connection"), F.col("l_suppkey").cast("string").alias("session_id"), F.col("l_returnflag").alias("publisher_id")))


@query("logs-without-session", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS session_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def logs_without_session(spark, d):
    from ..operators.storage import logs_without_session as missing

    logs = fx.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"))
    return missing(logs, fx.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("session_id")))


@query("storage-summary", CTES + ", st AS (SELECT session_id, cx, cy, cz, count(*) AS p FROM voxels GROUP BY ALL) SELECT (SELECT count(DISTINCT session_id) FROM local) AS sessions, (SELECT count(*) FROM st) AS chunks, (SELECT CAST(sum(18 * p) AS BIGINT) FROM st) AS bytes, (SELECT CAST(sum(p) AS BIGINT) FROM st) AS points, (SELECT count(DISTINCT (session_id, sequence)) FROM local) AS batches, (SELECT count(*) * 7 FROM local) AS log_bytes")
def storage_summary(spark, d):
    from ..operators.storage import storage_summary as summary

    b = fx.batches(spark, d).withColumn("payload_bytes", F.col("point_count") * 7)
    return summary(b.select("session_id").distinct(), fusion.chunk_stats(voxels(spark, d)), b)


# spins and packets

_SP = "az AS (SELECT user_id, event_id, ts, CAST((extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + floor(extract('second' FROM ts))) AS DOUBLE) * 360 / 86400 AS azimuth, CAST((extract('minute' FROM ts) * 60 + floor(extract('second' FROM ts))) AS BIGINT) * 1000000 AS us FROM events)"


def returns(spark: SparkSession, d: str) -> DataFrame:
    ev = fx.table(spark, d, "events")
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return ev.select("user_id", "event_id", (s.cast("double") * 360 / 86400).alias("azimuth"), ((F.minute("ts") * 60 + F.second("ts")).cast("bigint") * 1000000).alias("us"))


_SPINS = f"WITH {_SP}, f AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS spin_id FROM (SELECT *, CASE WHEN azimuth + 180 < lag(azimuth) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS n FROM az)), spins AS (SELECT user_id, event_id, spin_id, us FROM (SELECT *, count(*) OVER (PARTITION BY user_id, spin_id) AS c, max(spin_id) OVER (PARTITION BY user_id) AS l FROM f) WHERE spin_id > 0 AND spin_id < l AND c >= 2)"


@query("spins", _SPINS + " SELECT user_id, event_id, CAST(spin_id AS BIGINT) AS spin_id FROM spins")
def spins(spark, d):
    return packets.spins(returns(spark, d), ["user_id"], ["event_id"], least=2).select("user_id", "event_id", "spin_id")


@query("spin-fraction", _SPINS + " SELECT event_id, " + micro_sql("(CASE WHEN max(event_id) OVER w > min(event_id) OVER w THEN CAST(event_id - min(event_id) OVER w AS DOUBLE) / (max(event_id) OVER w - min(event_id) OVER w) ELSE 0 END)") + " AS fraction FROM spins WINDOW w AS (PARTITION BY user_id, spin_id)")
def spin_fraction(spark, d):
    out = packets.spin_fraction(packets.spins(returns(spark, d), ["user_id"], ["event_id"], least=2), ["user_id", "spin_id"], "event_id", ["event_id"])
    return out.select("event_id", micro(F.col("fraction")).alias("fraction"))


@query("hour-rollover", f"WITH {_SP} SELECT event_id, us + CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS t_us FROM (SELECT *, CASE WHEN us + 1800000000 < lag(us) OVER (PARTITION BY user_id ORDER BY event_id) THEN 3600000000 ELSE 0 END AS n FROM az)")
def hour_rollover(spark, d):
    return packets.unrolled_time(returns(spark, d), ["user_id"], ["event_id"], "us").select("event_id", "t_us")


@query("local-bounds", "SELECT l_returnflag AS session_id, l_orderkey AS sequence, min(l_quantity) AS min_x, max(l_quantity) AS max_x FROM lineitem GROUP BY 1, 2")
def local_bounds(spark, d):
    return packets.local_bounds(fx.points(spark, d), "session_id", "sequence").select("session_id", "sequence", "min_x", "max_x")


@query("packet-windows", "SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS BIGINT) AS batch, event_id FROM events")
def packet_windows(spark, d):
    from ..streaming.live import packet_batches

    return packet_batches(fx.table(spark, d, "events"), "user_id", "event_id").select("user_id", "batch", "event_id")


@query("point-rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, sum(event_id % 100) AS points FROM events GROUP BY 1".replace("sum(event_id % 100)", "CAST(sum(event_id % 100) AS BIGINT)"))
def point_rate(spark, d):
    from ..streaming.live import point_rate as rate

    return rate(fx.table(spark, d, "events").withColumn("point_count", F.col("event_id") % 100), width="1 hour")


@query("newest-points", "SELECT l_returnflag AS session_id, l_orderkey AS sequence, l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS idx FROM lineitem ORDER BY sequence DESC, idx DESC LIMIT 1000")
def newest_points(spark, d):
    from ..streaming.live import newest_points as newest

    return newest(fx.points(spark, d), 1000).select("session_id", "sequence", "idx")


@query("latency-percentiles", "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT min(value) FILTER (i = CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT)) AS p50, min(value) FILTER (i = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT)) AS p90, max(value) AS max FROM s")
def latency_percentiles(spark, d):
    return serving.percentiles(fx.table(spark, d, "events"), "value")


@query("view-throttle", """WITH RECURSIVE acc AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id
 UNION ALL SELECT a.user_id, min(e.event_id) FROM acc a JOIN events e ON e.user_id = a.user_id AND e.event_id >= a.event_id + 100 GROUP BY a.user_id, a.event_id) SELECT event_id FROM acc""")
def view_throttle(spark, d):
    return serving.throttled(fx.table(spark, d, "events").withColumn("viewer_id", F.col("user_id")), "event_id", 100).select("event_id")


# alignment


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    return e.select(F.lit("s").alias("session_id"), F.col("vec_id").cast("int").alias("kf"), F.col("vec_id").alias("sequence"), *[F.element_at("embedding", k).cast("double").alias(c) for k, c in ((1, "tx"), (2, "ty"), (3, "tz"))])


@query("loop-candidates", "WITH k AS (SELECT CAST(vec_id AS INTEGER) AS kf, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), p AS (SELECT a.kf AS source, b.kf AS target, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM k a JOIN k b ON b.kf <= a.kf - 20), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d2, target) AS rank FROM p WHERE d2 <= CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE)) SELECT source, target, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def loop_candidates(spark, d):
    return alignment.loop_candidates(frames(spark, d), alignment.Config(radius_m=0.1)).select("source", "target", "rank")


@query("odometry-edges", "SELECT CAST(lead(vec_id) OVER (ORDER BY vec_id) AS INTEGER) AS source, CAST(vec_id AS INTEGER) AS target FROM embeddings QUALIFY lead(vec_id) OVER (ORDER BY vec_id) IS NOT NULL")
def odometry_edges(spark, d):
    return alignment.odometry_edges(frames(spark, d)).select("source", "target")


@query("keyframe-as-of", "WITH b AS (SELECT DISTINCT l_returnflag AS session_id, l_orderkey AS sequence FROM lineitem) SELECT * FROM (SELECT session_id, sequence, max(CASE WHEN sequence % 10 = 0 THEN sequence END) OVER (PARTITION BY session_id ORDER BY sequence) AS kf FROM b) WHERE kf IS NOT NULL")
def keyframe_as_of(spark, d):
    b = fx.points(spark, d).select("session_id", "sequence").distinct()
    return alignment.as_of(b, b.where("sequence % 10 = 0").withColumn("kf", F.col("sequence"))).where("kf is not null")


@query("keyframes")
def keyframes(spark, d):
    return alignment.keyframes(fx.batches(spark, d))


@query("packet-decode")
def packet_decode(spark, d):
    made = [(k, bytearray(packets.packet([(k * 300 + 20 * b) % 36000 for b in range(12)], k * 1000, 500 + k))) for k in range(50)]
    rows = spark.createDataFrame(made, "packet_id bigint, packet binary")
    calibration = spark.createDataFrame(packets.vertical_fixture(16))
    return packets.to_cartesian(packets.decode_packets(rows), calibration)


@query("log-scan")
def log_scan(spark, d):
    """Bronze batches packed, framed, and read back from their frames."""
    packed = formats.packed(fx.points(spark, d), ("session_id", "sequence"), "xyzi_q4_v2")
    header = F.to_json(F.struct("session_id", "sequence", F.col("sequence").alias("pose_sequence"), "point_count", F.lit("xyzi_q4_v2").alias("point_format")))
    framed = packed.select(F.concat_ws("/", "session_id", "sequence").alias("path"), batch_log.frame_of(header, F.col("payload")).alias("content"))
    return formats.decode_batches(batch_log.bronze(batch_log.split_frames(framed)))


@query("aligned-loop")
def aligned_loop(spark, d):
    """Mean and end error of a drifting loop before and after alignment."""
    poses = synthetic.loop_poses(spark).withColumn("session_id", F.lit("loop"))
    scans = synthetic.room_scans(poses.select("sequence", F.col("true_pose").alias("pose"))).withColumn("session_id", F.lit("loop"))
    batches = poses.select("session_id", "sequence", "pose_sequence", F.lit(5760).alias("point_count"), "pose")
    done = alignment.align(batches, scans)
    after = batches.join(done.poses, ["session_id", "pose_sequence"]).select("session_id", "sequence", F.col("corrected").alias("pose"))
    true = poses.select("session_id", "sequence", F.col("true_pose").alias("pose"))
    return alignment.accuracy(batches, true).withColumn("state", F.lit("before")).union(alignment.accuracy(after, true).withColumn("state", F.lit("after")))


# further listings, joins and set operations of the inventory


@query("create-session-rules", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'unsupported protocol version' WHEN c_mktsegment = 'BUILDING' THEN 'units must be meters' WHEN c_custkey % 5 = 0 THEN 'bad session id' WHEN c_custkey % 7 = 0 THEN 'bad frame id' WHEN c_custkey % 11 = 0 THEN 'session exists' ELSE 'ok' END AS reason FROM customer")
def create_session_rules(spark, d):
    c = fx.table(spark, d, "customer").withColumns({
        "protocol_version": F.when(F.col("c_nationkey") % 4 == 0, 2).otherwise(1), "session_id": F.when(F.col("c_custkey") % 5 == 0, "-bad").otherwise("s1"), "publisher_id": F.lit("p.1"), "frame_id": F.when(F.col("c_custkey") % 7 == 0, F.repeat(F.lit("m"), 129)).otherwise(F.repeat(F.lit("m"), 128)),
        "units": F.when(F.col("c_mktsegment") == "BUILDING", "feet").otherwise("meters"), "started_at": F.lit("2026-07-10T00:00:00Z"),
    })
    return c.select("c_custkey", F.coalesce(sessions.session_reason(F.col("c_custkey") % 11 == 0), F.lit("ok")).alias("reason"))


@query("view-counter-changes", CTES + ", " + fov_sql() + f", a AS (SELECT {CHK}, sequence FROM seen WHERE sequence % 3 <> 0), b AS (SELECT {CHK}, sequence FROM seen WHERE sequence % 2 = 0), ch AS (SELECT {CHK}, -1 AS c FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT {CHK}, 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)), s AS (SELECT {CHK}, CAST(sum(c) AS BIGINT) AS c FROM ch GROUP BY {CHK}), o AS (SELECT {CHK}, count(*) AS n FROM a GROUP BY {CHK}) SELECT {CHK}, greatest(n + coalesce(c, 0), 0) AS opportunities FROM o LEFT JOIN s USING (session_id, cx, cy, cz)")
def view_counter_changes(spark, d):
    poses = {"before": F.expr("sequence % 3 <> 0"), "after": F.expr("sequence % 2 = 0")}
    counts = observation.counted(fx.batches(spark, d), fusion.touched(placed(spark, d)), CHUNK, _FOV, where=poses)
    return corrections.counter_changes(counts.where("before > 0").withColumn("opportunities", F.col("before")))


@query("dirty-chunks-in-view", VIEW_SQL + f", dirty AS (SELECT DISTINCT {CHK} FROM placed WHERE sequence % 9 = 0) SELECT viewer_id, {CHK}, level FROM visible JOIN dirty USING (session_id, cx, cy, cz)")
def dirty_chunks_in_view(spark, d):
    return serving.touched_in_view(placed(spark, d).where("sequence % 9 = 0"), visible(spark, d)).select("viewer_id", *fusion.CHUNK, "level")


@query("azimuth-steps", "WITH b AS (SELECT user_id AS packet_id, event_id AS block, CAST(event_id * 7 % 360 AS DOUBLE) AS azimuth FROM events), r AS (SELECT *, CASE WHEN raw >= 10 THEN 0 ELSE raw END AS s FROM (SELECT *, (lead(azimuth) OVER w - azimuth + 720) % 360 AS raw FROM b WINDOW w AS (PARTITION BY packet_id ORDER BY block))) SELECT packet_id, block, coalesce(s, lag(s) OVER (PARTITION BY packet_id ORDER BY block), 0) AS step FROM r")
def azimuth_steps(spark, d):
    b = fx.table(spark, d, "events").select(F.col("user_id").alias("packet_id"), F.col("event_id").alias("block"), (F.col("event_id") * 7 % 360).cast("double").alias("azimuth"))
    return packets.azimuth_steps(b).select("packet_id", "block", "step")


@query("index-conflicts", "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0")
def index_conflicts(spark, d):
    from ..operators.storage import index_conflicts as conflicts

    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("session_id"), F.col("o_custkey").alias("sequence"), F.col("o_orderkey").alias("log_offset"))
    log = o.withColumn("sequence", F.when(F.col("o_orderkey") % 13 == 0, F.col("sequence") + 1).otherwise(F.col("sequence")))
    return conflicts(o, log.select("session_id", "sequence", "log_offset")).select("o_orderkey")


@query("backlog-close", "SELECT viewer_id, max(b) AS backlog FROM (SELECT user_id AS viewer_id, CAST(sum(event_id % 1000 - 480) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS b FROM events) GROUP BY 1 HAVING max(b) > 2000")
def backlog_close(spark, d):
    sent = fx.table(spark, d, "events").select(F.col("user_id").alias("viewer_id"), "event_id", (F.col("event_id") % 1000).alias("bytes"), F.lit(480).alias("drained"))
    return serving.closed_by_backlog(sent, "event_id", 2000)


@query("log-lookup", "SELECT l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey = 12")
def log_lookup(spark, d):
    li = fx.table(spark, d, "lineitem").withColumnsRenamed({"l_returnflag": "session_id", "l_orderkey": "sequence"})
    return batch_log.lookup(li, "A", 12).select("l_linenumber", "l_quantity")


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert(spark, d):
    from ..operators.storage import upserted

    c = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return upserted(c, c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("sessions-listing", "SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderdate AS started_at FROM orders")
def sessions_listing(spark, d):
    from ..operators.storage import sessions_listing as listing

    return listing(fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderdate").alias("started_at")))


from . import further  # noqa: E402, F401  registers its queries
