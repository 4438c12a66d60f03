"""More of the registered queries: session and view rules, checkpoints, poses, formats and sessions' own fields of view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, geometry as geo
from ..functions.geometry import micro
from ..operators import alignment, corrections, fusion, observation, serving, sessions
from ..sources import packets
from . import catalog, fixtures as fx
from .catalog import CHK, VOX, query
from .fixtures import CHUNK, CTES, FUSE, LOCAL_SQL, POSES_SQL, WORLD_SQL, micro_sql

D = "CAST({} AS DOUBLE)"


@query("colour-heat", "SELECT p_partkey, " + ", ".join(f"CAST(floor(greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), CAST(1.5 AS DOUBLE) - abs(p_size / CAST(50.0 AS DOUBLE) * CAST(4.0 AS DOUBLE) - {q}))) * CAST(255.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS {c}" for c, q in zip("rgb", (3, 2, 1), strict=True)) + " FROM part")
def colour_heat(spark, d):
    ramp = formats.heat(F.col("p_size") / F.lit(50.0))
    return fx.table(spark, d, "part").select("p_partkey", *[v.alias(c) for v, c in zip(ramp, "rgb", strict=True)])


@query("resume-rules", """WITH s AS (SELECT c_custkey, 'p' || c_nationkey AS owner, c_custkey * 10 AS last_sequence FROM customer WHERE c_custkey % 3 <> 0),
m AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END AS v, 'p' || (c_nationkey + (c_custkey % 5 = 0)::INT) AS publisher_id, c_custkey * 9 + (c_custkey % 4) * 500 + CASE WHEN c_custkey % 17 = 0 THEN 0.5 ELSE 0 END AS top FROM customer)
SELECT m.c_custkey, CASE WHEN v <> 1 THEN 'unsupported protocol version' WHEN top <> floor(top) THEN 'bad last sequence' WHEN owner IS NULL THEN 'unknown session' WHEN owner <> publisher_id THEN 'other publisher' WHEN top > last_sequence THEN 'ahead of the server' ELSE 'ok' END AS reason FROM m LEFT JOIN s USING (c_custkey)""")
def resume_rules(spark, d):
    c, key = fx.table(spark, d, "customer"), F.col("c_custkey")
    known = c.where(key % 3 != 0).select("c_custkey", F.concat(F.lit("p"), "c_nationkey").alias("owner"), (key * 10).alias("last_sequence"))
    asked = c.select("c_custkey", F.when(key % 13 == 0, 2).otherwise(1).alias("protocol_version"), F.concat(F.lit("s"), "c_custkey").alias("session_id"), F.concat(F.lit("p"), F.col("c_nationkey") + (key % 5 == 0).cast("int")).alias("publisher_id"), (key * 9 + (key % 4) * 500 + F.when(key % 17 == 0, 0.5).otherwise(0.0)).alias("last_client_sequence"))
    return asked.join(known, "c_custkey", "left").select("c_custkey", F.coalesce(sessions.resume_reason(), F.lit("ok")).alias("reason"))


@query("close-rules", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown session' WHEN c_custkey % 5 = 0 THEN 'other publisher' WHEN c_custkey % 7 = 0 THEN 'closed' WHEN c_custkey % 11 = 0 THEN 'bad sequence' WHEN c_custkey % 4 = 0 THEN 'out of sequence' ELSE 'ok' END AS reason FROM customer""")
def close_rules(spark, d):
    key = F.col("c_custkey")
    c = fx.table(spark, d, "customer").select("c_custkey", F.when(key % 3 != 0, F.lit("p")).alias("owner"), F.when(key % 5 == 0, "q").otherwise("p").alias("publisher_id"), (key % 7 == 0).alias("closed"), F.when(key % 11 == 0, 0).when(key % 4 == 0, key + 2).otherwise(key + 1).alias("sequence"), key.alias("last_sequence"))
    return c.select("c_custkey", F.coalesce(sessions.close_reason(), F.lit("ok")).alias("reason"))


@query("view-validation", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'bad vectors' WHEN c_custkey % 5 = 0 THEN 'bad viewport' WHEN c_custkey % 7 = 0 THEN 'bad numbers' WHEN c_custkey % 11 = 0 THEN 'zero vectors' WHEN c_custkey % 13 = 0 OR c_nationkey > 20 THEN 'out of bounds'
 WHEN c_custkey % 4 = 1 THEN 'bad overlay cap' WHEN c_custkey % 17 = 0 THEN 'bad hits' WHEN c_custkey % 19 = 0 THEN 'bad ratio' ELSE 'ok' END AS reason FROM customer""")
def view_validation(spark, d):
    key, lit = F.col("c_custkey"), lambda *v: F.array(*[F.lit(float(x)) for x in v])
    c = fx.table(spark, d, "customer").withColumns({
        "position": F.when(key % 3 == 0, lit(0, 1)).otherwise(lit(0, 1, 2)), "forward": F.when(key % 11 == 0, lit(0, 0, 0)).otherwise(lit(1, 0, 0)), "up": lit(0, 0, 1), "viewport_px": F.when(key % 5 == 0, lit(800, float("inf"))).otherwise(lit(800, 600)),
        "fov_y_rad": F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)), "near_m": F.lit(0.1), "far_m": F.when((key % 13 == 0) | (F.col("c_nationkey") > 20), F.lit(0.1)).otherwise(F.lit(50.0)),
        "min_hits": F.when(key % 17 == 0, F.lit(0)), "min_ratio": F.when(key % 19 == 0, F.lit(1.5)), "overlay_max_points": F.when(key % 4 == 1, F.lit(-1)),
    })
    return c.select("c_custkey", F.coalesce(serving.view_reason(), F.lit("ok")).alias("reason"))


_DIRTY_SQL = "dirty AS (SELECT session_id, cx, cy, cz, max(sequence) AS last_seq FROM placed WHERE sequence % 9 = 0 GROUP BY ALL), swept AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY session_id, last_seq DESC, cx, cy, cz) - 1) / 8) AS BIGINT) AS tick FROM dirty)"


def dirty(spark, d):
    return catalog.placed(spark, d).where("sequence % 9 = 0").groupBy(*fusion.CHUNK).agg(F.max("sequence").alias("last_seq"))


@query("checkpoint-sweep", CTES + f", {_DIRTY_SQL} SELECT {CHK}, last_seq, tick FROM swept")
def checkpoint_sweep(spark, d):
    return serving.sweep(dirty(spark, d), 8).select(*fusion.CHUNK, "last_seq", "tick")


@query("log-summary", CTES + f", {_DIRTY_SQL}, b AS (SELECT session_id, count(*) * 18 AS log_bytes, max(sequence) AS last_sequence FROM placed GROUP BY 1), s AS (SELECT session_id, count(*) AS dirty_chunks, CAST(sum((tick >= 3)::INT) AS BIGINT) AS pending FROM swept GROUP BY 1) SELECT session_id, log_bytes, last_sequence, coalesce(dirty_chunks, 0) AS dirty_chunks, coalesce(pending, 0) AS pending FROM b LEFT JOIN s USING (session_id)")
def log_summary(spark, d):
    return serving.log_summary(fx.batches(spark, d), dirty(spark, d), 3, 8)


@query("pose-matrix", f"WITH {POSES_SQL} SELECT pose_sequence, " + ", ".join(f"{micro_sql(e)} AS m{k}" for k, e in enumerate((
    "(1 - 2 * (qy * qy + qz * qz))", "(2 * (qx * qy - qz * qw))", "(2 * (qx * qz + qy * qw))", "tx", "(2 * (qx * qy + qz * qw))", "(1 - 2 * (qx * qx + qz * qz))", "(2 * (qy * qz - qx * qw))", "ty",
    "(2 * (qx * qz - qy * qw))", "(2 * (qy * qz + qx * qw))", "(1 - 2 * (qx * qx + qy * qy))", "tz"))) + " FROM poses")
def pose_matrix(spark, d):
    m = fx.poses(spark, d).withColumn("m", geo.pose_matrix(F.col("pose")))
    return m.select("pose_sequence", *[micro(F.get("m", F.lit(k))).alias(f"m{k}") for k in range(12)])


@query("rotation-angle", f"WITH {POSES_SQL} SELECT pose_sequence, {micro_sql('(2.0 * acos(least(CAST(1.0 AS DOUBLE), abs(qw))))')} AS angle FROM poses")
def rotation_angle(spark, d):
    return fx.poses(spark, d).select("pose_sequence", micro(geo.rotation_angle(F.col("pose"))).alias("angle"))


@query("q8-roundtrip", "SELECT p_partkey, q, " + micro_sql("(CAST(4.0 AS DOUBLE) + (q + CAST(0.5 AS DOUBLE)) * CAST(0.0078125 AS DOUBLE))") + " AS back FROM (SELECT p_partkey, CAST(greatest(least(floor((p_size / CAST(16.0 AS DOUBLE) + CAST(3.5 AS DOUBLE) - 4) * CAST(256.0 AS DOUBLE) / 2), 255), 0) AS INTEGER) AS q FROM part)")
def q8_roundtrip(spark, d):
    q = formats.q8_encode(F.col("p_size") / 16.0 + 3.5, F.lit(4.0), 2.0)
    return fx.table(spark, d, "part").select("p_partkey", q.alias("q"), micro(formats.q8_decode(q, F.lit(4.0), 2.0)).alias("back"))


@query("seeded-voxels", CTES + f", r AS (SELECT {VOX}, {catalog._REP} FROM voxels) SELECT {VOX}, " + ", ".join(f"{micro_sql(f'CAST({c} AS DOUBLE)')} AS s{c[0]}" for c in ("x", "y", "z", "r", "intensity")) + ", CAST(1 AS BIGINT) AS n FROM r")
def seeded_voxels(spark, d):
    back = fusion.seeded(fusion.representatives(catalog.voxels(spark, d)))
    return back.select(*fusion.VOXEL, *[micro(F.col(f"s{c}")).alias(f"s{c}") for c in "xyzri"], "n")


_KINDS = ("create_session", "pose_update", "pose_update", "close_session", "resume_session", "pose_update")
_KIND_SQL = "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_KINDS)) + " END"


@query("session-lifecycle", f"""WITH e AS (SELECT user_id, event_id, {_KIND_SQL} AS type, CAST(event_id % 4 = 1 AS INT) AS publisher, event_id % 40 AS seq FROM events),
w AS (SELECT *, first(CASE WHEN type = 'create_session' THEN publisher END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner,
 last(CASE WHEN type IN ('create_session', 'resume_session') THEN 'open' WHEN type = 'close_session' THEN 'closed' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state,
 coalesce(max(CASE WHEN type NOT IN ('create_session', 'resume_session') THEN seq END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM e)
SELECT event_id, CASE WHEN owner IS NULL THEN 'skipped: no session' WHEN owner <> publisher THEN 'rejected: other publisher' WHEN type = 'create_session' THEN CASE WHEN state IS NULL THEN 'created' ELSE 'reopened' END
 WHEN type = 'resume_session' AND seq > top THEN 'rejected: ahead of the server' WHEN type = 'resume_session' THEN 'resumed' WHEN state = 'closed' THEN 'rejected: closed' WHEN type = 'close_session' THEN 'closed' ELSE 'accepted' END AS verdict FROM w""")
def session_lifecycle(spark, d):
    k = F.col("event_id") % 6
    kind = F.element_at(F.array(*[F.lit(v) for v in _KINDS]), (k + 1).cast("int"))
    e = fx.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("arrival"), kind.alias("type"), (F.col("event_id") % 4 == 1).cast("int").cast("string").alias("publisher_id"), (F.col("event_id") % 40).alias("sequence"))
    return sessions.lifecycle(e).select("event_id", "verdict")


@query("restored-sessions", "SELECT l_returnflag AS session_id, count(*) AS point_batches, max(l_orderkey) AS last_sequence, CAST(NULL AS BIGINT) AS last_pose_sequence FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) GROUP BY 1")
def restored_sessions(spark, d):
    counted = sessions.counters(fx.batches(spark, d).withColumn("ts", F.lit(None).cast("timestamp")))
    return sessions.restored(counted).select("session_id", "point_batches", "last_sequence", "last_pose_sequence")


_OWN = '{"sensor_fov":{"elevation_min_deg":-40,"elevation_max_deg":100,"max_range_m":20}}'


@query("session-view", f"""WITH m AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{_OWN}' WHEN 1 THEN '{{"sensor_fov":{{"max_range_m":"far"}}}}' END AS metadata FROM customer)
SELECT c_custkey, coalesce(TRY_CAST(metadata->>'$.sensor_fov.elevation_min_deg' AS DOUBLE), -15.0) AS lowest, coalesce(TRY_CAST(metadata->>'$.sensor_fov.elevation_max_deg' AS DOUBLE), 15.0) AS highest, coalesce(TRY_CAST(metadata->>'$.sensor_fov.max_range_m' AS DOUBLE), 30.0) AS reach FROM m""")
def session_view(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit(_OWN)).when(F.col("c_custkey") % 3 == 1, F.lit('{"sensor_fov":{"max_range_m":"far"}}'))
    v = fx.table(spark, d, "customer").withColumn("v", observation.session_view(text, catalog._FOV))
    return v.select("c_custkey", F.col("v.lowest_deg").alias("lowest"), F.col("v.highest_deg").alias("highest"), F.col("v.range_m").alias("reach"))


_SIN = "(CASE WHEN session_id = 'A' THEN {} ELSE {} END)"


def _own_fov_sql() -> str:
    """The observation join with session A's own field of view: -40 to 100 degrees, 20 m."""
    import math

    out = catalog.fov_sql()
    out = out.replace("r2 <= 900", "r2 <= CASE WHEN session_id = 'A' THEN 400 ELSE 900 END")
    out = out.replace(catalog._num(catalog._LO), _SIN.format(catalog._num(math.sin(math.radians(-42.0))), catalog._num(catalog._LO)))
    return out.replace(catalog._num(catalog._HI), _SIN.format(catalog._num(2.0), catalog._num(catalog._HI)))


@query("opportunities-own-view", CTES + ", " + _own_fov_sql() + f"SELECT {CHK}, count(*) AS opportunities FROM seen GROUP BY {CHK}")
def opportunities_own_view(spark, d):
    meta = spark.range(1).select(F.lit("A").alias("session_id"), F.lit(_OWN).alias("metadata"))
    return observation.counted(fx.batches(spark, d), fusion.touched(catalog.placed(spark, d)), CHUNK, catalog._FOV, meta)


@query("packet-time", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id * 977 % 4294967296 END AS us FROM events")
def packet_time(spark, d):
    e = fx.table(spark, d, "events")
    us = F.col("event_id") * 977 % 4294967296
    stamp = F.reverse(F.lpad(F.hex(us), 8, "0"))  # nibbles backwards; pairs are turned again below
    little = F.unhex(F.concat(*[F.reverse(F.substring(stamp, k, 2)) for k in (1, 3, 5, 7)]))
    packet = F.concat(F.unhex(F.repeat(F.lit("00"), 1200)), little, F.unhex(F.when(F.col("event_id") % 5 != 0, F.lit("3722")).otherwise(F.lit("37"))))
    return e.select("event_id", packets.packet_time(packet).alias("us"))


@query("payload-check", "SELECT p_partkey, p_size % 7 <> 0 AS finite FROM part")
def payload_check(spark, d):
    x = F.when(F.col("p_size") % 7 == 0, F.lit("0000807f")).otherwise(F.lit("0000803f"))  # infinite, one
    payload = F.unhex(F.concat(x, F.repeat(F.lit("00"), 14)))
    return fx.table(spark, d, "part").select("p_partkey", formats.payload_finite(payload, F.lit("xyz_rgb_i_v1")).alias("finite"))


@query("drift", "WITH f AS (SELECT vec_id % 7 AS s, vec_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings) SELECT CAST(s AS VARCHAR) AS session_id, max(" + micro_sql("sqrt(CAST(x AS DOUBLE) * CAST(x AS DOUBLE) * CAST(0.01 AS DOUBLE) + (CAST(y AS DOUBLE) - CAST(y AS DOUBLE)) + CAST(z AS DOUBLE) * CAST(z AS DOUBLE) * CAST(0.04 AS DOUBLE))") + ") AS most FROM f GROUP BY 1")
def drift(spark, d):
    e = fx.table(spark, d, "embeddings").select((F.col("vec_id") % 7).cast("string").alias("session_id"), F.col("vec_id").cast("int").alias("kf"), *[F.element_at("embedding", k).cast("double").alias(c) for k, c in ((1, "tx"), (2, "ty"), (3, "tz"))])
    moved = e.withColumns({"tx": F.col("tx") * 1.1, "tz": F.col("tz") * 0.8})
    return alignment.drift(e, moved).select("session_id", micro(F.col("max_correction_m")).alias("most"))


def _rebuilt(spark, d, keep):
    """A rebuild in which every `keep`th batch moves by a metre along x, as modes unchanged, partial and full ask for."""
    b = fx.batches(spark, d).withColumn("fused", F.col("pose"))
    p = F.col("pose")
    new = geo.pose_of((p["tx"] + 1.5, p["ty"], p["tz"]), (p["qx"], p["qy"], p["qz"], p["qw"]))
    b = b.withColumn("effective", F.when(F.col("sequence") % keep == 0, new).otherwise(p) if keep else p)
    before = catalog.placed(spark, d)
    return corrections.rebuild(fx.points(spark, d), b, fusion.fuse(before), fusion.touched(before), CHUNK, FUSE)


@query("rebuild-unchanged", CTES + f"SELECT 'unchanged' AS mode, {VOX}, n, first_seq, last_seq FROM fused")
def rebuild_unchanged(spark, d):
    out = _rebuilt(spark, d, 0)
    return out.voxels.select(F.lit(out.mode).alias("mode"), *fusion.VOXEL, "n", "first_seq", "last_seq")


@query("rebuild-full", f"WITH {POSES_SQL}, {LOCAL_SQL}, {WORLD_SQL}, shifted AS (SELECT session_id, sequence, x + CAST(1.5 AS DOUBLE) AS x, y, z FROM world), placed AS (SELECT *, {fx.cells_sql()} FROM shifted) SELECT 'full' AS mode, {VOX}, count(*) AS n, min(sequence) AS first_seq, max(sequence) AS last_seq FROM placed GROUP BY ALL")
def rebuild_full(spark, d):
    out = _rebuilt(spark, d, 1)
    return out.voxels.select(F.lit(out.mode).alias("mode"), *fusion.VOXEL, "n", "first_seq", "last_seq")
