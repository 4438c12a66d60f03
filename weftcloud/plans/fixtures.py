"""The driver's tables as the engine's domain: lineitem rows are points, orders are poses, events are messages and returns.

Each adapter has a twin in SQL (CTES) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import pose_of

FUSE, CHUNK, LEVELS = 2.0, 16.0, 4
#: fixed values: rational unit quaternions by o_orderkey % 4
QUATERNIONS = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.6, 0.8), (0.0, 0.28, 0.0, 0.96), (0.5, 0.5, 0.5, 0.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit(col: str, power: int):
    return F.expr(f"cast(({col} div {10**power}) % 10 as double)")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pose_sequence, pose."""
    k = F.col("o_orderkey") % 4
    q = [F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).otherwise(v[3]) for v in zip(*QUATERNIONS, strict=True)]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pose_sequence"), pose_of([_digit("o_custkey", p) / 4.0 for p in range(3)], q).alias("pose"), "o_orderpriority", "o_custkey")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor-frame points; idx orders the points of a batch."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("session_id"), c("l_orderkey").alias("sequence"), c("l_orderkey").alias("pose_sequence"), F.expr("l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey").alias("idx"),
        c("l_quantity").alias("x"), (c("l_extendedprice") / 2000.0).alias("y"), ((c("l_discount") + c("l_tax")) * 100.0).alias("z"),
        (c("l_partkey") % 256).cast("int").alias("r"), (c("l_suppkey") % 256).cast("int").alias("g"), (c("l_linenumber") * 36).cast("int").alias("b"), (c("l_partkey") * 37 % 65536).cast("int").alias("intensity"),
    )


def posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).join(poses(spark, sf_dir).select("pose_sequence", "pose"), "pose_sequence")


def corrections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Urgent orders have a corrected pose, 3 m along x; the tail is 1 m along y, for session A."""
    p = F.col("pose")
    new = pose_of((p["tx"] + 3.0, p["ty"], p["tz"]), (p["qx"], p["qy"], p["qz"], p["qw"]))
    sessions = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    got = poses(spark, sf_dir).where((F.col("o_orderpriority") == "1-URGENT") & (F.col("pose_sequence") % 5 == 0)).select(sessions.alias("session_id"), "pose_sequence", new.alias("corrected"))
    tails = spark.range(1).select(F.lit("A").alias("session_id"), pose_of((0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)).alias("tail"))
    return got, tails


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = points(spark, sf_dir).groupBy("session_id", "sequence", "pose_sequence").agg(F.count(F.lit(1)).alias("point_count"))
    return n.join(poses(spark, sf_dir).select("pose_sequence", "pose"), "pose_sequence")


def _case(k: int) -> str:
    return "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN CAST({q[k]} AS DOUBLE)" for i, q in enumerate(QUATERNIONS)) + " END"


def rotate_sql(q: str, v: tuple[str, str, str], back: bool = False) -> tuple[str, str, str]:
    """The rotation of geometry.rotate as SQL; q is a prefix of columns qx..qw."""
    s = "-" if back else ""
    qx, qy, qz, qw = f"({s}{q}qx)", f"({s}{q}qy)", f"({s}{q}qz)", f"{q}qw"
    x, y, z = v
    tx, ty, tz = f"(({qy} * {z} - {qz} * {y}) * CAST(2.0 AS DOUBLE))", f"(({qz} * {x} - {qx} * {z}) * CAST(2.0 AS DOUBLE))", f"(({qx} * {y} - {qy} * {x}) * CAST(2.0 AS DOUBLE))"
    return f"({x} + {qw} * {tx} + ({qy} * {tz} - {qz} * {ty}))", f"({y} + {qw} * {ty} + ({qz} * {tx} - {qx} * {tz}))", f"({z} + {qw} * {tz} + ({qx} * {ty} - {qy} * {tx}))"


_W = rotate_sql("", ("lx", "ly", "lz"))
POSES_SQL = f"poses AS (SELECT o_orderkey AS pose_sequence, o_orderpriority, {', '.join(f'CAST((o_custkey // {10**p}) % 10 AS DOUBLE) / 4 AS t{a}' for p, a in enumerate('xyz'))}, {', '.join(f'{_case(k)} AS q{a}' for k, a in enumerate('xyzw'))} FROM orders)"
LOCAL_SQL = """local AS (SELECT l_returnflag AS session_id, l_orderkey AS sequence, l_orderkey AS pose_sequence, l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS idx,
 l_quantity AS lx, l_extendedprice / CAST(2000.0 AS DOUBLE) AS ly, (l_discount + l_tax) * CAST(100.0 AS DOUBLE) AS lz, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_linenumber * 36 AS INTEGER) AS b, CAST(l_partkey * 37 % 65536 AS INTEGER) AS intensity FROM lineitem)"""


def cells_sql(chunk: float = CHUNK, fuse: float = FUSE) -> str:
    return ", ".join(f"CAST(floor({a} / CAST({s} AS DOUBLE)) AS BIGINT) AS {k}{a}" for k, s in (("c", chunk), ("v", fuse)) for a in "xyz")


MICRO = "CAST(floor({} * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def micro_sql(v: str) -> str:
    return MICRO.format(v)


WORLD_SQL = f"world AS (SELECT session_id, sequence, pose_sequence, idx, {_W[0]} + tx AS x, {_W[1]} + ty AS y, {_W[2]} + tz AS z, r, g, b, intensity FROM local JOIN poses USING (pose_sequence))"
PLACED_SQL = f"placed AS (SELECT *, {cells_sql()} FROM world)"
VOXEL_SQL = f"""fused AS (SELECT session_id, cx, cy, cz, vx, vy, vz, CAST(sum({micro_sql('x')}) AS BIGINT) AS sx, CAST(sum({micro_sql('y')}) AS BIGINT) AS sy, CAST(sum({micro_sql('z')}) AS BIGINT) AS sz,
 CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb, CAST(sum(intensity) AS BIGINT) AS si, count(*) AS n, min(sequence) AS first_seq, arg_min(idx, CAST(sequence AS HUGEINT) * 100000000000000000 + idx) AS first_idx, max(sequence) AS last_seq
 FROM placed GROUP BY ALL),
voxels AS (SELECT session_id, cx, cy, cz, vx, vy, vz, sx / CAST(1e6 AS DOUBLE) AS sx, sy / CAST(1e6 AS DOUBLE) AS sy, sz / CAST(1e6 AS DOUBLE) AS sz, sr, sg, sb, si, n, first_seq, first_idx, last_seq,
 row_number() OVER (PARTITION BY session_id, cx, cy, cz ORDER BY first_seq, first_idx, vx, vy, vz) - 1 AS ordinal FROM fused)"""
CTES = f"WITH {POSES_SQL},\n{LOCAL_SQL},\n{WORLD_SQL},\n{PLACED_SQL},\n{VOXEL_SQL}\n"
