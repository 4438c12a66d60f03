"""Small cases with known answers, on the operators' own interfaces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from weftcloud.functions import formats, geometry as geo
from weftcloud.functions.views import Camera, chunk_level, distance_to_box, sees_box, sees_point
from weftcloud.operators import alignment, corrections, fusion, observation, serving, sessions, storage
from weftcloud.sources import batch_log, packets, synthetic
from weftcloud.streaming import live


def still():
    return geo.pose_of((0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))


def points(spark, rows, pose=None):
    """rows: (sequence, idx, x, y, z)."""
    df = spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in rows], "sequence bigint, idx bigint, x double, y double, z double")
    return df.select(F.lit("s").alias("session_id"), "sequence", F.col("sequence").alias("pose_sequence"), "idx", "x", "y", "z", F.lit(10).alias("r"), F.lit(20).alias("g"), F.lit(31).alias("b"), F.lit(1000).alias("intensity"), (still() if pose is None else pose).alias("pose"))


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_transform_and_chunk(spark):
    p = fusion.placed(points(spark, [(1, 0, 0.25, 0.25, 0.25), (1, 1, 0.75, 0.5, 0.5)], geo.pose_of((1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))), 1.0, 0.04)
    got = p.orderBy("idx").select("x", geo.key_text("cx", "cy", "cz").alias("k")).collect()
    assert [(r.x, r.k) for r in got] == [(1.25, "1_0_0"), (1.75, "1_0_0")]


def test_rotation_about_z(spark):
    h = math.sqrt(0.5)
    p = fusion.placed(points(spark, [(1, 0, 0.5, 0.5, 0.5)], geo.pose_of((2.0, 0.0, 0.0), (0.0, 0.0, h, h))), 1.0, 0.04).first()
    assert (round(p.x, 9), round(p.y, 9), round(p.z, 9)) == (1.5, 0.5, 0.5)


def test_compose_inverse_relative(spark):
    a, b = geo.from_yaw(F.lit(0.7), (F.lit(1.0), F.lit(2.0), F.lit(3.0))), geo.from_yaw(F.lit(-0.2), (F.lit(0.5), F.lit(0.0), F.lit(1.0)))
    r = one(spark, back=geo.compose(a, geo.relative(b, a)), b=b, m=geo.pose_matrix(a), angle=geo.rotation_angle(a))
    assert np.allclose(list(r.back), list(r.b))
    assert np.allclose(np.array(r.m).reshape(4, 4), alignment.matrix(np.array([1.0, 2, 3]), np.array([0, 0, math.sin(0.35), math.cos(0.35)])))
    assert math.isclose(r.angle, 0.7)


def test_fusion_mean_and_order(spark):
    v = fusion.with_ordinal(fusion.fuse(fusion.placed(points(spark, [(1, 0, 0.1, 0.1, 0.1), (1, 1, 0.105, 0.105, 0.105), (2, 0, 0.5, 0.5, 0.5)]), 2.0, 0.04)))
    got = fusion.representatives(v, "ordinal").orderBy("ordinal").collect()
    assert [round(r.x, 4) for r in got] == [0.1025, 0.5]
    assert [r.n for r in got] == [2, 1] and got[0].b == 31


def test_levels_of_detail(spark):
    v = fusion.with_ordinal(fusion.fuse(fusion.placed(points(spark, [(1, 0, 0.25, 0.25, 0.25), (1, 1, 0.75, 0.25, 0.25), (1, 2, 2.25, 2.25, 2.25)]), 4.0, 0.5)))
    assert fusion.level_of_detail(v, 1, 2, 0.5).count() == 3
    assert sorted(r.x for r in fusion.level_of_detail(v, 0, 2, 0.5).collect()) == [0.5, 2.25]


def test_replay_changes_nothing(spark):
    first = fusion.placed(points(spark, [(1, 0, 0.0, 0, 0), (1, 1, 0.03, 0, 0), (2, 0, 0.03, 0, 0)]), 2.0, 0.04)
    whole = fusion.fuse(first)
    again = fusion.not_applied(first, fusion.chunk_stats(whole))
    assert fusion.merged(whole, fusion.fuse(again)).first().n == 3
    assert math.isclose(fusion.representatives(whole).first().x, 0.02, rel_tol=1e-6)


def test_delta_algebra(spark):
    rows = [(1, k, 0.1 + 0.3 * k, 0.1, 0.1) for k in range(3)]
    after = rows + [(2, 0, 0.1, 0.1, 0.1), (3, 0, 1.1, 0.1, 0.1), (3, 1, 1.5, 0.1, 0.1)]
    v = fusion.with_ordinal(fusion.fuse(fusion.placed(points(spark, after), 4.0, 0.04)))
    assert fusion.versions(v).first().version == 5
    assert fusion.delta(fusion.level_of_detail(v, 5, 6, 0.04), 3).count() == 2
    assert fusion.observed(v, 2).count() == 1


def test_observation_counters(spark):
    wall = [(k, 0, 5.01, 0.01, 0.01) for k in range(1, 11)]
    rows = wall + [(1, 1, 0.01, 0.01, 5.01), (3, 1, 5.01, 0.51, 0.01)]
    p = fusion.placed(points(spark, rows), 1.0, 0.04)
    seen = observation.qualifying(p.select("session_id", "sequence", "pose").distinct(), fusion.touched(p), 1.0)
    v = {(r.cx, r.cz, r.vy): r for r in observation.with_opportunities(fusion.fuse(p), seen).collect()}
    assert v[5, 0, 0].opportunities == 10 and v[0, 5, 0].opportunities == 1
    flier = v[5, 0, 12]
    assert flier.n / max(1, flier.opportunities - flier.o0 + 1) == 1 / 8


def test_counters_of_views_come_without_a_row_for_each(spark, monkeypatch):
    """The running counter at births and the changes of counters equal those read off the rows; spans of sequences too."""
    r = random.Random(6)
    rows = [(k, i, *(r.choice([0, 1, 2, 3, 7, 30]) + 0.01 + 0.05 * r.randrange(3) for _ in range(3))) for k in range(1, 60) for i in range(2)]
    far = F.when(F.col("sequence") % 4 == 0, 2.0).otherwise(0.0)
    p = fusion.placed(points(spark, rows).withColumn("pose", geo.pose_of((far, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))), 1.0, 0.04)
    b, t, voxels = p.select("session_id", "sequence", "pose").distinct(), fusion.touched(p), fusion.fuse(p)
    key = lambda df: sorted(tuple(x) for x in df.collect())
    whole = observation.qualifying(b, t, 1.0)
    want = key(observation.with_opportunities(voxels, whole).select(*fusion.VOXEL, "o0", "opportunities"))
    old, new = F.expr("sequence % 3 <> 0"), F.expr("sequence % 2 = 0")
    changed = {}
    for x in whole.collect():
        c = changed.setdefault(tuple(x[c] for c in fusion.CHUNK), [0, 0, 0])
        c[0] += x.sequence % 3 != 0
        c[1] += x.sequence % 3 != 0 and x.sequence % 2 != 0
        c[2] += x.sequence % 3 == 0 and x.sequence % 2 == 0
    for span in (1 << 16, 8):
        monkeypatch.setattr(observation, "SPAN", span)
        assert key(observation.with_counters(voxels, b, t, 1.0).select(*fusion.VOXEL, "o0", "opportunities")) == want
        counts = observation.counted(b, t, 1.0, where={"before": old, "after": new})
        got = corrections.counter_changes(counts.withColumn("opportunities", F.col("before")))
        assert key(got.select(*fusion.CHUNK, "opportunities")) == sorted((*c, max(n - lost + won, 0)) for c, (n, lost, won) in changed.items())


def test_frustum_and_levels(spark):
    c = Camera((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), fov_y=math.pi / 2, viewport=(100.0, 100.0), near=0.1, far=50.0)
    for p, inside in (((5, 0, 0), True), ((5, 4, 0), True), ((5, 6, 0), False), ((-5, 0, 0), False), ((60, 0, 0), False)):
        assert one(spark, v=sees_point(c, tuple(F.lit(float(x)) for x in p))).v is inside
    low, high = tuple(F.lit(x) for x in (1.0, -1.0, -1.0)), tuple(F.lit(x) for x in (2.0, 1.0, 1.0))
    assert one(spark, v=sees_box(c, low, high)).v
    for p, d in (((1.5, 0.0, 0.0), 0.0), ((0.0, 0.0, 0.0), 1.0), ((4.0, 0.0, 0.0), 2.0)):
        assert one(spark, v=distance_to_box(p, low, high)).v == d
    for size, level in ((0.04, 5), (0.08, 4), (0.16, 3), (0.64, 1), (1.28, 0), (10.0, 0), (0.001, 5), (0.0, 5), (-1.0, 5), (float("nan"), 5)):
        assert one(spark, v=geo.level_for(F.lit(size), 0.04, 6)).v == level
    assert one(spark, v=chunk_level(c, tuple(F.lit(-9.0) for _ in "xyz"), tuple(F.lit(-8.0) for _ in "xyz"), 0.04, 6)).v is None
    with pytest.raises(ValueError):
        Camera((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), near=2.0, far=1.0)
    assert Camera((0.0, 0.0, 0.0), (0.0, 0.0, 1.0), up=(0.0, 0.0, 1.0)).planes


def test_q4_and_q8():
    rows = np.zeros(2, formats.V1)
    rows["x"], rows["y"], rows["z"], rows["intensity"] = [1.2345, -131.07], [-0.0011, 200], [7.777, 0], [65535, 0]
    back = formats.unpack(formats.pack(rows, "xyzi_q4_v2"), "xyzi_q4_v2")
    assert abs(back["x"][0] - 1.2345) <= 0.002 and back["r"][0] == 255 and back["intensity"][0] == 65280
    assert math.isclose(back["y"][1], 131.068, rel_tol=1e-6)
    q8 = np.frombuffer(formats.pack(rows[:1], "q8_chunk_v2", (0.0, -2.0, 6.0), 2.0), formats.Q8)
    assert abs((q8["x"][0] + 0.5) * 2 / 256 - 1.2345) <= 2 / 256


def test_pack_and_decode(spark):
    p = points(spark, [(1, k, 0.5 * k, 1.0, 2.0) for k in range(4)]).withColumn("idx", F.col("idx").cast("int"))
    packed = formats.packed(p, ("session_id", "sequence"), "xyzi_q4_v2").withColumns({"point_format": F.lit("xyzi_q4_v2"), "pose_sequence": F.lit(1).cast("bigint")})
    got = formats.decode_batches(packed).orderBy("idx").collect()
    assert [round(r.x, 3) for r in got] == [0.0, 0.5, 1.0, 1.5] and got[0].intensity == (1000 >> 8) << 8
    assert packed.select(formats.payload_finite("payload", "point_format").alias("v")).first().v


def test_many_small_batches_are_packed_and_decoded_together(spark):
    """Python is called for Arrow batches, not for each group, file and payload."""
    rows = spark.range(30_000).select((F.col("id") % 7).alias("idx"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).cast("string").alias("session_id"), F.expr("cast(id div 7 as bigint)").alias("sequence"), *[(F.col("id") % k / 4).alias(c) for k, c in ((11, "x"), (13, "y"), (17, "z"))], *[F.lit(k).alias(c) for k, c in enumerate("rgb")], (F.col("id") % 250 * 256).cast("int").alias("intensity"))
    rows = rows.union(rows.where("sequence = 3").selectExpr("explode(sequence(7, 25000)) as idx", "'long' as session_id", "sequence", "idx / 1000 as x", "y", "z", "r", "g", "b", "intensity").dropDuplicates(["idx"]))
    packed = formats.packed(rows, ("session_id", "sequence"), "xyzi_q4_v2")
    assert "FlatMapGroupsInPandas" not in packed._jdf.queryExecution().toString()
    want = rows.groupBy("session_id", "sequence").agg(F.count(F.lit(1)).alias("n"))
    assert packed.count() == want.count()
    framed = packed.select(F.lit("p").alias("path"), batch_log.frame_of(F.to_json(F.struct("session_id", "sequence", F.lit("xyzi_q4_v2").alias("point_format"))), F.col("payload")).alias("content"))
    found = batch_log.split_frames(framed)
    assert found.count() == want.count()
    back = formats.decode_batches(batch_log.bronze(found), ("session_id", "sequence"))
    place = F.row_number().over(Window.partitionBy("session_id", "sequence").orderBy("idx")) - 1
    exact = rows.select("session_id", "sequence", *[F.col(c).cast("float").alias(c) for c in "xyz"], (F.shiftright("intensity", 8) * 256).alias("intensity"), place.alias("idx"))
    key = lambda t: sorted((r.session_id or "", r.sequence, r.idx, round(r.x, 2), r.intensity) for r in t.collect())
    assert key(back) == key(exact)


def test_chunk_payloads_have_their_own_origin(spark):
    rows = spark.createDataFrame([(c, i, 2.0 * c + 0.25 * i) for c in range(3) for i in range(4)], "cx int, idx int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "r": F.lit(1), "g": F.lit(2), "b": F.lit(3), "intensity": F.lit(512), "ox": F.col("cx") * 2.0, "o": F.lit(0.0)})
    for r in formats.packed(rows, ("cx",), "q8_chunk_v2", origin=("ox", "o", "o")).collect():
        assert np.frombuffer(r.payload, formats.Q8)["x"].tolist() == [0, 32, 64, 96] and r.point_count == 4


def test_torn_log_is_cut(spark):
    good = batch_log.frame({"session_id": "s", "sequence": 1}, b"abc")
    bad = bytearray(batch_log.frame({"session_id": "s", "sequence": 2}, b"def"))
    bad[-1] ^= 1
    files = spark.createDataFrame([("torn", bytearray(good + good[:20])), ("flip", bytearray(good + bytes(bad) + good)), ("fine", bytearray(good * 2))], "path string, content binary")
    got = batch_log.split_frames(files)
    assert {r.path: r.n for r in got.where("header is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()} == {"torn": 1, "flip": 1, "fine": 2}
    assert {r.path: r.truncated_bytes for r in got.where("header is null").collect()} == {"torn": 20, "flip": len(bad) + len(good)}
    assert batch_log.bronze(got).first().point_format == "xyz_rgb_i_v1"


def test_message_kinds(spark):
    good = batch_log.frame({"a": 1}, b"x")
    rows = spark.createDataFrame([(bytearray(good),), (bytearray(good[:-1]),), (bytearray(b'{"type":"pose_update"}'),), (bytearray(b"junk"),)], "m binary")
    assert [r.k for r in rows.select(batch_log.message_kind(F.col("m")).alias("k")).collect()] == ["batch", "invalid", "pose_update", "invalid"]


def test_packets(spark):
    rows = spark.createDataFrame([(1, bytearray(packets.packet(0, 5, 500))), (2, bytearray(packets.packet(9000, 7, 1000, 64))), (3, bytearray(b"short"))], "packet_id bigint, packet binary")
    for sensor, n in (("vlp16", 12 * 2 * 16), ("vlp32", 12 * 32)):
        got = packets.decode_packets(rows, sensor)
        assert got.count() == 2 * n
        assert got.where("packet_id = 2").first().intensity == 16448
    near = packets.to_cartesian(packets.decode_packets(rows), spark.createDataFrame(packets.vertical_fixture(16))).where("packet_id = 1")
    assert np.allclose([math.hypot(r.x, r.y, r.z) for r in near.collect()], 1.0)
    assert rows.select(packets.packet_time(F.col("packet")).alias("t")).collect()[0].t == 5


def test_azimuth_variants():
    az = np.array([35900, 100, 300], np.uint16)
    assert packets.interpolated(az, 2).tolist() == [[359.0, 0.0], [1.0, 2.0], [3.0, 4.0]]
    assert packets.interpolated(az, 2, reuse_last=False)[2].tolist() == [3.0, 3.0]


def test_calibration(spark, tmp_path):
    (tmp_path / "c.json").write_text(packets.calibration_json(16))
    assert packets.load_calibration(spark, str(tmp_path / "c.json"), 16).count() == 16
    with pytest.raises(ValueError):
        packets.load_calibration(spark, str(tmp_path / "c.json"), 32)


def test_spins(spark):
    rows = spark.createDataFrame([(k, float(a)) for k, a in enumerate([300, 340, 5, 80, 160, 240, 320, 5])], "k int, azimuth double").withColumn("s", F.lit(1))
    assert [r.k for r in packets.spins(rows, ["s"], ["k"], least=1).orderBy("k").collect()] == [2, 3, 4, 5, 6]


def test_sequences(spark):
    rows = spark.createDataFrame([("s", k, n) for k, n in enumerate([2, 2, 1, 10])], "session_id string, arrival int, sequence bigint")
    assert [r.sequence for r in sessions.monotone(rows).orderBy("arrival").collect()] == [2, 10]
    strict = sessions.strict_sequence(rows).orderBy("arrival").collect()
    assert [(r.expected, r.in_order) for r in strict] == [(1, False), (1, False), (1, True), (2, False)]
    poses = spark.createDataFrame([("s", n) for n in (1, 2, 3)], "session_id string, pose_sequence bigint")
    assert [r.pose_sequence for r in sessions.newest_poses(poses, 2).orderBy("pose_sequence").collect()] == [2, 3]


def test_lifecycle(spark):
    rows = [("create_session", "p", None), ("pose_update", "p", 1), ("pose_update", "q", 2), ("close_session", "p", 2), ("pose_update", "p", 3), ("create_session", "p", None), ("resume_session", "p", 9)]
    df = spark.createDataFrame([(k, t, "s", p, n) for k, (t, p, n) in enumerate(rows)] + [(9, "pose_update", "x", "p", 1)], "arrival int, type string, session_id string, publisher_id string, sequence bigint")
    got = [r.verdict for r in sessions.lifecycle(df).orderBy("arrival").collect()]
    assert got == ["created", "accepted", "rejected: other publisher", "closed", "rejected: closed", "reopened", "rejected: ahead of the server", "skipped: no session"]


def test_corrections_and_partial_rebuild(spark):
    rows = [(k, 0, 0.5, 0.5, 0.5) for k in (1, 2, 3, 4)]
    shift = F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0), F.lit(2.0))
    pose = geo.pose_of((F.get(shift, (F.col("sequence") - 1).cast("int")), 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))
    raw = points(spark, rows).withColumn("pose", pose)
    before = fusion.placed(raw, 1.0, 0.04)
    vox, line = fusion.fuse(before), fusion.touched(before)
    new = spark.createDataFrame([("s", 3)], "session_id string, pose_sequence bigint").withColumn("corrected", geo.pose_of((6.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)))
    none = spark.createDataFrame([], "session_id string").withColumn("tail", still())
    b = corrections.effective(raw.select("session_id", "sequence", "pose_sequence", "pose"), new, none).withColumn("fused", F.col("pose"))
    out = corrections.rebuild(raw.drop("pose"), b, vox, line, 1.0, 0.04)
    assert out.mode == "partial" and out.chunks.count() == 2 and out.batches.count() == 1
    full = fusion.fuse(fusion.placed(raw.drop("pose").join(b.select("sequence", F.col("effective").alias("pose")), "sequence"), 1.0, 0.04))
    key = lambda t: sorted(map(tuple, t.select(*fusion.VOXEL, "n", "sx").collect()))
    assert key(out.voxels) == key(full)
    assert corrections.rebuild(raw.drop("pose"), b.withColumn("effective", F.col("fused")), vox, line, 1.0, 0.04).mode == "unchanged"
    assert [corrections.mode(*x) for x in ((0, 0), (4, 0), (4, 2), (4, 3))] == ["full", "unchanged", "partial", "full"]
    tail = spark.range(1).select(F.lit("s").alias("session_id"), geo.pose_of((0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)).alias("tail"))
    moved = corrections.changed(corrections.effective(raw.select("session_id", "sequence", "pose_sequence", "pose"), new, tail).withColumn("fused", F.col("pose")), 0.02)
    assert sorted(r.sequence for r in moved.collect()) == [3, 4]


def test_correction_document(spark):
    text = '{"session_id":"s","poses":[{"pose_sequence":1,"pose":{"translation_m":[1,2,3],"rotation_xyzw":[0,0,0,1]}}],"tail":{"translation_m":[0,1,0],"rotation_xyzw":[0,0,0,1]}}'
    poses, tails = corrections.install(spark, text, "s")
    assert poses.first().corrected.tx == 1.0 and tails.first().tail.ty == 1.0
    assert '"pose_sequence":1' in corrections.to_json(poses, tails, tool="t").first().document
    with pytest.raises(ValueError):
        corrections.install(spark, text.replace("[0,0,0,1]}}]", "[0,0,0,3]}}]"), "s")


def test_overlay_thinning(spark):
    world = points(spark, [(1, k, x, 0, 0) for k, x in enumerate([1, 2, 3, 4, -1, -2, -3, -4])])
    c = Camera((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), fov_y=1.5, viewport=(100.0, 100.0), near=0.1, far=50.0)
    assert serving.overlay(world, [c]).count() == 4
    assert sorted(r.x for r in serving.overlay(world, [c], 2).collect()) == [1.0, 3.0]


def test_keyframe_then_delta(spark):
    held = spark.createDataFrame([], serving.HELD)
    visible = spark.createDataFrame([("v", "s", 0, 0, 0, 5)], "viewer_id string, session_id string, cx bigint, cy bigint, cz bigint, level int")
    seen = []
    for version, total, added in ((2, 2, 2), (3, 3, 1), (4, 4, 1)):
        totals = visible.withColumns({"version": F.lit(version).cast("bigint"), "total": F.lit(total).cast("bigint"), "added": F.lit(added).cast("bigint")})
        out = serving.refresh(visible, held, totals)
        seen.append(out.first().action)
        held = serving.next_held(out)
    assert seen == ["chunk_keyframe", "chunk_delta", "chunk_keyframe"]


def test_loop_alignment():
    """A drifting square is closed by one exact loop edge."""
    true = [alignment.exp_se3(np.array([0, 0, 2 * np.pi * k / 20, 0, 0, 0])) @ np.block([[np.eye(3), np.array([[5.0], [0], [0]])], [np.zeros((1, 3)), 1]]) for k in range(21)]
    steps = [np.linalg.inv(a) @ b @ alignment.exp_se3(np.array([0, 0, 0.01, 0.02, 0, 0])) for a, b in zip(true, true[1:], strict=False)]
    walk = [true[0]]
    for s in steps:
        walk.append(walk[-1] @ s)
    edges = [(k + 1, k, s, np.eye(6), False) for k, s in enumerate(steps)] + [(20, 0, np.linalg.inv(true[0]) @ true[20], 10 * np.eye(6), True)]
    out = alignment.optimise(walk, edges)
    drift, rest = (np.linalg.norm(p[20][:3, 3] - true[20][:3, 3]) for p in (walk, out))
    assert rest < 0.3 * drift


def test_registration():
    rng = np.random.default_rng(0)
    room = np.concatenate([np.stack([rng.uniform(0, 4, 900), rng.uniform(0, 3, 900), np.zeros(900)], 1), np.stack([rng.uniform(0, 4, 900), np.zeros(900), rng.uniform(0, 2, 900)], 1), np.stack([np.zeros(900), rng.uniform(0, 3, 900), rng.uniform(0, 2, 900)], 1)])
    shift = alignment.exp_se3(np.array([0, 0, 0.05, 0.1, -0.08, 0.05]))
    moved = (room - shift[:3, 3]) @ shift[:3, :3]
    m, fitness, rmse, info = alignment.register(moved, room, np.eye(4))
    assert np.allclose(m, shift, atol=1e-3) and fitness > 0.9 and info.shape == (6, 6)


def test_keyframes_and_candidates(spark):
    rows = spark.createDataFrame([("s", k, k, 100 if k != 2 else 0, 0.2 * k) for k in range(1, 12)], "session_id string, sequence bigint, pose_sequence bigint, point_count int, x double")
    b = rows.withColumn("pose", geo.pose_of((F.col("x"), 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)))
    kfs = alignment.keyframes(b)
    assert [r.sequence for r in kfs.orderBy("kf").collect()] == [1, 4, 7, 10]
    got = alignment.loop_candidates(kfs, alignment.Config(radius_m=2.0, min_gap=2)).collect()
    assert {(r.source, r.target) for r in got} == {(2, 0), (3, 1), (3, 0)}
    assert alignment.odometry_edges(kfs).count() == 3
    fixed, tails = alignment.propagated(b, kfs, kfs.select("session_id", "kf", (F.col("tx") + 1).alias("tx"), *alignment.POSES[1:]))
    assert fixed.count() == 11 and tails.first().tail.tx == 1.0


def test_keyframes_of_long_sessions_are_streamed(spark):
    """The choice by its definition, with steps of just the limit, through a plan that gathers no session."""
    r = random.Random(4)
    turns = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.6, 0.8), (0.0, 0.28, 0.0, 0.96), (0.5, 0.5, 0.5, 0.5), (0.0, 0.0, 0.05, 0.99)]
    rows = [(s, k, r.choice([0, 1, 2, 2]), *(r.randrange(9 if s == "a" else 3) / 4 + r.choice([0, 0, 1e-13]) for _ in range(3)), *r.choice(turns)) for s in "ab" for k in range(12_000 if s == "b" else 3000)]
    rows += [("c", 0, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("c", 1, 1, float("nan"), 0.0, 0.0, *turns[0]), ("c", 2, 1, 0.0, 0.0, 0.0, *turns[0])]
    want, last = [], {}
    for at, (s, k, n, *v) in enumerate(rows):
        if n:
            m = alignment.matrix(np.array(v[:3]), np.array(v[3:]))
            step = np.linalg.inv(last[s][1]) @ m if s in last else None
            if step is None or not (np.linalg.norm(step[:3, 3]) < 0.5 and alignment.angle_deg(step) < 10.0):
                last[s] = last[s][0] + 1 if s in last else 0, m
                want.append((s, last[s][0], k, k))
    df = spark.createDataFrame(rows, "session_id string, sequence bigint, point_count bigint, " + ", ".join(f"{p} double" for p in alignment.POSES))
    kfs = alignment.keyframes(df.repartition(5).select("session_id", "sequence", "point_count", F.struct(*alignment.POSES).alias("pose")))
    assert "FlatMapGroups" not in kfs._jdf.queryExecution().toString()
    assert sorted((r.session_id, r.kf, r.batch_index, r.sequence) for r in kfs.collect()) == want


def test_loop_candidates_in_dense_places(spark, monkeypatch):
    """The nearest by their definition where many keyframes stand within the radius, on the same spots too; no row for a pair."""
    r = np.random.default_rng(5)
    xyz = np.concatenate([r.normal(0, 0.3, (900, 3)), np.round(r.normal(0, 0.3, (600, 3)), 1), r.normal(0, 40, (100, 3)), np.tile([[1.0, 1.0, -1.0]], (200, 1))])
    xyz = xyz[r.permutation(len(xyz))]
    df = spark.createDataFrame([("s", k, *map(float, v)) for k, v in enumerate(xyz)] + [("s", 9999, float("nan"), 0.0, 0.0)], "session_id string, kf int, tx double, ty double, tz double")
    want = set()
    for k in range(20, len(xyz)):
        d = xyz[k] - xyz[: k - 19]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        want |= {(k, int(t), i + 1) for i, t in enumerate(np.lexsort((np.arange(len(d2)), d2))[:2]) if d2[t] <= 0.25}
    for pairs in (1 << 21, 1000):
        monkeypatch.setattr(alignment, "PAIRS", pairs)
        found = alignment.loop_candidates(df, alignment.Config(radius_m=0.5))
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = found.collect()
        assert {(x.source, x.target, x.rank) for x in got} == want and len(got) == len(want)


def test_storage_round_trip(spark, tmp_path):
    p = fusion.placed(points(spark, [(1, k, 3.0 * k, 0, 0) for k in range(5)]), 2.0, 0.5)
    path = str(tmp_path / "gold")
    storage.write_gold(fusion.fuse(p), path, 4)
    chunk = fusion.fuse(p).where("cx = 0").withColumn("n", F.lit(7).cast("bigint"))
    storage.replace_chunks(spark, path, chunk, chunk, 4)
    assert sorted((r.cx, r.n) for r in spark.read.parquet(path).collect()) == [(0, 7), (1, 1), (3, 1), (4, 1), (6, 1)]


def test_stream_equals_batch(spark, tmp_path):
    for k in range(1, 4):
        points(spark, [(k, i, 0.3 * i, 0.1 * k, 0.0) for i in range(6)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 2.0, 0.5).awaitTermination(120)
    want = fusion.fuse(fusion.placed(spark.read.parquet(str(tmp_path / "in")), 2.0, 0.5))
    key = lambda t: sorted((*map(int, r[:6]), r.n, round(r.sx, 9)) for r in t.select("cx", "cy", "cz", "vx", "vy", "vz", "n", "sx").collect())
    assert key(live.fused_so_far(spark, str(tmp_path / "out"))) == key(want)
    assert live.dirty_chunks(spark, str(tmp_path / "out"), 0).count() >= 1


def test_synthetic(spark):
    poses = synthetic.loop_poses(spark, steps=5).select("sequence", F.col("true_pose").alias("pose"))
    assert synthetic.room_scans(poses, 4, 10).count() == 200
    assert synthetic.shell(spark, 100, 0.0).count() == 100 and len(synthetic.bench_spin(1600)) == 1600


def test_follower_equals_one_shot(spark, tmp_path):
    from weftcloud.streaming.watch import Follower

    poses = synthetic.loop_poses(spark, steps=25).withColumn("session_id", F.lit("s"))
    scans = synthetic.room_scans(poses.select("sequence", F.col("true_pose").alias("pose")), 8, 60).withColumn("session_id", F.lit("s"))
    batches = poses.select("session_id", "sequence", "pose_sequence", F.lit(480).alias("point_count"), "pose")
    cfg = alignment.Config(min_gap=6, voxel_m=0.3)
    f = Follower(spark, str(tmp_path), cfg)
    loops = sum(f.extend(batches.where(w), scans.where(w), k) for k, w in enumerate(("sequence <= 20", "sequence > 20")))
    whole = alignment.keyframes(batches, cfg)
    key = lambda t: sorted((r.kf, r.sequence) for r in t.collect())
    assert key(f.result().keyframes) == key(whole)
    assert loops == f.result().loops.count() and f.result().poses.count() == 25


@pytest.mark.parametrize("span", [2, 1 << 16])
def test_counted_opportunities(spark, monkeypatch, span):
    """Numbers without rows equal the rows' numbers, for moving and standing sensors and a session with a view of its own."""
    monkeypatch.setattr(observation, "SPAN", span)
    still = [("s", k, (0.0 if k % 3 else 40.0), 0.0) for k in range(1, 13)] + [("t", k, 2.0 * k, 0.0) for k in range(1, 9)]
    b = spark.createDataFrame([(s, k, (x, y, 0.0, 0.0, 0.0, 0.0, 1.0)) for s, k, x, y in still], f"session_id string, sequence bigint, pose {geo.POSE}")
    touched = spark.createDataFrame([(s, k % 4 * 3, k % 2, 0, k) for s, k, _, _ in still] + [("s", 90, 0, 0, 5)], "session_id string, cx bigint, cy bigint, cz bigint, sequence bigint")
    own = spark.createDataFrame([("t", '{"sensor_fov":{"max_range_m":6}}')], "session_id string, metadata string")
    view = observation.FieldOfView(-15.0, 15.0, 20.0, 2.0)
    for sessions_ in (None, own):
        want = observation.opportunities(observation.qualifying(b, touched, 1.0, view, sessions_))
        got = observation.counted(b, touched, 1.0, view, sessions_)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 4


def test_elevation_bounds_beyond_the_zenith(spark):
    """Past 90 degrees a bound holds for all: a chunk straight above is in view."""
    row = spark.createDataFrame([((0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0),)], f"pose {geo.POSE}")
    above = (F.lit(0), F.lit(0), F.lit(5))
    sees = lambda lo, hi: row.select(observation.sees_chunk(F.col("pose"), above, 1.0, observation.FieldOfView(lo, hi, 30.0, 2.0))).first()[0]
    assert sees(-20.0, 95.0) and not sees(-20.0, 40.0)


def test_throttle_compares_with_the_last_accepted(spark):
    rows = spark.createDataFrame([("v", t) for t in (0, 60, 120, 180, 240, 500, 550)], "viewer_id string, at_ms bigint")
    assert sorted(r.at_ms for r in serving.throttled(rows).collect()) == [0, 120, 240, 500]


def test_percentiles(spark):
    r = random.Random(5)
    for values in ([], [None], [3.0], [1.0] * 50 + [2.0], [r.random() for _ in range(3000)] + [0.5] * 900 + [None] * 7, [float(r.randrange(40)) for _ in range(500)]):
        rows = spark.createDataFrame([(v,) for v in values], "value double")
        kept = sorted(v for v in values if v is not None)
        want = tuple(kept[int(len(kept) * s)] if kept else None for s in (0.5, 0.9, 0.0)) + (kept[-1] if kept else None,)
        assert tuple(serving.percentiles(rows, "value", (0.5, 0.9, 0.0)).first()) == want
