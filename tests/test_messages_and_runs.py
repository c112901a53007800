"""Typed messages of a bag, depth clouds, run configurations and the files around a run."""

import json
import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from test_sources import header, record, u32

from wayfold.plans import run
from wayfold.sources import bag, files, messages, text


def string(s):
    return u32(len(s)) + s


def image(stamp, kind, pixels, width, height, step):
    return header(stamp, b"cam") + struct.pack("<II", height, width) + string(kind) + b"\0" + struct.pack("<II", step, len(pixels)) + pixels


def info(fx):
    return header(0, b"cam") + struct.pack("<II", 4, 6) + string(b"plumb_bob") + u32(5) + struct.pack("<5d", *range(5)) + struct.pack("<9d", fx, 0, 3, 0, fx, 2, 0, 0, 1) + b"\0" * 20


def transform(parent, child, x, yaw=0.0):
    return header(5, parent) + string(child) + struct.pack("<3d", x, 0, 0) + struct.pack("<4d", 0, 0, 2 * math.sin(yaw / 2), 2 * math.cos(yaw / 2))


def put(path, chunks, packing=b"none"):
    """chunks: lists of (topic, type, body), written as a bag."""
    kinds = sorted({(t, k) for c in chunks for t, k, _ in c})
    head = lambda at: record(b" " * 20, op=b"\x03", index_pos=struct.pack("<Q", at), conn_count=u32(len(kinds)), chunk_count=u32(len(chunks)))
    names = {t: n for n, (t, _) in enumerate(kinds)}
    at, body, places = len(bag.MAGIC) + len(head(0)), b"", []
    for c in chunks:
        raw = b"".join(record(b, op=b"\x02", conn=u32(names[t]), time=struct.pack("<II", 1, 0)) for t, _, b in c)
        places.append(at + len(body))
        body += record(pa.compress(raw, "lz4", asbytes=True) if packing == b"lz4" else raw, op=b"\x05", compression=packing, size=u32(len(raw)))
    tail = b"".join(record(u32(5 + len(k)) + b"type=" + k, op=b"\x07", conn=u32(n), topic=t) for n, (t, k) in enumerate(kinds))
    tail += b"".join(record(b"".join(u32(names[t]) + u32(1) for t in {t for t, _, _ in c}), op=b"\x06", chunk_pos=struct.pack("<Q", p), count=u32(len(c))) for p, c in zip(places, chunks))
    path.write_bytes(bag.MAGIC + head(at + len(body)) + body + tail)
    return str(path)


DEPTH, IMAGE, CAMERA = (b"/d/image", b"sensor_msgs/Image"), (b"/c/image", b"sensor_msgs/Image"), (b"/d/camera_info", b"sensor_msgs/CameraInfo")
TF, IMU = (b"/tf_static", b"tf2_msgs/TFMessage"), (b"/imu", b"sensor_msgs/Imu")


def depth(stamp, z):
    return image(stamp, b"16UC1", np.full((4, 6), z, "<u2").tobytes(), 6, 4, 12)


@pytest.mark.parametrize("packing", [b"none", b"lz4"])
def test_transforms_and_topics(spark, tmp_path, packing):
    tf = u32(2) + transform(b"base", b"laser", 1.0) + transform(b"base", b"cam", 2.0, 0.4)
    p = put(tmp_path / "a.bag", [[(*TF, tf)], [(*TF, u32(1) + transform(b"base", b"laser", 9.0))]], packing)
    found = {(r.parent, r.child): r.pose for r in messages.read_static_transforms(spark, p).collect()}
    assert found[("base", "laser")].tx == 1.0 and found[("base", "cam")].qz == pytest.approx(math.sin(0.2))
    assert messages.topics_of(p) == {"/tf_static": "tf2_msgs/TFMessage"}
    with pytest.raises(ValueError):
        messages.transforms(u32(1000) + b"\0" * 60)


def test_depth_clouds(spark, tmp_path):
    red = image(10**9 + 1, b"bgr8", bytes([3, 2, 1] * 24), 6, 4, 18)
    old = image(1, b"rgb8", bytes([9, 9, 9] * 24), 6, 4, 18)
    chunks = [[(*DEPTH, depth(10**9, 1000)), (*IMAGE, old), (*DEPTH, depth(10**9, 500))], [(*CAMERA, info(2.0)), (*IMAGE, red), (*DEPTH, depth(10**9, 1000)), (*DEPTH, depth(10**9, 0)), (*CAMERA, info(99.0)), (*DEPTH, depth(10**9, 2000))]]
    p = put(tmp_path / "d.bag", chunks)
    cfg = messages.Depth(spacing=1.0, every=2)
    found = messages.read_depth_clouds(spark, p, "/d/image", "/d/camera_info", "/c/image", cfg).orderBy("place").collect()
    assert len(found) == 3  # frames 0, 2 and 4
    assert found[0].colours is None  # nothing delivered yet
    want = [[(u - 3) / 2.0, (v - 2) / 2.0, 1.0] for v in (0, 2) for u in (0, 2, 4)]
    assert np.allclose(found[0].points, want) and np.allclose(found[1].points, want)
    assert found[1].colours == [[1, 2, 3]] * 6 and np.allclose([q[2] for q in found[2].points], 2.0)
    plain = messages.read_depth_clouds(spark, p, "/d/image", "/d/camera_info", None, cfg)
    assert all(r.colours is None for r in plain.collect())
    with pytest.raises(ValueError, match="no camera info"):
        messages.read_depth_clouds(spark, put(tmp_path / "n.bag", [[(*DEPTH, depth(1, 1))]]), "/d/image", "/d/camera_info")


def test_clouds_by_hand():
    rng = np.random.default_rng(3)
    z = rng.uniform(0.1, 7.0, (40, 60))
    z[0, :5] = np.nan
    mask = rng.random((10, 15)) < 0.3
    cfg = messages.Depth(spacing=0.05, stride=2, points=50)
    k = (150.0, 150.0, 30.0, 20.0)
    points, paint = messages.cloud(z, k, cfg, rng.integers(0, 255, (20, 30, 3)), mask)
    want = []
    for v in range(0, 40, 2):
        for u in range(0, 60, 2):
            if not (0.3 <= z[v, u] <= 6.0):
                continue
            step = 2
            while step * 2 <= max(0.05 * 150 / z[v, u], 2):
                step *= 2
            if u % step == 0 and v % step == 0 and not mask[min(v * 10 // 40, 9), min(u * 15 // 60, 14)]:
                want.append(((u - 30) / 150 * z[v, u], (v - 20) / 150 * z[v, u], z[v, u]))
    every = math.ceil(len(want) / 50)
    assert np.allclose(points, want[::every]) and len(paint) == len(points)
    for broken in (("mono8", 6), ("16UC1", 2)):
        with pytest.raises(ValueError):
            messages.depths(6, 4, broken[0], broken[1], b"\0" * 48)


def test_run_configurations(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("rig: {source: bag, base_frame: base}\nsensors:\n  imus:\n    - topic: /imu\n  depth:\n    - topic: /d/image\n      every_nth: 1\n")
    config = run.load(str(tmp_path / "r.yaml"))
    assert config.sensors.depth[0].camera_info == "/d/camera_info" and config.masking is None
    imu = header(10**9, b"/cam") + struct.pack("<37d", *range(37))
    p = put(tmp_path / "r.bag", [[(*TF, u32(1) + transform(b"base", b"cam", 2.0)), (*CAMERA, info(2.0)), (*IMU, imu), (*DEPTH, depth(10**9, 1000))]])
    rows = run.assembled(spark, config, p).orderBy("stamp_ns", "kind_rank", "place").collect()
    assert [(r.kind, r.frame, r.pose.tx) for r in rows] == [("imu", "cam", 2.0), ("cloud", "cam", 2.0)] and rows[0].body.imu.gx == 13.0 and rows[1].body.imu is None
    lost = put(tmp_path / "l.bag", [[(*TF, u32(1) + transform(b"base", b"other", 2.0)), (*CAMERA, info(2.0)), (*IMU, imu), (*DEPTH, depth(10**9, 1000))]])
    with pytest.raises(PySparkException, match="no frame in the rig"):
        run.assembled(spark, config, lost).collect()
    for bad in ({"sensor": {}}, {"sensors": {"imus": [{"topic": "a", "gyro_topic": "b"}]}}, {"sensors": {"imus": [{"gyro_topic": "b"}]}}, {"sensors": {"scans": [{}]}}, {"rig": {"source": "urdf"}}, {"rig": {"source": "x"}}):
        with pytest.raises(ValueError):
            run.parsed(run.Run, bad)


def test_files_around_a_run(spark, tmp_path):
    (tmp_path / "r.urdf").write_text('<robot><joint name="a" type="fixed"><parent link="base"/><child link="arm"/><origin xyz="1 2 3" rpy="0 0 0.5"/></joint><joint name="b" type="continuous"><parent link="arm"/><child link="wheel"/></joint><transmission><joint name="a"/></transmission></robot>')
    joints = {r.child: r for r in files.read_rig(spark, str(tmp_path / "r.urdf")).collect()}
    assert joints["arm"].fixed and joints["arm"].pose.tz == 3.0 and joints["arm"].pose.qz == pytest.approx(math.sin(0.25)) and not joints["wheel"].fixed
    voxels = spark.createDataFrame([(2, 0, -1, 0.5, 3.0), (1, 0, 0, -0.25, 1.0), (5, 5, 5, 0.0, 0.0)], "ix int, iy int, iz int, tsdf float, weight float")
    files.write_voxels(voxels, str(tmp_path / "m.stsd"), 0.05)
    back = text.read_voxels(spark, str(tmp_path / "m.stsd")).collect()
    assert [(r.ix, r.iz, r.tsdf, r.weight, r.voxel) for r in back] == [(1, 0, -0.25, 1.0, 0.05), (2, -1, 0.5, 3.0, 0.05)]
    table = spark.createDataFrame([("b", 0.123456, None), ("a", float("nan"), 3)], "run string, error double, n int")
    files.write_metrics(table, str(tmp_path / "j"))
    assert {r.value for r in spark.read.text(str(tmp_path / "j")).collect()} >= {'{"run":"b","error":0.123456,"n":null}'}
    assert files.markdown(table, ["run", "error", "n"], ["run"]) == "| run | error | n |\n| --- | --- | --- |\n| a | - | 3 |\n| b | 0.1235 | - |\n"
    (tmp_path / "s.json").write_text(json.dumps({"source": "x", "methods": [{"method": "m1", "ate": {"cafe": 0.25, "home": None}, "share": {"cafe": 95.0}}, {"method": "m2", "ate": {"cafe": 0.5, "home": 1.0}, "share": {"cafe": 10.0}}]}))
    found = {(r.method, r.name, r.scene): r.value for r in files.read_published(spark, str(tmp_path / "s.json"), "methods").collect()}
    assert found == {("m1", "ate", "cafe"): 0.25, ("m1", "share", "cafe"): 95.0, ("m2", "ate", "cafe"): 0.5, ("m2", "ate", "home"): 1.0, ("m2", "share", "cafe"): 10.0}
