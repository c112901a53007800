import bz2
import struct

import pytest
from pyspark.errors import PySparkException

from wayfold.sources import bag, text


def put(path, body):
    path.write_text(body)
    return str(path)


def test_imu_text(spark, tmp_path):
    p = put(tmp_path / "imu.csv", "# head\n\n1.5, 0.1 0.2,0.3 1 2 3\n1305031910.765238123 0 0 0 0 0 9.8\n")
    rows = text.read_imu(spark, p).orderBy("stamp_ns").collect()
    assert [r.stamp_ns for r in rows] == [1500000000, 1305031910765238123] and rows[0].gz == 0.3
    for broken in ("1 2 3\n", "1 a 0 0 0 0 0\n", "1e3 0 0 0 0 0 0\n"):
        with pytest.raises(PySparkException):
            text.read_imu(spark, put(tmp_path / "bad.csv", broken)).collect()


def test_scans_keep_what_is_not_finite(spark, tmp_path):
    p = put(tmp_path / "scan.csv", "1.0 -1.0 0.1 0.05 25 3 nan inf 2.5\n")
    (r,) = text.read_scans(spark, p).collect()
    assert r.ranges[0] != r.ranges[0] and r.ranges[1] == float("inf") and r.ranges[2] == 2.5
    with pytest.raises(PySparkException):
        text.read_scans(spark, put(tmp_path / "bad.csv", "1.0 -1.0 0.1 0.05 25 3 1 2\n")).collect()
    text.write_scans(text.read_scans(spark, p), str(tmp_path / "out"))
    again = text.read_scans(spark, str(tmp_path / "out")).collect()
    assert again[0].ranges[1:] == r.ranges[1:] and again[0].stamp_ns == r.stamp_ns


def test_trajectories_go_round(spark, tmp_path):
    p = put(tmp_path / "t.txt", "2.000000001 1 2 3 0 0 0 2\n1 0 0 0 0 0 0 1\n")
    poses = text.read_trajectory(spark, p)
    text.write_trajectory(poses, str(tmp_path / "out"))
    again = text.read_trajectory(spark, str(tmp_path / "out")).orderBy("stamp_ns").collect()
    assert [r.stamp_ns for r in again] == [1000000000, 2000000001] and again[1].qw == 1.0
    lines = [ln for f in sorted((tmp_path / "out").glob("part-*")) for ln in f.read_text().splitlines()]
    assert lines[0].startswith("#") and lines[1].startswith("1.000000000 ")


def test_euroc(spark, tmp_path):
    p = put(tmp_path / "gt.csv", "#h\n1403636579758555392,1,2,3,0.5,0.1,0.2,0.3,0,0,0\n")
    (r,) = text.read_euroc_truth(spark, p).collect()
    assert (r.stamp_ns, r.tx, r.qx, r.qy, r.qz, r.qw) == (1403636579758555392, 1, 0.1, 0.2, 0.3, 0.5)


def test_voxel_dumps(spark, tmp_path):
    body = b"STSD" + struct.pack("<IdQ", 1, 0.05, 2) + struct.pack("<3i2f", 1, -2, 3, 0.5, 2.0) * 2
    (tmp_path / "m.stsd").write_bytes(body)
    rows = text.read_voxels(spark, str(tmp_path / "m.stsd")).collect()
    assert len(rows) == 2 and rows[0].iy == -2 and rows[0].voxel == 0.05
    (tmp_path / "m.stsd").write_bytes(body[:-1])
    with pytest.raises(PySparkException):
        text.read_voxels(spark, str(tmp_path / "m.stsd")).collect()


# ---- bags


def record(data=b"", **fields):
    head = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(data)) + data


def u32(n):
    return struct.pack("<I", n)


def header(stamp, frame):
    return struct.pack("<IIII", 0, stamp // 10**9, stamp % 10**9, len(frame)) + frame


def make_bag(path):
    imu = header(1_000_000_005, b"imu") + struct.pack("<37d", *range(37))
    scan = header(2_000_000_000, b"laser") + struct.pack("<7fI2f", -1, 1, 0.5, 0, 0, 0.1, 9, 2, 1.5, float("inf")) + u32(0)
    message = lambda conn, body, s: record(body, op=b"\x02", conn=u32(conn), time=struct.pack("<II", s, 0))
    bodies = [message(0, imu, 1) + message(1, scan, 2), message(1, scan, 3)]
    out = bag.MAGIC
    head = lambda at: record(b" " * 20, op=b"\x03", index_pos=struct.pack("<Q", at), conn_count=u32(2), chunk_count=u32(2))
    at, places = len(out) + len(head(0)), []
    chunks = b""
    for k, body in enumerate(bodies):
        places.append(at + len(chunks))
        chunks += record(bz2.compress(body) if k else body, op=b"\x05", compression=b"bz2" if k else b"none", size=u32(len(body)))
    tail = b"".join(record(u32(5 + len(t)) + b"type=" + t, op=b"\x07", conn=u32(c), topic=n) for c, n, t in ((0, b"/imu", b"sensor_msgs/Imu"), (1, b"/scan", b"sensor_msgs/LaserScan")))
    tail += b"".join(record(b"".join(u32(c) + u32(1) for c in held), op=b"\x06", chunk_pos=struct.pack("<Q", p), count=u32(len(held))) for p, held in zip(places, ((0, 1), (1,))))
    path.write_bytes(out + head(at + len(chunks)) + chunks + tail)


def test_bags(spark, tmp_path):
    make_bag(tmp_path / "a.bag")
    bag.register(spark)
    rows = spark.read.format("bag").load(str(tmp_path / "a.bag")).orderBy("chunk", "seq").collect()
    assert [(r.topic, r.stamp_ns) for r in rows] == [("/imu", 10**9), ("/scan", 2 * 10**9), ("/scan", 3 * 10**9)]
    assert bag.imu(bytes(rows[0].data)) == (1_000_000_005, "imu", 13.0, 14.0, 15.0, 25.0, 26.0, 27.0)
    assert bag.scan(bytes(rows[1].data))[-1] == [1.5, float("inf")]
    only = spark.read.format("bag").option("topics", "/imu").load(str(tmp_path / "a.bag"))
    assert only.count() == 1 and only.rdd.getNumPartitions() == 1
    connections, chunks = bag.index(str(tmp_path / "a.bag"))
    assert bag.resolved(connections, None, "sensor_msgs/Imu") == "/imu" and len(chunks) == 2
    with pytest.raises(ValueError):
        bag.resolved(connections, "/imu", "sensor_msgs/LaserScan")
