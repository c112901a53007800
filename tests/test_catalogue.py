"""Tagged text files, bags as text, and the catalogue of sequences."""

import struct

import pytest
from test_messages_and_runs import IMU, header, put
from pyspark.sql import functions as F

from wayfold.functions import geometry as geo
from wayfold.plans import catalogue
from wayfold.sources import text


def written(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)
    return str(path)


def test_tagged_files_make_one_stream(spark, tmp_path):
    imu = written(tmp_path / "i.csv", "2.0 1 2 3 4 5 6\n1.0 0 0 0 0 0 9\n")
    front, rear = written(tmp_path / "f.csv", "1.0 -1 0.1 0 9 2 1 2\n"), written(tmp_path / "r.csv", "1.5 -1 0.1 0 9 1 7\n1.0 -1 0.1 0 9 1 8\n")
    odom = written(tmp_path / "o.tum", "1.0 1 0 0 0 0 0 1\n")
    rig = spark.range(2).select(F.concat(F.lit("laser"), F.col("id").cast("string")).alias("frame"), F.lit(1).alias("depth"), geo.literal_pose(0.5, 0.0, 0.0, yaw=0.0).alias("pose"))
    df = catalogue.loaded(spark, [imu], [f"laser0={front}", f"/laser1={rear}"], [odom], rig)
    rows = df.orderBy("stamp_ns", "kind_rank", "file").collect()
    assert [(r.kind, r.frame, r.stamp_ns) for r in rows] == [("imu", None, 10**9), ("odometry", None, 10**9), ("scan", "laser0", 10**9), ("scan", "laser1", 10**9), ("scan", "laser1", 1_500_000_000), ("imu", None, 2 * 10**9)]
    assert rows[2].body.scan.ranges == [1, 2] and rows[2].body.imu is None and rows[2].pose.tx == 0.5 and rows[0].pose is None and rows[5].body.imu.gz == 3.0
    for args in ({"scans": [f"laser0={front}"]}, {"scans": [f"lost={front}"], "rig": rig}, {"odometry": [f"laser0={odom}"], "rig": rig}, {}):
        with pytest.raises(ValueError):
            catalogue.loaded(spark, **args)
    assert catalogue.tagged(" a = b=c ") == ("a", "b=c") and catalogue.tagged("/x/y") == (None, "/x/y")


def bag_with(path, topics):
    imu = header(10**9, b"imu") + struct.pack("<37d", *range(37))
    scan = header(2 * 10**9, b"l") + struct.pack("<7fI", -1, 1, 0.5, 0, 0, 0.1, 9, 2) + struct.pack("<2f", 1, 2)
    body = {"/imu": (*IMU, imu), "/scan": (b"/scan", b"sensor_msgs/LaserScan", scan), "/depth/image": (b"/depth/image", b"sensor_msgs/Image", b"")}
    path.parent.mkdir(parents=True, exist_ok=True)
    return put(path, [[body[t] for t in topics]])


def test_bag_as_text(spark, tmp_path):
    p = bag_with(tmp_path / "a.bag", ["/imu", "/scan"])
    catalogue.exported(spark, p, str(tmp_path / "out"), "/imu", "/scan")
    (i,), (s,) = text.read_imu(spark, str(tmp_path / "out/imu")).collect(), text.read_scans(spark, str(tmp_path / "out/scan")).collect()
    assert (i.stamp_ns, i.gx, i.ax) == (10**9, 13.0, 25.0) and (s.stamp_ns, list(s.ranges)) == (2 * 10**9, [1.0, 2.0])
    with pytest.raises(ValueError):
        catalogue.exported(spark, p, str(tmp_path / "none"))


def test_sequences_of_a_folder(spark, tmp_path):
    bag_with(tmp_path / "set/cafe/run.bag", ["/imu", "/scan"])
    written(tmp_path / "set/cafe/groundtruth.tum", "# t\n10.25 0 0 0 0 0 0 1\n12.5 0 0 0 0 0 0 1\n")
    bag_with(tmp_path / "set/market/run.bag", ["/imu", "/depth/image"])
    written(tmp_path / "set/home/groundtruth.tum", "1 0 0 0 0 0 0 1\n")
    found = {r.sequence: r for r in catalogue.sequences(spark, str(tmp_path / "set")).collect()}
    assert set(found) == {"cafe", "market", "home"}
    cafe, market, home = found["cafe"], found["market"], found["home"]
    assert (cafe.duration_s, cafe.imus, cafe.scans, cafe.depths) == (2.25, ["/imu"], ["/scan"], []) and cafe.bag.endswith("cafe/run.bag")
    assert (market.truth, market.scans, market.depths) == (None, [], ["/depth/image"]) and (home.bag, home.duration_s, home.imus) == (None, 0.0, [])
