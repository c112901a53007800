"""Event-time folds with timers, and filters that reach a bag."""

import struct

import pytest
from pyspark.sql import functions as F
from test_messages_and_runs import IMU, header, put
from test_sources import record, u32

from wayfold.operators import folds
from wayfold.plans import run
from wayfold.sources import bag, messages
from wayfold.streaming.folds import ROCKS, folded_events, folded_stream

MS = 1_000_000


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, batches, schema, make):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return spark.read.parquet(f"{tmp_path}/out"), q


def test_event_time_stream_equals_batch_and_holds_nothing_back(spark, tmp_path, rocks):
    schema = "run string, stamp_ns long, seq long"
    stamps = {"a": [0, 30, 10, 20, 45, 40, 60, 90], "b": [5, 12, 44, 31, 80]}
    rows = [[(r, (1000 + t) * MS, t) for r, ts in stamps.items() for t in ts[k : k + 2]] for k in range(0, 8, 2)]  # no stamp at the beginning of time, where the watermark starts
    beat = [(None, 10_000 * MS, 0)]
    found, q = streamed(spark, tmp_path, [*rows, beat], schema, lambda s: folded_events(s, lambda: folds.Segments(25 * MS), "run", ["stamp_ns", "seq"], "stamp_ns", "30 milliseconds"))
    batch = folds.folded(spark.createDataFrame([r for b in rows for r in b], schema), lambda: folds.Segments(25 * MS), "run", ["stamp_ns", "seq"])
    plain = lambda df: sorted((r.run, r.stamp_ns, r.segment) for r in df.collect())
    assert plain(found) == plain(batch)


def test_rows_below_the_watermark_are_counted(spark, tmp_path, rocks):
    schema = "run string, stamp_ns long, seq long"
    batches = [[("a", 1000 * MS, 1)], [("a", 2000 * MS, 2)], [("a", 10 * MS, 3), ("a", 2100 * MS, 4)], [(None, 90_000 * MS, 0)]]
    found, q = streamed(spark, tmp_path, batches, schema, lambda s: folded_events(s, lambda: folds.Segments(25 * MS), "run", ["stamp_ns", "seq"], "stamp_ns", "50 milliseconds"))
    assert sorted(r.seq for r in found.collect()) == [1, 2, 4]
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1


def test_event_time_needs_the_state_store(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("r").alias("run"), F.col("value").alias("stamp_ns"), F.col("value").alias("seq"))
    with pytest.raises(ValueError, match="stateStore"):
        folded_events(stream, folds.Segments, "run", ["stamp_ns"], "stamp_ns", "1 second")


def test_a_closing_row_lets_out_what_waits(spark, tmp_path):
    schema = "run string, stamp_ns long, seq long, last boolean"
    batches = [[("r", 0, 0, False), ("r", 30, 30, False)], [("r", 20, 20, False), ("r", 90, 90, False)], [("r", 0, 0, True)]]
    found, _ = streamed(spark, tmp_path, batches, schema, lambda s: folded_stream(s, lambda: folds.Segments(25), "run", ["stamp_ns", "seq"], delay=20, closing="last"))
    assert sorted(r.stamp_ns for r in found.collect()) == [0, 20, 30, 90]


def timed(path, chunks):
    """chunks: lists of (topic, type, stamp in seconds, body), with the span of each in the index."""
    kinds = sorted({(t, k) for c in chunks for t, k, _, _ in c})
    names = {t: n for n, (t, _) in enumerate(kinds)}
    when = lambda s: struct.pack("<II", s, 0)
    head = lambda at: record(b" " * 20, op=b"\x03", index_pos=struct.pack("<Q", at), conn_count=u32(len(kinds)), chunk_count=u32(len(chunks)))
    body, places = b"", []
    for c in chunks:
        raw = b"".join(record(b, op=b"\x02", conn=u32(names[t]), time=when(s)) for t, _, s, b in c)
        places.append(len(bag.MAGIC) + len(head(0)) + len(body))
        body += record(raw, op=b"\x05", compression=b"none", size=u32(len(raw)))
    tail = b"".join(record(u32(5 + len(k)) + b"type=" + k, op=b"\x07", conn=u32(n), topic=t) for n, (t, k) in enumerate(kinds))
    tail += b"".join(record(b"".join(u32(names[t]) + u32(1) for t in {t for t, *_ in c}), op=b"\x06", chunk_pos=struct.pack("<Q", p), count=u32(len(c)), start_time=when(min(x[2] for x in c)), end_time=when(max(x[2] for x in c))) for p, c in zip(places, chunks))
    path.write_bytes(bag.MAGIC + head(len(bag.MAGIC) + len(head(0)) + len(body)) + body + tail)
    return str(path)


def test_filters_reach_the_bag(spark, tmp_path):
    p = timed(tmp_path / "a.bag", [[(b"/a", b"x/A", 1, b"1"), (b"/b", b"x/B", 2, b"2")], [(b"/a", b"x/A", 5, b"3")], [(b"/b", b"x/B", 9, b"4"), (b"/c", b"x/A", 8, b"5")]])
    bag.register(spark)
    df = spark.read.format("bag").load(p)
    second = 10**9
    cases = [
        (F.col("topic") == "/a", [b"1", b"3"], 2),
        (F.col("topic").isin("/b", "/c") & (F.col("stamp_ns") > 2 * second), [b"4", b"5"], 1),
        (F.col("stamp_ns") < 5 * second, [b"1", b"2"], 1),
        ((F.col("type") == "x/A") & (F.col("stamp_ns") >= 5 * second) & (F.col("stamp_ns") <= 8 * second), [b"3", b"5"], 2),
        (F.col("stamp_ns") == 9 * second, [b"4"], 1),
        (F.length("data") > 0, [b"1", b"2", b"3", b"4", b"5"], 3),
    ]
    for condition, want, _ in cases:
        assert sorted(bytes(r.data) for r in df.where(condition).collect()) == want
    # what the reader is told, and the chunks that are then opened
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringContains

    for filters, opened, left in [([EqualTo(("topic",), "/a")], [0, 1], 0), ([In(("topic",), ("/b", "/c")), GreaterThan(("stamp_ns",), 2 * second)], [2], 0), ([LessThan(("stamp_ns",), 5 * second)], [0], 0), ([StringContains(("topic",), "a")], [0, 1, 2], 1), ([EqualTo(("topic",), "/a"), EqualTo(("topic",), "/b")], [], 0)]:
        reader = bag.BagReader({"path": p})
        assert len(list(reader.pushFilters(filters))) == left
        assert [n for part in reader.partitions() for n, _ in part.places] == opened


def test_several_topics_in_one_pass(spark, tmp_path, monkeypatch):
    imu = lambda s, g: header(s, b"imu") + struct.pack("<37d", *[g] * 37)
    gyro, accel = (b"/gyro", IMU[1]), (b"/accel", IMU[1])
    scan = header(3 * 10**9, b"laser") + struct.pack("<7fI", -1, 1, 0.5, 0, 0, 0.1, 9, 3) + struct.pack("<3f", 1, 2, 3)
    p = put(tmp_path / "r.bag", [[(*IMU, imu(2 * 10**9, 1.0)), (*gyro, imu(10**9, 5.0)), (*accel, imu(0, 0.0))], [(b"/scan", b"sensor_msgs/LaserScan", scan), (*accel, imu(2 * 10**9, 8.0))]])
    df = messages.read_streams(spark, p, {"/imu": "imu", "/scan": "scan"})
    rows = {r.topic: r for r in df.collect()}
    assert rows["/imu"].imu.gx == 1.0 and rows["/imu"].scan is None and rows["/scan"].scan.ranges == [1, 2, 3] and rows["/scan"].frame == "laser"
    assert df._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    for wrong in ({"/imu": "scan"}, {"/nothing": "imu"}):
        with pytest.raises(ValueError):
            messages.read_streams(spark, p, wrong)
    config = run.parsed(run.Run, {"sensors": {"imus": [{"topic": "/imu"}, {"gyro_topic": "/gyro", "accel_topic": "/accel"}], "scans": [{"topic": "/scan"}]}})
    found = run.assembled(spark, config, p).orderBy("stamp_ns", "kind_rank", "place").collect()
    assert [(r.kind, r.kind_rank, r.topic) for r in found] == [("imu", 0, "/gyro"), ("imu", 0, "/imu"), ("scan", 2, "/scan")]
    assert found[0].body.imu.gx == 5.0 and found[0].body.imu.ax == 4.0 and found[2].body.scan.range_max == 9.0
