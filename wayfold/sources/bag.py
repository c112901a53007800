"""Recorded message logs (version 2.0 bags) as a Spark data source.

The index is read when the job is planned: connections and chunks become partitions. Filters on topic, type and stamp are pushed
down: chunks that hold no wanted topic, or no stamp in the wanted span, are never opened, and messages that don't fit are
never copied. Rows are (chunk, seq, topic, type, stamp_ns, data); order is restored by (chunk, seq).
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
SCHEMA = "chunk int, seq int, topic string, type string, stamp_ns long, data binary"


def fields(raw: bytes) -> dict[str, bytes]:
    """``name=value`` fields of a record header."""
    out, at = {}, 0
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        name, _, value = raw[at + 4 : at + 4 + n].partition(b"=")
        out.setdefault(name.decode(), value)
        at += 4 + n
    return out


def records(raw: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(header, data) of records one after another."""
    at = 0
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        head = fields(raw[at + 4 : at + 4 + n])
        (m,) = struct.unpack_from("<I", raw, at + 4 + n)
        at += 8 + n
        if at + m > len(raw):
            raise ValueError("a record is cut off")
        yield head, raw[at : at + m]
        at += m


def number(value: bytes) -> int:
    return int.from_bytes(value, "little")


class Chunk(NamedTuple):
    """Where a chunk begins, the connections in it, and the span of its stamps; without times in the index it may hold any."""

    at: int
    held: set[int]
    first_ns: int | None = None
    last_ns: int | None = None


def stamp(raw: bytes) -> int:
    seconds, nanos = struct.unpack("<II", raw)
    return seconds * 1_000_000_000 + nanos


def index(path: str) -> tuple[dict[int, tuple[str, str]], list[Chunk]]:
    """Connections (id -> topic, type) and chunks from the end of the file."""
    with _open(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a bag of version 2.0")
        (n,) = struct.unpack("<I", f.read(4))
        start = number(fields(f.read(n))["index_pos"])
        if not start:
            raise ValueError(f"{path} has no index")
        f.seek(start)
        tail = f.read()
    connections, chunks = {}, []
    for head, data in records(tail):
        if number(head["op"]) == CONNECTION:
            connections[number(head["conn"])] = head["topic"].decode(), fields(data).get("type", b"").decode()
        elif number(head["op"]) == CHUNK_INFO:
            span = [stamp(head[k]) if k in head else None for k in ("start_time", "end_time")]
            chunks.append(Chunk(number(head["chunk_pos"]), {number(data[k : k + 4]) for k in range(0, len(data), 8)}, *span))
    return connections, chunks


def resolved(connections: dict[int, tuple[str, str]], topic: str | None, kind: str) -> str:
    """The topic asked for, checked for its type; without one, the only topic of that type."""
    found = sorted({t for t, k in connections.values() if k == kind})
    if topic is not None:
        if topic not in found:
            raise ValueError(f"no topic {topic} of type {kind}")
        return topic
    if len(found) != 1:
        raise ValueError(f"{len(found)} topics of type {kind}: {', '.join(found)}")
    return found[0]


#: Bytes of a file that one partition reads, chunks being whole.
PARTITION_BYTES = 32 << 20


@dataclass
class Wanted:
    """What is read: topics and types (None: all of them), and the first and last stamp."""

    topics: set[str] | None = None
    types: set[str] | None = None
    first_ns: int | None = None
    last_ns: int | None = None

    def narrowed(self, f: Filter) -> bool:
        """Takes a filter in, if it is one on topic, type or stamp."""
        if isinstance(f, IsNotNull):
            return True  # no column of a bag is ever null
        name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
        if name in ("topic", "type") and isinstance(f, EqualTo | In):
            values = set(value) if isinstance(f, In) else {value}
            field_ = f"{name}s"
            held = getattr(self, field_)
            setattr(self, field_, values if held is None else held & values)
            return True
        if name == "stamp_ns" and value is not None and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            low, high = value + isinstance(f, GreaterThan), value - isinstance(f, LessThan)
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.first_ns = low if self.first_ns is None else max(self.first_ns, low)
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.last_ns = high if self.last_ns is None else min(self.last_ns, high)
            return True
        return False

    def connection(self, topic: str, kind: str) -> bool:
        return (self.topics is None or topic in self.topics) and (self.types is None or kind in self.types)

    def chunk(self, c: Chunk) -> bool:
        early = self.first_ns is not None and c.last_ns is not None and c.last_ns < self.first_ns
        late = self.last_ns is not None and c.first_ns is not None and c.first_ns > self.last_ns
        return not early and not late

    def at(self, stamp_ns: int) -> bool:
        return (self.first_ns is None or stamp_ns >= self.first_ns) and (self.last_ns is None or stamp_ns <= self.last_ns)


@dataclass
class Chunks(InputPartition):
    path: str
    places: list[tuple[int, int]]  # (number, position)
    wanted: dict[int, tuple[str, str]]


def _open(path: str):
    """A file of a local path, or of a store that Arrow knows by its URI."""
    if "://" not in path:
        return open(path, "rb")
    store, inside = pa_fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


class BagReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        topics = {t for t in options.get("topics", "").split(",") if t}
        self.only = Wanted(topics or None)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.only.narrowed(f)]

    def partitions(self) -> list[InputPartition]:
        connections, chunks = index(self.path)
        wanted = {k: v for k, v in connections.items() if self.only.connection(*v)}
        out: list[Chunks] = []
        begin = None
        for i, chunk in enumerate(chunks):
            if not chunk.held & wanted.keys() or not self.only.chunk(chunk):
                continue
            if begin is None or chunk.at - begin >= PARTITION_BYTES:
                out.append(Chunks(self.path, [], wanted))
                begin = chunk.at
            out[-1].places.append((i, chunk.at))
        return out

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "seq", "topic", "type", "stamp_ns", "data"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for n, position in partition.places if partition else ():  # none, if no chunk has a wanted topic
            rows = list(self._messages(partition.path, n, position, partition.wanted))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def _messages(self, path: str, chunk: int, position: int, wanted: dict[int, tuple[str, str]]) -> Iterator[tuple]:
        with _open(path) as f:
            f.seek(position)
            head = fields(f.read(*struct.unpack("<I", f.read(4))))
            data = f.read(*struct.unpack("<I", f.read(4)))
        kind = head["compression"].decode()
        if kind not in ("none", "bz2", "lz4"):
            raise ValueError(f"compression {kind} is not supported")
        size = number(head["size"])
        raw = bz2.decompress(data) if kind == "bz2" else pa.decompress(data, size, "lz4", asbytes=True) if kind == "lz4" else data
        if len(raw) != number(head["size"]):
            raise ValueError("a chunk has another size than its header says")
        for seq, (record, body) in enumerate(records(raw)):
            if number(record["op"]) == MESSAGE and number(record["conn"]) in wanted:
                at = stamp(record["time"])
                if self.only.at(at):
                    yield chunk, seq, *wanted[number(record["conn"])], at, body


class BagSource(DataSource):
    """``spark.read.format("bag").option("topics", "/a,/b").load(path)``; the path, local or the URI of a store, must be one that all executors open."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BagReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, which then pushes filters down into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)


# ---- message bodies


def _header(raw: bytes) -> tuple[int, str, int]:
    """(stamp_ns, frame, where the header ends)."""
    _, seconds, nanos, n = struct.unpack_from("<IIII", raw)
    return seconds * 1_000_000_000 + nanos, raw[16 : 16 + n].decode(errors="replace"), 16 + n


def imu(raw: bytes) -> tuple:
    """(stamp_ns, frame, gx, gy, gz, ax, ay, az); orientation and covariances are passed over."""
    stamp, frame, at = _header(raw)
    return stamp, frame, *struct.unpack_from("<3d", raw, at + 13 * 8), *struct.unpack_from("<3d", raw, at + 25 * 8)


def scan(raw: bytes) -> tuple:
    """(stamp_ns, frame, angle_min, angle_increment, range_min, range_max, ranges)."""
    stamp, frame, at = _header(raw)
    low, _, step, _, _, near, far, n = struct.unpack_from("<7fI", raw, at)
    if at + 32 + 4 * n > len(raw):
        raise ValueError("more ranges announced than there are")
    return stamp, frame, low, step, near, far, list(struct.unpack_from(f"<{n}f", raw, at + 32))


def odometry(raw: bytes) -> tuple:
    """(stamp_ns, frame, child, tx, ty, tz, qx, qy, qz, qw)."""
    stamp, frame, at = _header(raw)
    (n,) = struct.unpack_from("<I", raw, at)
    return stamp, frame, raw[at + 4 : at + 4 + n].decode(errors="replace"), *struct.unpack_from("<7d", raw, at + 4 + n)
