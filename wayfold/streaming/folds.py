"""The ordered folds of ``operators.folds`` over a stream: same classes, state kept between micro-batches.

``folded_stream`` orders the rows of a run by themselves, ``folded_events`` by the watermark of the stream: there waiting rows lie in a
list state of their own columns and leave by timers.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded_stream(stream: DataFrame, make: Callable[[], object], key: str, order: Sequence[str], delay: int = 0, late: bool = False, closing: str | None = None) -> DataFrame:
    """(key, what the fold gives) in append mode.

    Rows wait until one of their run is ``delay`` further on in ``order[0]``, which therefore is the watermark of the
    run; they are folded in order then, whatever batch brought them. Rows below it are too late, as a fold can't be
    undone: with ``late`` the column n_late says, in the last row of a batch, how many of the run's there have been.
    A row whose boolean column ``closing`` is true is not folded: it ends its run, so all that waits leaves. Without such rows the
    last ``delay`` of a run waits on.
    """
    columns = make().columns + (", n_late long" if late else "")
    names = [c.strip().split()[0] for c in columns.split(",")]
    order = list(order)

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, top, held, fold, missed = pickle.loads(state.get[0]) if state.exists else (None, None, [], make(), 0)
        rows = held + [r for f in frames for r in f.to_dict("records")]
        closed = bool(closing) and any(r[closing] for r in rows)
        rows = [r for r in rows if not closing or not r[closing]]
        place = lambda r: tuple(r[c] for c in order)
        rows.sort(key=place)
        if rows:
            top = rows[-1][order[0]] if top is None else max(top, rows[-1][order[0]])
        held, out = [], []
        for r in rows:
            if last is not None and place(r) < last:
                missed += 1
            elif delay and not closed and r[order[0]] > top - delay:
                held.append(r)
            else:
                last = place(r)
                if (made := fold.step(r)) is not None:
                    out.append(made)
        if late and out:
            out[-1]["n_late"] = missed
        state.update((pickle.dumps((last, top, held, fold, missed)),))
        found = pd.DataFrame(out, columns=names)
        found.insert(0, key, k[0])
        yield found

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {columns}", "fold binary", "append", GroupStateTimeout.NoTimeout)


class Ordered(StatefulProcessor):
    """Rows of a run, by its watermark: they wait in a list, a timer at the earliest one lets out what the watermark has passed."""

    def __init__(self, make: Callable[[], object], rows: StructType, key: str, order: Sequence[str], stamp_ns: str, names: list[str]):
        self.make, self.rows, self.key, self.order, self.names = make, rows, key, list(order), names
        self.at = rows.names.index(stamp_ns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.fold = handle.getValueState("fold", "state binary, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for f in rows for r in f[self.rows.names].itertuples(index=False, name=None)]
        if new and not pd.isna(key[0]):  # heartbeats only move the watermark
            self.waiting.appendList([self._plain(r) for r in new])
            self._wake(min(map(self._ms, new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        due = [dict(zip(self.rows.names, r, strict=True)) for r in rows if self._ms(r) <= now]
        due.sort(key=lambda r: tuple(r[c] for c in self.order))
        rest = [r for r in rows if self._ms(r) > now]
        fold = pickle.loads(self.fold.get()[0]) if self.fold.exists() else self.make()
        out = [made for r in due if (made := fold.step(r)) is not None]
        self.fold.update((pickle.dumps(fold), -1))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(min(map(self._ms, rest)))
        found = pd.DataFrame(out, columns=self.names)
        found.insert(0, self.key, key[0])
        yield found

    def _ms(self, row: tuple) -> int:
        return int(row[self.at]) // 1_000_000

    def _plain(self, row: tuple) -> tuple:
        return tuple(None if x is None or x is pd.NaT else x.item() if hasattr(x, "item") else x for x in row)

    def _wake(self, ms: int) -> None:
        """A timer for the earliest row that waits; an earlier one stays, as what it lets out then asks for the next."""
        self.handle.registerTimer(int(ms))

    def close(self) -> None:
        pass


def folded_events(stream: DataFrame, make: Callable[[], object], key: str, order: Sequence[str], stamp_ns: str, delay: str) -> DataFrame:
    """(key, what the fold gives) in append mode, in event time.

    ``stamp_ns`` gives the event time, ``delay`` (as "20 seconds") how far the watermark stays behind the latest one of the whole
    stream. Rows wait until the watermark has passed them and are folded in ``order`` then; later ones are dropped and counted by
    Spark (numRowsDroppedByWatermark in a query's progress). A row with null for the key is a heartbeat: it is not folded,
    but moves the watermark, so one that lies ``delay`` beyond the end of a bounded stream lets out all that waits. State is
    a list of rows and the fold itself; the session must keep it in RocksDB.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    names = [c.strip().split()[0] for c in make().columns.split(",")]
    ms = F.expr(f"`{stamp_ns}` div 1000000")
    timed = stream.withColumn("__at", F.timestamp_millis(ms)).withWatermark("__at", delay)
    rows = StructType([f for f in stream.schema.fields if f.name != key])
    kind = stream.schema[key].dataType.simpleString()
    processor = Ordered(make, rows, key, order, stamp_ns, names)
    return timed.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {make().columns}", "append", "eventTime")
