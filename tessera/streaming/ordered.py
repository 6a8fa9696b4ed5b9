"""Stateful streaming in event time: the rows of a key are taken in their order, however late in the delay they arrive.

Rows wait in the state until the watermark has passed them; a timer then takes those that are due, in order, one by
one. What arrives behind the watermark is dropped, as everywhere in event time. State lives in RocksDB.

A call of the state store costs milliseconds, so keys share them: a hash deals keys to PARTS parts, and a part has one
timer, its waiting rows as Arrow tables and its keys' states as another. A part must fit a worker's memory, not more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The key, and the time in microseconds that rows are ordered by; ties go by `seq`.
KEY, AT, SEQ = "key", "at", "seq"
#: Parts that keys are dealt to; a checkpoint holds for the number it was begun with.
PARTS = 256
#: Rows of a piece: of what is stored at once, and of what is in Python's own objects at once.
PIECE = 50_000


def use_rocksdb(spark: SparkSession) -> None:
    """Such queries need this store; set for the session before one starts, as it is part of its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Fold(StatefulProcessor):
    """Takes a key's rows in order. step(key, state or None, row) gives (state, rows out).

    With `wake`, a key is also woken when its time has come: wake(state) is the time in microseconds of the next call or
    None, woken(key, state) gives (state, rows out). Rows of before that time come before it.
    fields: of a row, led by key, at and seq; kept: of a key's state, led by key.
    """

    def __init__(self, fields: pa.Schema, kept: pa.Schema, out: list[str], step: Callable, wake: Callable | None = None, woken: Callable | None = None):
        self.fields, self.kept, self.out, self.step, self.wake, self.woken = fields, kept, out, step, wake, woken

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "rows binary")
        self.timer = handle.getValueState("timer", "due bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(frame[self.fields.names], self.fields, preserve_index=False) for frame in rows]
        new = pa.concat_tables(new) if new else self.fields.empty_table()
        if new.num_rows:
            self._wait(new)
            due = -(-pc.min(new[AT]).as_py() // 1000)  # timers count milliseconds
            set_for = self.timer.get()[0] if self.timer.exists() else None
            if set_for is None or due < set_for:
                if set_for is not None:
                    self.handle.deleteTimer(set_for)
                self._set(due)
        return iter(())

    def _wait(self, rows: pa.Table) -> None:
        for at in range(0, rows.num_rows, PIECE):
            self.waiting.appendValue((packed(rows.slice(at, PIECE)),))

    def _set(self, due: int) -> None:
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pa.concat_tables([self.fields.empty_table(), *(unpacked(piece[0]) for piece in self.waiting.get())] if self.waiting.exists() else [self.fields.empty_table()])
        is_due = pc.less_equal(rows[AT], passed)
        due, rest = rows.filter(is_due).sort_by([(name, "ascending") for name in (KEY, AT, SEQ)]), rows.filter(pc.invert(is_due))
        states = {}
        if self.held.exists():
            states = {name: state for name, *state in zip(*(c.to_pylist() for c in unpacked(self.held.get()[0]).columns), strict=True)}
        for at in range(0, due.num_rows, PIECE):
            yield from self._told(self._taken(due.slice(at, PIECE), states))
        if self.wake:
            yield from self._told(row for name in states for row in self._roused(name, states, passed))
        if due.num_rows:
            self.waiting.clear()
            self._wait(rest)
        if states:
            columns = zip(*((name, *state) for name, state in states.items()), strict=True)
            self.held.update((packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.kept, strict=True)], schema=self.kept)),))
        later = [pc.min(rest[AT]).as_py()] if rest.num_rows else []
        if self.wake:
            later += [at for state in states.values() if (at := self.wake(state)) is not None]
        # the timer that is handled goes by itself
        if later:
            self._set(-(-min(later) // 1000))
        else:
            self.timer.clear()

    def _taken(self, due: pa.Table, states: dict) -> Iterator[tuple]:
        """What a piece of the rows, in order, gives; the states are brought up to it."""
        step, wake = self.step, self.wake
        for name, rows in groupby(zip(*(c.to_pylist() for c in due.columns), strict=True), key=lambda row: row[0]):
            state = states.get(name)
            for row in rows:
                if wake and state is not None and (at := wake(state)) is not None and at <= row[1]:
                    states[name] = state
                    yield from self._roused(name, states, row[1])
                    state = states[name]
                state, more = step(name, state, row[1:])
                yield from more
            if state is not None:
                states[name] = state

    def _roused(self, name: Any, states: dict, until: int) -> Iterator[tuple]:
        while (at := self.wake(states[name])) is not None and at <= until:
            states[name], more = self.woken(name, states[name])
            yield from more

    def _told(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out = list(rows)
        if out:
            yield pd.DataFrame(out, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, time: str, delay: str, fields: list[tuple[str, str]], state: str, out: str, step: Callable, wake: Callable | None = None, woken: Callable | None = None) -> DataFrame:
    """A stream with columns key, `time`, seq and the fields, folded by key; at (microseconds) and seq lead each row that step gets.

    out: the schema of what step gives. Rows without a time or later than the delay have no part.
    """
    use_rocksdb(rows.sparkSession)
    timed = rows.where(F.col(time).isNotNull()).withWatermark(time, delay).withColumn(AT, F.unix_micros(time))
    timed = timed.withColumn("part", F.pmod(F.xxhash64(KEY), F.lit(PARTS)).cast("int"))
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    key = f"{KEY} {rows.schema[KEY].dataType.simpleString()}"
    whole = ", ".join([key, f"{AT} bigint, {SEQ} bigint", *[f"{name} {kind}" for name, kind in fields]])
    fold = Fold(arrow(whole), arrow(f"{key}, {state}"), [c.split()[0] for c in out.split(", ")], step, wake, woken)
    return timed.groupBy("part").transformWithStateInPandas(statefulProcessor=fold, outputStructType=out, outputMode="Append", timeMode="EventTime")
