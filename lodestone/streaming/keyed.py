"""Keyed state on streams: first sightings, transitions of logged files, and joins within an interval of time.

Each function takes a stream or a table, and gives on a stream what it gives on a table of the rows that came in time. On a table it is a plan of
windows and joins without Python. State lives in the store of the session's provider, which must be RocksDB's for ``first_seen`` and ``transitions``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_MICROS = 1_000_000


def _micros(d: timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * _MICROS + d.microseconds


def _interval(d: timedelta) -> str:
    return f"{_micros(d)} microseconds"


def _order(df: DataFrame, time: str, keys: list[str]) -> list[str]:
    """Columns that order the rows of a key: the time, then everything else that has an order, so that equal times have one first row."""
    return [time, *(f.name for f in df.schema.fields if f.name not in (time, *keys) and not isinstance(f.dataType, (T.MapType, T.VariantType)))]


class _FirstSeen(StatefulProcessor):
    """Rows of a key wait in ``held``; when the watermark passes them they are judged in order against ``last``, the time of the row before.

    The rows that a trigger brings to a key are one value of ``held``: a value for each row costs several times as much to store and to read.
    """

    def __init__(self, schema: T.StructType, time: str, order: list[str], forget: timedelta) -> None:
        self.schema, self.time, self.order, self.forget = schema, time, order, _micros(forget)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("micros", T.LongType())]))
        names = self.schema.names
        self.row, self.at = Row(*names), [names.index(c) for c in self.order]

    def _rank(self, row: tuple) -> tuple:
        return (row[-1], *((row[k] is not None, row[k]) for k in self.at))

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))  # timers are in milliseconds: the first that isn't before

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        added = [tuple(r) for r in rows]
        self.held.appendValue((pickle.dumps(added, pickle.HIGHEST_PROTOCOL),))
        self._wake(min(r[-1] for r in added))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for (rows,) in self.held.get() for r in pickle.loads(rows)] if self.held.exists() else []
        due = sorted((r for r in held if r[-1] <= passed), key=self._rank)
        last = self.last.get()[0] if self.last.exists() else None
        for r in due:
            if last is None or r[-1] - last > self.forget:
                yield self.row(*r[:-1])
            last = r[-1]
        rest = [r for r in held if r[-1] > passed]
        if due:
            if rest:
                self.held.put([(pickle.dumps(rest, pickle.HIGHEST_PROTOCOL),)])
            else:
                self.held.clear()
            self.last.update((last,))
        if rest:
            self._wake(min(r[-1] for r in rest))
        elif last is not None and last + self.forget > passed:
            self._wake(last + self.forget)
        elif last is not None:
            self.last.clear()  # whatever comes now is later than the watermark, so it is seen first


def first_seen(df: DataFrame, time: str, keys: list[str], forget: timedelta, late: str = "0 seconds") -> DataFrame:
    """The rows of a key that none of its other rows precedes by ``forget`` or less; of rows at the same time the least.

    A key is forgotten when ``forget`` has passed without a row, and is seen first again. Null is a key like others; rows without a time are dropped.
    On a stream a row waits in the state of its key until the watermark has passed it, so disorder within ``late`` changes nothing; what comes later
    than that is dropped. A timer drops the state of a key once it can decide nothing any more. A key's rows
    of one trigger and of ``late`` are in one task's memory: limit the source's files or offsets in a trigger.
    """
    order = _order(df, time, keys)
    df = df.filter(F.col(time).isNotNull())
    at = F.unix_micros(F.col(time).cast("timestamp"))
    if not df.isStreaming:
        before = F.lag("_micros").over(Window.partitionBy(*keys).orderBy("_micros", *[F.col(c).asc_nulls_first() for c in order[1:]]))
        return df.withColumn("_micros", at).withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_micros") - F.col("_before") > _micros(forget))).select(df.columns)
    rows = df.withWatermark(time, late).withColumn("_micros", at)
    return rows.groupBy(*keys).transformWithState(_FirstSeen(df.schema, time, order[1:], forget), df.schema, "Append", "EventTime")


class _Transitions(StatefulProcessor):
    """The last version and kind of change of a path."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("version", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("action", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, seq, action = self.state.get() if self.state.exists() else (-1, -1, "remove")
        for r in sorted(rows, key=lambda r: (r["version"], r["seq"])):
            if (r["version"], r["seq"]) <= (version, seq):
                continue  # a version that is read again
            version, seq = r["version"], r["seq"]
            if r["action"] != action:
                action = r["action"]
                yield r
        self.state.update((version, seq, action))


def transitions(changes: DataFrame) -> DataFrame:
    """Of adds and removes (``version, seq, action, path`` and more), those that make a path live or take it away.

    A path is not live at first, so a remove of an unknown path, a second add of a live one (new statistics) and a version read twice drop out.
    On a stream the versions must come in their order, as :func:`~.streams.log_changes` gives them; the state is a few words for each path.
    """
    if changes.isStreaming:
        return changes.groupBy("path").transformWithState(_Transitions(changes.columns), changes.schema, "Append", "None")
    of_path = Window.partitionBy("path").orderBy("version", "seq")
    once = changes.withColumn("_n", F.row_number().over(Window.partitionBy("path", "version", "seq").orderBy("action"))).filter("_n = 1")
    return once.withColumn("_was", F.coalesce(F.lag("action").over(of_path), F.lit("remove"))).filter("action <> _was").select(changes.columns)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, before: timedelta, after: timedelta, late: str | None = None) -> DataFrame:
    """Pairs of rows with equal ``on`` whose right time is from ``before`` before the left time to ``after`` after it, both included.

    Besides ``on`` the two share no column. On streams ``late`` is the watermark of both sides, and a row is held until no partner can come in time any more;
    a row that comes later than that is not kept, and may or may not meet what is held still.
    Time is cut into bins as wide as the interval: a left row stands in the two (at most) that its interval touches and a right row in its own, so each
    pair meets once, and the rows of a hot key are spread over as many tasks as it has bins, in a table as in the state of a stream.
    """
    if shared := (set(left.columns) & set(right.columns)) - set(on):
        raise ValueError(f"both sides have {sorted(shared)}")
    if _micros(before) + _micros(after) < 0:
        raise ValueError("the interval ends before it starts")
    width = max(_MICROS, _micros(before) + _micros(after))
    if late is not None:
        left, right = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    of = lambda time, shift: F.floor((F.unix_micros(F.col(time).cast("timestamp")) + shift) / width)
    lows = F.explode(F.sequence(of(left_time, -_micros(before)), of(left_time, _micros(after))))
    a = left.filter(F.col(left_time).isNotNull()).withColumn("_bin", lows).alias("a")
    b = right.withColumn("_bin", of(right_time, 0)).alias("b")
    lt, rt = F.col(f"a.{left_time}"), F.col(f"b.{right_time}")
    near = (rt >= lt - F.expr(f"interval '{_interval(before)}'")) & (rt <= lt + F.expr(f"interval '{_interval(after)}'"))
    for c in [*on, "_bin"]:
        near = near & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, near).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c not in on])
