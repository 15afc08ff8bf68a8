"""Keyed state and interval joins: streams of several batches with late rows against the same functions over tables, and against brute force."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import txlog
from lodestone.streaming import keyed, streams

pytest.importorskip("google.protobuf")  # what PySpark's state API needs
START = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batches(spark, folder, schema, parts):
    """A stream that takes one part a batch, in their order."""
    folder.mkdir()
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{k}")
        file = next(folder.parent.glob(f"{folder.name}-{k}/*.parquet")).rename(folder / f"{k}.parquet")
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ran(stream, name, at):
    running = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(at)).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.table(name)


def at(minutes):
    return START + minutes * MINUTE


def test_first_seen(rocks, tmp_path):
    schema = "k string, ts timestamp, n int"
    parts = [
        [("a", at(0), 1), ("a", at(5), 2), (None, at(3), 3), ("a", None, 9)],
        [("a", at(2), 4), ("b", at(20), 5)],  # out of order, and in time: the watermark is at -5
        [("a", at(30), 6), ("a", at(30), 7), ("b", at(28), 8)],  # equal times; b within ten minutes of its last
        [("a", at(1), 10), ("b", at(39), 11)],  # a is late (watermark 25) and dropped; b eleven minutes after its last
        [("z", at(300), 12)],  # moves the watermark; z itself stays in the state
        [("b", at(296), 13)],
        [("z", at(900), 14)],
    ]
    seen = keyed.first_seen(batches(rocks, tmp_path / "in", schema, parts), "ts", ["k"], 10 * MINUTE, "5 minutes")
    got = {(r["k"], r["n"]) for r in ran(seen, "first_seen_rows", tmp_path / "cp").collect()}
    on_time = [r for p in parts for r in p if r[1] is not None and r[2] not in (10, 14)]
    table = keyed.first_seen(rocks.createDataFrame(on_time, schema), "ts", ["k"], 10 * MINUTE)
    assert got == {(r["k"], r["n"]) for r in table.collect()} == {("a", 1), (None, 3), ("b", 5), ("a", 6), ("b", 11), ("z", 12), ("b", 13)}
    assert keyed.first_seen(rocks.createDataFrame([], schema), "ts", ["k"], MINUTE).count() == 0


def test_first_seen_table_equals_brute_force(spark):
    rows = [(i % 7 if i % 11 else None, at((i * 37) % 400), i) for i in range(200)]
    got = {r["n"] for r in keyed.first_seen(spark.createDataFrame(rows, "k int, ts timestamp, n int"), "ts", ["k"], 12 * MINUTE).collect()}
    want, last = set(), {}
    for k, ts, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or ts - last[k] > 12 * MINUTE:
            want.add(n)
        last[k] = ts
    assert got == want and 7 < len(got) < 200


def test_transitions_of_a_log(rocks, tmp_path):
    log = txlog.TransactionLog(rocks, f"file://{tmp_path}/t")
    log.initialise("{}")
    add = lambda p, n=1: {"action": "add", "path": p, "size": n, "modificationTime": 0, "dataChange": True, "partitionValues": {}, "numRecords": n}
    log.commit([add("x"), add("y")])
    log.commit([add("x", 2)])  # the same file with new statistics
    log.remove(["x"], 1)
    log.commit([add("x", 3), add("z")])
    log.commit([{"action": "remove", "path": "z", "deletionTimestamp": 1}, add("z", 4)])
    stream = keyed.transitions(streams.log_changes(rocks, f"file://{tmp_path}/t", files_per_trigger=1))
    got = [(r["version"], r["seq"], r["action"], r["path"]) for r in ran(stream, "log_transitions", tmp_path / "cp").select("version", "seq", "action", "path").collect()]
    table = keyed.transitions(log.actions().filter("action in ('add', 'remove')"))
    assert sorted(got) == sorted(tuple(r) for r in table.select("version", "seq", "action", "path").collect())
    assert sorted((a, p) for _, _, a, p in got) == sorted([("add", "x"), ("add", "y"), ("remove", "x"), ("add", "x"), ("add", "z"), ("remove", "z"), ("add", "z")])
    live = {p for p in "xyz" if sum(1 if a == "add" else -1 for _, _, a, q in got if q == p) == 1}
    assert live == {r["path"] for r in txlog.replay(log.actions()).collect()}
    again = log.actions().filter("action in ('add', 'remove')")
    assert keyed.transitions(again.unionByName(again)).count() == len(got)  # versions read twice


def test_interval_join(spark, tmp_path):
    a = [[("u", at(0), 1), ("v", at(10), 2)], [("u", at(31), 3)], [("u", at(4), 4)], [("w", at(500), 5), ("u", at(3), 6)]]
    b = [[("u", at(2), 10), ("u", at(5), 11), (None, at(0), 12)], [("v", at(7), 13), ("u", at(26), 14), ("u", at(36), 15)], [("u", at(32), 16)], [("v", at(501), 17)]]
    left, right = (batches(spark, tmp_path / n, f"k string, {t} timestamp, {n} int", p) for n, t, p in (("x", "t1", a), ("y", "t2", b)))
    joined = keyed.interval_join(left, right, ["k"], "t1", "t2", 3 * MINUTE, 5 * MINUTE, "10 minutes")
    got = {(r["x"], r["y"]) for r in ran(joined, "interval_pairs", tmp_path / "cp").collect()}
    of = lambda parts, late: [r for p in parts for r in p if r[2] not in late]
    brute = lambda xs, ys: {(x[2], y[2]) for x in xs for y in ys if x[0] == y[0] and x[1] - 3 * MINUTE <= y[1] <= x[1] + 5 * MINUTE}
    table = keyed.interval_join(spark.createDataFrame(of(a, ()), "k string, t1 timestamp, x int"), spark.createDataFrame(of(b, ()), "k string, t2 timestamp, y int"), ["k"], "t1", "t2", 3 * MINUTE, 5 * MINUTE)
    assert sorted((r["x"], r["y"]) for r in table.collect()) == sorted(brute(of(a, ()), of(b, ())))
    # 4 and 6 come when both sides are ten minutes past them: 4 may meet what is still held, 6 comes when its partners' state is gone
    assert {p for p in got if p[0] != 4} == brute(of(a, (4, 6)), of(b, ())) and got <= brute(of(a, (6,)), of(b, ()))
    with pytest.raises(ValueError, match="both sides"):
        keyed.interval_join(left, left, ["k"], "t1", "t1", MINUTE, MINUTE)


def test_first_seen_keeps_one_value_for_a_key_and_trigger():
    from pyspark.sql import Row, types as T

    class State:  # of a list or a value
        def __init__(self):
            self.values = []

        exists = lambda self: bool(self.values)
        get = lambda self: self.values[0] if self.single else iter(list(self.values))
        clear = lambda self: self.values.clear()
        appendValue = lambda self, value: self.values.append(value)
        appendList = put = lambda self, values: self.values.extend(values)
        update = lambda self, value: self.values.append(value)

    held, last, timers = State(), State(), []
    held.single, last.single = False, True
    held.put = lambda values: setattr(held, "values", list(values))
    handle = type("Handle", (), {"getListState": lambda *a: held, "getValueState": lambda *a: last, "registerTimer": lambda self, t: timers.append(t)})()
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.LongType())])
    judge = keyed._FirstSeen(schema, "ts", ["n"], 10 * MINUTE)
    judge.init(handle)
    row = Row("k", "ts", "n", "_micros")
    rows = [row("a", at(m), n, m * 60_000_000) for n, m in enumerate([30, 0, 5, 0, None, 41] * 10) if m is not None]
    for part in (rows[:25], rows[25:]):
        assert not list(judge.handleInputRows(("a",), iter(part), None))
    assert len(held.values) == 2 and timers == [0, 0]  # a value for each trigger, not for each row
    now = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 35 * 60_000})()
    assert [(r["ts"], r["n"]) for r in judge.handleExpiredTimer(("a",), now, None)] == [(at(0), 1), (at(30), 0)]
    assert len(held.values) == 1 and last.values[-1] == (30 * 60_000_000,) and timers[-1] == 41 * 60_000
