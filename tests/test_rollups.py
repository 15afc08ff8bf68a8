"""Stored partial aggregates: exact metrics are exact, sketches keep their error, parts merge in any grouping."""

import math
import random

import pytest
from lodestone.operators.rollups import Rollup
from lodestone.plans import nodes as q


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(i, f"k{i % 3}", i % 2, None if i % 17 == 0 else rng.expovariate(0.01), f"u{rng.randrange(4000)}") for i in range(30_000)]
    data += [(-1, None, 0, float("nan"), None), (-2, "k0", 0, None, "")]
    return spark.createDataFrame(data, "id long, key string, half int, amount double, user string")


@pytest.fixture(scope="module")
def rollup(spark, rows, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('rollup')}/r"
    for n in range(3):
        Rollup.write(rows.filter(f"id % 3 = {n} or (id < 0 and {n} = 0)"), where, ["key", "half"], ["amount", "user"], part=f"p{n}")
    return Rollup(spark, where)


METRICS = {"n": {"doc_count": {}}, "c": {"value_count": {"field": "amount"}}, "s": {"sum": {"field": "amount"}}, "a": {"avg": {"field": "amount"}}, "lo": {"min": {"field": "amount"}}, "hi": {"max": {"field": "user"}}, "v": {"variance": {"field": "amount"}}, "d": {"cardinality": {"field": "user"}}, "p": {"percentiles": {"field": "amount", "percents": [1, 50, 99]}}}


@pytest.mark.parametrize("by", [[], ["key"], ["half"], ["key", "half"]])
@pytest.mark.parametrize("merged", [False, True])
def test_groups_of_all_parts(rows, rollup, tmp_path, by, merged):
    source = rollup.merge(f"file://{tmp_path}/m") if merged else rollup
    groups = {}
    for r in rows.collect():
        groups.setdefault(tuple(r[k] for k in by), []).append(r)
    found = {tuple(r[k] for k in by): r for r in source.aggregate(METRICS, by).collect()}
    assert set(found) == set(groups)
    for key, members in groups.items():
        r, values = found[key], sorted(m["amount"] for m in members if m["amount"] is not None and not math.isnan(m["amount"]))
        users = {m["user"] for m in members if m["user"] is not None}
        assert (r["n"], r["c"], r["lo"]) == (len(members), len(values), values[0] if values else None) and r["hi"] == (max(users) if users else None)
        if not values:
            assert r["s"] is None and r["a"] is None and r["p_p50"] is None and r["d"] == 0
            continue
        mean = sum(values) / len(values)
        assert r["s"] == pytest.approx(sum(values)) and r["a"] == pytest.approx(mean) and r["v"] == pytest.approx(sum((x - mean) ** 2 for x in values) / len(values))
        assert abs(r["d"] - len(users)) <= 0.03 * len(users)
        for p in (1, 50, 99):
            below, upto = sum(x < r[f"p_p{p}"] for x in values) / len(values), sum(x <= r[f"p_p{p}"] for x in values) / len(values)
            assert below - 0.01 <= p / 100 <= upto + 0.01


def test_filters_and_errors(rows, rollup):
    got = rollup.aggregate({"n": {"doc_count": {}}}, ["half"], q.Term("key", "k1")).collect()
    assert sorted((r["half"], r["n"]) for r in got) == [(0, 5000), (1, 5000)]
    for metrics, by, query in (({"x": {"sum": {"field": "user"}}}, [], None), ({"x": {"sum": {"field": "other"}}}, [], None), ({"x": {"mode": {"field": "amount"}}}, [], None), (METRICS, ["user"], None), (METRICS, [], q.Term("user", "u1"))):
        with pytest.raises(ValueError):
            rollup.aggregate(metrics, by, query)


def test_a_part_is_replaced(spark, rows, tmp_path):
    out = Rollup.write(rows.limit(10), f"file://{tmp_path}/r", ["key"], ["user"], part="a")
    Rollup.write(rows.limit(4), f"file://{tmp_path}/r", ["key"], ["user"], part="a")
    Rollup.write(rows.limit(0), f"file://{tmp_path}/r", ["key"], ["user"], part="b")
    assert out.aggregate({"n": {"doc_count": {}}}).first()["n"] == 4
