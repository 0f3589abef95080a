"""Operators that split a pane, a group or a table of any size: against plain Python, with limits so small that each way is taken."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scripts
from tallyloom.operators import aggregates, clean, quantiles, scans, tablecalc


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_quantiles_match_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "SORTED", most)
    rng = np.random.default_rng(7)
    groups = {
        "normal": rng.standard_normal(4000), "ties": rng.integers(0, 4, 3000).astype(float), "skewed": np.exp(rng.standard_normal(3000) * 20), "one": np.array([3.5]), "two": np.array([1.0, 2.0]),
        "same": np.full(2000, 7.0), "half": np.r_[np.zeros(1500), rng.random(1500)], "edge": np.r_[np.full(999, 1.0), [2.0]], None: rng.random(500), "empty": np.zeros(0),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("empty", None), ("two", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {f"q{i}": p for i, p in enumerate((0.0, 0.001, 0.25, 0.5, 2 / 3, 0.999, 1.0))}
    got = {r.g: [r[q] for q in wanted] for r in quantiles.quantiles(df, "x", wanted, ["g"]).collect()}
    assert set(got) == set(groups) and got.pop("empty") == [None] * len(wanted)
    for g, found in got.items():
        np.testing.assert_allclose(found, np.quantile(groups[g], list(wanted.values())), rtol=1e-12, atol=1e-12, err_msg=str(g))
    (whole,) = quantiles.quantiles(df, F.col("x") * 2, {"m": 0.5}).collect()
    np.testing.assert_allclose(whole.m, 2 * np.quantile(np.concatenate(list(groups.values())), 0.5), rtol=1e-12)
    assert quantiles.quantiles(df.limit(0), "x", {"m": 0.5}).collect()[0].m is None and quantiles.quantiles(df.limit(0), "x", {"m": 0.5}, ["g"]).count() == 0


@pytest.fixture(scope="module")
def panes(spark):
    """Three panes and a null one, cut into many parts; every fourth value is null."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, None if rng.random() < 0.25 else rng.randrange(-50, 50)) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "pane string, i int, x int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def by_hand(rows, keyed, backwards=False):
    held, out = {}, {}
    for pane, i, x in sorted(rows, key=lambda r: -r[1] if backwards else r[1]):
        s = held.setdefault(pane if keyed else 0, [None, 0, None, None, None])
        if x is not None:
            s[:] = [(s[0] or 0) + x, s[1] + 1, x if s[2] is None else min(s[2], x), x if s[3] is None else max(s[3], x), x]
        out[i] = tuple(s)
    return out


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("backwards", [False, True])
def test_scans_match_plain_python(panes, keyed, backwards):
    rows, df = panes
    measures = {k: (k, "x") for k in ("sum", "count", "min", "max", "last")}
    out = scans.scan(df, measures, ["-i" if backwards else "i"], ["pane"] if keyed else [])
    assert out.columns == ["pane", "i", "x", *measures]
    assert {r.i: tuple(r)[3:] for r in out.collect()} == by_hand(rows, keyed, backwards)


def test_fills_over_a_whole_table(panes):
    rows, df = panes
    down, up = (df.transform(f(["x"], ["i"])).select("i", "x").collect() for f in (clean.fill_down, clean.fill_up))
    assert {r.i: r.x for r in down} == {i: v[4] for i, v in by_hand(rows, False).items()}
    assert {r.i: r.x for r in up} == {i: v[4] for i, v in by_hand(rows, False, True).items()}
    assert df.limit(0).transform(clean.fill_up(["x"], ["i"])).count() == 0


@pytest.mark.parametrize("keyed", [False, True])
def test_recursion_matches_plain_python(panes, keyed):
    rows, df = panes
    spec = tablecalc.spec(order_by=["i"], partition_by=["pane"] if keyed else [])
    known = df.withColumn("x", F.coalesce("x", F.lit(0)))
    out = tablecalc.previous_value(known, spec, "y", 5.0, lambda before, row: before * (row["x"] % 3) / 2 + row["x"])
    folded = tablecalc.folded(known, spec, "y", 5.0, lambda before, row: before * (row["x"] - 3 * int(row["x"] / 3)) / 2 + row["x"])
    held, want = {}, {}
    for pane, i, x in sorted(rows, key=lambda r: r[1]):
        x = x or 0
        key = pane if keyed else 0
        held[key] = want[i] = held.get(key, 5.0) * (x - 3 * int(x / 3)) / 2 + x
    for frame in (out, folded):
        assert {r.i: r.y for r in frame.collect()} == pytest.approx(want, rel=1e-9)
    assert out.columns == ["pane", "i", "x", "y"] and tablecalc.previous_value(known.limit(0), spec, "y", 0.0, lambda b, r: b).count() == 0


def test_a_step_that_is_not_linear_is_an_error(panes):
    with pytest.raises(Exception, match="not linear"):
        tablecalc.previous_value(panes[1], tablecalc.spec(order_by=["i"]), "y", 1.0, lambda before, row: before * before).collect()


def test_nulls_stop_a_recursion(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "i int, x double")
    out = tablecalc.previous_value(df, tablecalc.spec(order_by=["i"]), "y", 0.0, lambda before, row: before + row["x"])
    assert [r.y for r in out.orderBy("i").collect()] == [1.0, None, None]


def test_frames_that_reach_to_the_end_are_linear(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("p"), F.col("id").alias("i"), F.when(F.col("id") == 39_999, 1).alias("x"))
    fill = rows.transform(clean.fill_up(["x"], ["i"], ["p"])).agg(F.sum("x"))
    spec = tablecalc.spec(order_by=["i"], partition_by=["p"])
    frame = rows.select("i", tablecalc.window("sum", spec, "i", first=-1).alias("s")).agg(F.sum("s"))
    for df, want in ((fill, 40_000), (frame, sum(sum(range(max(i - 1, 0), 40_000)) if i < 3 else 0 for i in range(3)))):
        start = time.time()
        value = df.first()[0]
        assert time.time() - start < 8
        if df is fill:
            assert value == want
    some = rows.filter("i < 50").select("i", tablecalc.window("sum", spec, "i", first=-1).alias("s"), tablecalc.window("count", spec, "i", first=2).alias("c"))
    assert {r.i: (r.s, r.c) for r in some.collect()} == {i: (sum(range(max(i - 1, 0), 50)), max(0, 48 - i)) for i in range(50)}


def test_parts_of_a_large_group_never_meet_in_one_task(spark):
    df = spark.range(25_000).selectExpr("if(id < 24000, 'a', if(id < 24990, null, string(id))) as g", "double(id) as lat", "double(id % 7) as lon")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = aggregates.collect_parts(df, ["g"], "lat", "lon", 1000)
        rows = parts.collect()
        assert "SortMergeJoin" not in parts._jdf.queryExecution().executedPlan().toString()
        small = aggregates.collect_parts(df, ["g"], "lat", "lon", 500).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for most, found in ((1000, rows), (500, small)):
        assert sorted(int(p.lat) for r in found for p in r.points) == list(range(25_000))
        assert all(p.lon == p.lat % 7 for r in found for p in r.points)
        assert sorted(r.part for r in found if r.g == "a") == list(range(24_000 // most))
        assert max(len(r.points) for r in found) < 1.5 * most
        assert sum(r.g is None for r in found) == -(-990 // most) and sum(r.g not in ("a", None) for r in found) == 10


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_table_steps_give_each_group_whole_and_many_to_a_batch(spark, batch):
    big = (1 << 53) + 1
    rows = [(i % 300 if i % 301 else None, big + i, None if i % 900 == 5 else i % 2 == 0, float("nan") if i % 50 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, n long, b boolean, x double").repartition(5)
    schema = "k long, rows int, n long, kinds string, first int"
    one = lambda p: p.iloc[:1].assign(rows=len(p), n=p.n.max(), kinds=f"{p.k.dtype} {p.n.dtype} {p.b.dtype}", first=p.index[0])[["k", "rows", "n", "kinds", "first"]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        step = df.transform(scripts.table_step(one, schema, ["k"]))
        assert "FlatMapGroupsInPandas" not in step._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, step.collect()), key=repr)
        assert got == sorted(map(tuple, df.groupBy("k").applyInPandas(one, schema).collect()), key=repr)
        assert len(got) == 301 and sum(r[1] for r in got) == 3000 and {r[4] for r in got} == {0}
        many = lambda p: p.groupby("k", dropna=False, as_index=False).agg(rows=("n", "size"))
        sizes = df.transform(scripts.table_step(many, "k long, rows int", ["k"], together=True)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, sizes), key=repr) == sorted(((r[0], r[1]) for r in got), key=repr)
    assert df.limit(0).transform(scripts.table_step(one, schema, ["k"])).count() == 0
