"""Streams with state, empty streams, names, null keys, deep graphs, retention and other cases that the queries do not show."""

import datetime
import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyloom import shared
from tallyloom.operators import aggregates, incremental, joins, kpi, lineage, quality, security
from tallyloom.streaming import jobs

AT = datetime.datetime(2024, 1, 1)


def hours(n):
    return AT + datetime.timedelta(hours=n)


def test_silence_across_batches_drops_its_state(spark, tmp_path):
    base = str(tmp_path)
    put = lambda rows: spark.createDataFrame(rows, "rule string, ts timestamp").coalesce(1).write.mode("append").parquet(base + "/in")
    run = lambda: jobs.run_once(jobs.silenced(spark.readStream.schema("rule string, ts timestamp").parquet(base + "/in"), "2 HOURS"), base + "/out", base + "/state", rocksdb=True)
    kept = lambda: {r.key.rule for r in spark.read.format("statestore").option("stateVarName", "until").load(base + "/state").collect()}
    before = spark.conf.get(jobs.ROCKSDB[0])
    put([("a", hours(0)), ("a", hours(1)), ("a", hours(2)), ("a", hours(3)), (None, hours(1)), ("c", None)])
    assert sorted((r.rule, r.ts) for r in run().collect()) == [("a", hours(0)), ("a", hours(2))]
    put([("a", hours(3.5)), ("b", hours(20))])
    run()
    put([("b", hours(21))])
    assert sorted((r.rule, r.ts) for r in run().collect()) == [("a", hours(0)), ("a", hours(2)), ("b", hours(20))]
    assert kept() == {"b"} and spark.conf.get(jobs.ROCKSDB[0]) == before


def test_empty_streams_give_empty_tables(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    assert jobs.run_once(stream, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
    out = jobs.run_updates(jobs.metric(stream, "ts", "1 hour", ["k"], "v"), str(tmp_path / "c"), str(tmp_path / "d"), ["window_start", "k"])
    assert out.count() == 0 and out.columns == ["window_start", "k", "n", "total", "low", "high"]


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_names_of_all_scripts(spark):
    a, b = names(spark, ["北京", "Москва", "[dbo].[Sales Orders]", "", None, "--"]), names(spark, ["東京", "Київ", "москва", "sales_orders", "- -"])
    assert {tuple(r) for r in quality.fuzzy_match(a, "name", b, "name").collect()} == {("Москва", "москва", 1.0), ("[dbo].[Sales Orders]", "sales_orders", 1.0)}
    best = {r.left: (r.right, r.score) for r in quality.best_match(a, "name", a, "name").collect()}
    assert best == {n: (n, 1.0) for n in ("北京", "Москва", "[dbo].[Sales Orders]", "--")}


def test_fuzzy_and_best_match_equal_all_pairs(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice("abcДé _-.") for _ in range(rng.randrange(1, 9))) for _ in range(90)]
    left, right = some[:45], some[40:]
    table = lambda s: s.strip(" ").strip("[]").rsplit(".", 1)[-1].strip("[]").lower().translate(str.maketrans("", "", "_- "))
    plain = lambda s: s.lower().replace(" ", "_").replace("-", "_").strip(" ")
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    fuzzy, best = set(), {}
    for x in set(left):
        for y in set(right):
            a, b = table(x), table(y)
            if a and b and grams(a) & grams(b):
                score = 1.0 if a == b else min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                if score >= 0.5:
                    fuzzy.add((x, y, round(score, 9)))
            a, b = plain(x), plain(y)
            score = 1.0 if a == b else 0.8 if a in b or b in a else len(set(a) & set(b)) / len(set(a) | set(b))
            if a and b and score >= 0.7:
                best[x] = min(best.get(x, (0, "")), (-score, y))
    assert {(r.left, r.right, round(r.score, 9)) for r in quality.fuzzy_match(names(spark, left), "name", names(spark, right), "name").collect()} == fuzzy
    assert {r.left: (-r.score, r.right) for r in quality.best_match(names(spark, left), "name", names(spark, right), "name").collect()} == best


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 100.0), (1, 5.0), (2, 1.0)], "k int, v double")
    b = spark.createDataFrame([(None, 100.5), (1, 6.0), (3, 1.0)], "k int, v double")
    assert {(r.k, r.status) for r in quality.equivalence(a, b, ["k"], "v").collect()} == {(None, "passed"), (1, "failed"), (2, "missing"), (3, "missing")}
    assert {(r.k, r.status) for r in quality.row_diff(a, b, ["k"]).collect()} == {(None, "modified"), (1, "modified"), (2, "removed"), (3, "added")}
    seen = Observation("nulls")
    merged = {r.k: (r.v, r.conflicts) for r in incremental.merge(a, b, "k", ["v"], seen).collect()}
    assert merged == {None: (100.0, 1), 1: (5.0, 1), 2: (1.0, 0), 3: (1.0, 0)} and seen.get == {"rows": 4, "added": 1, "kept": 1, "conflicts": 2}
    assert {(r.k, r.x) for r in kpi.across(a, b, ["k"], F.sum("v"), F.sum("v"), "x").filter("k is null").collect()} == {(None, 100 / 100.5)}


def test_layers_of_deep_graphs(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(3000)]
    shape = [(10_000 + a, 10_000 + b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a < b]
    edges = chain + shape + [(3000, 20_000), (1500, 20_001), (20_001, 20_002), (20_002, 20_000), (20_000, 20_003), (None, 5)]
    after, layer = {}, {}
    for a, b in edges:
        if a is not None:
            after.setdefault(b, []).append(a)
            after.setdefault(a, [])
    for node in sorted(after):  # sources are smaller than their targets, but for the three named last
        layer[node] = max((layer[x] + 1 for x in after[node] if x in layer), default=0)
    layer[20_002] = layer[20_001] + 1
    layer[20_000] = max(layer[3000], layer[20_002]) + 1
    layer[20_003] = layer[20_000] + 1
    got = {r.node: r.layer for r in lineage.layers(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == layer and max(layer.values()) > 3000
    for ring in ([(1, 2), (2, 3), (3, 1)], [(0, 1), (1, 2), (2, 1)], [(5, 5)]):
        with pytest.raises(ValueError, match="cycle"):
            lineage.layers(spark.createDataFrame(ring, "src long, dst long"))
    assert lineage.layers(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_edges_are_planned_a_way_at_a_time_without_broadcasts(spark, monkeypatch):
    plans, settled = [], lineage.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(lineage, "settled", seen)
    outputs = [("a", "Orders", "f1"), ("a", "Sales Region", None), ("a", "people", None), ("a", "sales_orders", None), ("a", None, None), ("a", "own", None)]
    inputs = [("b", "renamed", "f1"), ("c", "Orders", "f9"), ("b", "Sales Region", None), ("c", "PEOPLE", None), ("b", "dbo.Sales-Orders", None), ("b", None, None), ("a", "own", None)]
    edges = lineage.match_edges(*[spark.createDataFrame(rows, "flow string, name string, fingerprint string") for rows in (outputs, inputs)])
    want = {("a", "Orders", "b", "fingerprint"), ("a", "Sales Region", "b", "exact"), ("a", "people", "c", "name"), ("a", "sales_orders", "b", "fuzzy"), ("a", "sales_orders", "c", "fuzzy")}
    assert {tuple(r) for r in edges.collect()} == want and edges.count() == 5
    plans.append(edges._jdf.queryExecution().executedPlan().toString())
    assert "Join" not in plans[-1]
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans[:-3])  # fuzzy_match() leaves its joins to Spark


def test_expired_periods_are_deleted(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(datetime.date(2024, m, 5), m) for m in range(1, 7)] + [(None, 0)], "d date, v int")
    incremental.first_load(rows, path, "d")
    for _ in range(2):
        out = incremental.refresh(rows, path, "d", datetime.date(2024, 6, 20), "month", 1, 3, drop=True)
        assert sorted(r.v for r in out.collect()) == [4, 5, 6]
        assert sorted(n[7:14] for n in os.listdir(path) if n.startswith("period=2")) == ["2024-04", "2024-05", "2024-06"]
    assert spark.read.parquet(path).filter("period is null").count() == 1


def test_roles_of_several_sources():
    roles = [("a", "r", "t", "x = 1"), ("b", "r", "t", "x  =  1"), ("b", "r", "u", "y = 1"), ("a", "s", "t", "x = 1"), ("b", "s", "t", "x = 2")]
    assert security.consolidate(roles) == {"r": {"t": "(x = 1)", "u": "(y = 1)"}, "s": {"t": "(x = 1) or (x = 2)"}}
    assert security.consolidate(roles, "and")["s"] == {"t": "(x = 1) and (x = 2)"}
    assert security.consolidate(roles, "namespace") == {"r": {"t": "(x = 1)", "u": "(y = 1)"}, "a.s": {"t": "(x = 1)"}, "b.s": {"t": "(x = 2)"}}
    with pytest.raises(ValueError):
        security.consolidate(roles, "xor")


def test_overlaps_read_each_table_twice(spark):
    tables = {"a": spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("few")), "b": spark.range(300, 1100).select(F.col("id").alias("y"), F.lit(None).cast("int").alias("none"))}
    (row,) = quality.overlapping_columns(tables, 0.3).collect()
    assert tuple(row)[:7] == ("b", "y", "a", "x", 800, 1000, 700) and row.jaccard == 700 / 1100
    assert quality.overlapping_columns(tables, 0.9).count() == 0


def test_sketches_of_cells_add_up(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("k"), (F.col("id") % 3).alias("side"), (F.col("id") % 20_000).alias("v"))
    cube = aggregates.Cube.build(df, ["k", "side"], ["v"], ["v"])
    assert cube.ask([]).first().v_distinct == pytest.approx(20_000, rel=0.065)
    whole = cube.shared([], "v", F.col("side") == 0, F.col("side") == 1).first()
    assert whole.either == pytest.approx(20_000, rel=0.065) and abs(whole.both - 20_000) < 1300 and abs(whole.only_one) < 1300
    with pytest.raises(ValueError):
        cube.ask(["other"])


def test_star_totals_and_wide_buffers(spark):
    fact = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 9, 4.0), (None, 1, 5.0)], "a int, b int, v double")
    one, two = spark.createDataFrame([(1, "x"), (2, "y")], "k int, n string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, m string")
    got = {(r.n, r.m): r.s for r in joins.star_totals(fact, [(one, "a", "k", ["n"]), (two, "b", "k", ["m"])], {"s": F.col("v")}).collect()}
    assert got == {("x", "p"): 2.0, ("x", "q"): 3.0, ("y", None): 4.0, (None, "p"): 5.0}
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), F.lit(10_000)).alias("t"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(joins.buffered(wide)) and not hinted(joins.buffered(wide, 100_000))


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session)
    assert shared.shared_dir(spark)
