import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, logic, numbers, text
from tallyloom.operators import aggregates, analytics, clean, columns, filters, incremental, joins, kpi, lineage, lod, quality, reshape, security, sorting, tablecalc
from tallyloom.queries import QUERIES
from tallyloom.sources import readers, writers
from tallyloom.streaming import jobs

C = F.col


def values(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def one(spark, **cols):
    row = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()
    return tuple(row) if len(cols) > 1 else row[0]


def test_text_edges(spark):
    lit = F.lit
    assert one(spark, a=text.find_nth(lit("a.b.c"), ".", 2), b=text.find_nth(lit("abc"), ".", 1), c=text.find_nth(lit(None).cast("string"), ".", 1)) == (4, 0, None)
    assert one(spark, a=text.split(lit("a-b-c"), "-", -1), b=text.split(lit("a"), "-", 3), c=text.regexp_extract(lit("abc"), "(x)")) == ("c", "", None)
    assert one(spark, a=text.mid(lit("hello"), 2), b=text.contains(lit("Hello"), "hEL", True), c=text.space(3)) == ("ello", True, "   ")


def test_number_edges(spark):
    lit = F.lit
    got = one(spark, a=numbers.square_root(lit(-1.0)), b=numbers.log(lit(0.0)), c=numbers.div(lit(-7), lit(2)), d=numbers.mod(lit(-7), lit(3)), e=numbers.div(lit(1), lit(0)), f=numbers.rounded(lit(-2.5)))
    assert got == (None, None, -3, 2, None, -3.0)
    p = lambda a, b: numbers.make_point(lit(a), lit(b))
    assert one(spark, a=numbers.distance_km(p(48.8566, 2.3522), p(51.5074, -0.1278))) == pytest.approx(343.5, abs=1)
    x, y = one(spark, x=numbers.hexbin_x(lit(0.6), lit(0.8)), y=numbers.hexbin_y(lit(0.6), lit(0.8)))
    assert (x, round(y, 6)) == (0.5, round(math.sqrt(3) / 2, 6))


def test_date_edges(spark):
    d = lambda s: F.lit(datetime.date.fromisoformat(s))
    assert [one(spark, a=dates.part("week", d(s))) for s in ("2024-01-01", "2024-01-07", "2024-12-31")] == [1, 2, 53]
    assert one(spark, a=dates.diff("month", d("2024-01-31"), d("2024-02-01")), b=dates.diff("week", d("2024-01-06"), d("2024-01-07")), c=dates.diff("year", d("2023-12-31"), d("2024-01-01"))) == (1, 1, 1)
    assert one(spark, a=dates.add("month", 1, d("2024-01-31")), b=dates.trunc("week", d("2024-01-10"))) == (datetime.date(2024, 2, 29), datetime.date(2024, 1, 7))
    assert one(spark, a=dates.diff("hour", F.lit("2024-01-01 00:59:59").cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp"))) == 1


def test_logic_edges(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, a=logic.iif(null, 1, 2, 3), b=logic.if_else((null, 1)), c=logic.zn(F.lit(None).cast("int")), d=logic.to_int(F.lit("-3.9")), e=logic.is_number(F.lit("x"))) == (3, None, 0, -3, False)


def test_index_numbers_all_rows_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = df.transform(columns.index("i", ["k"])).collect()
    assert all(r.i == r.k + 1 for r in got) and len(got) == 5000
    assert df.limit(0).transform(columns.index("i", ["k"])).count() == 0


def test_columns_and_cleaning(spark):
    df = spark.createDataFrame([("a,b,c", "x\x01", 1200.0), (None, "Y1!", None)], "s string, t string, v double")
    assert df.transform(columns.split_by("s", ",")).columns == ["s", "t", "v", "s_1", "s_2", "s_3"]
    assert values(df.select(columns.formatted(C("v"), "$#,##0.00").alias("f"), columns.magnitude(C("v")).alias("m"))) == [("$1,200.00", "1.2K"), (None, None)] or values(df.select(columns.magnitude(C("v")).alias("m")))[0] == ("1.2K",)
    assert values(df.transform(clean.clean("t")).transform(clean.remove_kind("punctuation", "t")), "t") == [("Y1",), ("x",)]
    assert values(df.transform(columns.set_column("in", "s", ["a,b,c"])), "in") == [("IN",), ("OUT",)]
    assert one(spark, a=clean.text_after(F.lit("a::b"), "::"), b=clean.text_after(F.lit("ab"), "::"), c=clean.pad_start(F.lit("abc"), 2)) == ("b", "", "abc")
    big = {str(i): f"n{i}" for i in range(150)}
    assert values(spark.createDataFrame([("7",), ("x",)], "k string").transform(columns.aliases("k", big))) == [("n7",), ("x",)]


def test_not_inner_and_lookups(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, u string"), spark.createDataFrame([(2, "p"), (3, "q"), (2, "r")], "j int, w string")
    assert values(joins.join(a, b, [("k", "j")], "notInner"), "k", "u", "w", "j") == [(1, "x", None, None), (None, "z", None, None), (None, None, "q", 3)]
    assert values(joins.lookup_value(a, b, ("k", "j"), "w"), "k", "w") == [(1, None), (2, None), (None, None)]
    assert joins.cardinality(a, b, ("k", "j")).first().kind == "one-to-many"


def test_aggregate_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), (None, 3.0)], "g string, v double")
    with pytest.raises(KeyError):
        aggregates.by_name("mean of means", "v")
    assert aggregates.distinct_rows(df).count() == 3 and aggregates.group(df, ["g"], {"c": aggregates.corr("v", "v")}).filter("c <> 0").count() == 0
    total = [r for r in aggregates.totals(df, ["g"], {"s": F.sum("v")}).collect() if r.is_total]
    assert [(r.g, r.s) for r in total] == [(None, 7.0)]
    with pytest.raises(ValueError):
        aggregates.Cube.build(df, ["g"], ["v"]).ask(["h"])
    assert values(aggregates.parameter_range(spark, "p", 0, 1, 0.25)) == [(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)]


def test_fixed_keeps_null_dimensions(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v int")
    assert values(lod.fixed(df, ["g"], {"s": F.sum("v")}), "g", "s") == [("a", 1), (None, 5), (None, 5)]


def test_ranks(spark):
    df = spark.createDataFrame([(9, 1), (7, 2), (7, 3), (5, 4)], "v int, i int")
    s = tablecalc.spec(order_by=["i"])
    got = df.select("i", *[tablecalc.rank(s, "v", k).alias(k) for k in ("competition", "dense", "unique", "modified")]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, 1, 1), (2, 2, 2, 3), (2, 2, 3, 3), (4, 3, 4, 4)]


def test_unions_and_shapes(spark):
    flags, nums, days = spark.createDataFrame([(True,)], "v boolean"), spark.createDataFrame([(2.5,)], "v double"), spark.createDataFrame([(datetime.date(2024, 1, 1),)], "v date")
    assert values(reshape.union_widened(flags, nums)) == [(1.0,), (2.5,)]
    with pytest.raises(TypeError):
        reshape.union_widened(days, nums)
    with pytest.warns(UserWarning):
        reshape.union_widened(spark.createDataFrame([("x",)], "v string"), nums)
    with pytest.raises(ValueError):
        spark.range(20).transform(reshape.transpose("id", rows=10))
    wide = spark.createDataFrame([(1, None, 2)], "k int, a int, b int")
    assert wide.transform(reshape.unpivot(["k"], ["a", "b"])).count() == 1 and wide.transform(reshape.unpivot(["k"], ["a", "b"], keep_nulls=True)).count() == 2


def test_relative_dates_and_context(spark):
    df = spark.range(60).select(F.date_add(F.lit(datetime.date(2024, 1, 1)), C("id").cast("int")).alias("d"))
    assert df.transform(filters.relative_dates("d", "week", datetime.date(2024, 1, 17), last=1)).count() == 14
    assert df.transform(filters.relative_dates("d", "month", datetime.date(2024, 1, 17), following=1, include_anchor=False)).count() == 29


def test_analytics_without_sql(spark, data):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 200)
    df = spark.createDataFrame([(float(a), float(1 + 2 * a - 0.5 * a * a)) for a in x], "x double, y double")
    assert [round(v, 6) for v in analytics.parabola(df, "x", "y").first()] == [1.0, 2.0, -0.5]
    series = spark.createDataFrame([("s", i, float(10 + i + 5 * math.sin(i * math.pi / 6))) for i in range(72)], "g string, t long, y double")
    got = [r.forecast for r in analytics.holt_winters(series, "t", "y", 12, "g").orderBy("t").collect()]
    assert np.abs(np.array(got) - [10 + i + 5 * math.sin(i * math.pi / 6) for i in range(72, 84)]).max() < 1.5
    for kind in ("additive", "multiplicative"):
        rows = analytics.holt_winters(series, "t", "y", 6, "g", ignore_last=6, kind=kind).orderBy("t").collect()
        assert [r.t for r in rows] == list(range(66, 78)) and all(r.low < r.forecast < r.high for r in rows)
        assert rows[-1].high - rows[-1].low > rows[0].high - rows[0].low
    blobs = spark.createDataFrame([(float(c * 20 + rng.normal()), float(c * 20 + rng.normal())) for c in range(3) for _ in range(40)], "a double, b double")
    assert analytics.clusters(blobs, ["a", "b"]).select("cluster").distinct().count() == 3
    rows = QUERIES["srt_09_sample"](spark, data).count()
    assert 300 < rows < 900 and rows == QUERIES["srt_09_sample"](spark, data).count()


def test_security(spark):
    df = spark.createDataFrame([("ann", 1), ("bob", 2)], "owner string, v int")
    empty = spark.createDataFrame([], "user string, value string")
    assert security.allowed_values(df, empty, "ann", "owner").count() == 0 and security.own_rows(df, "owner", "bob").count() == 1
    assert df.filter(security.combine({})).count() == 0 and df.filter(security.combine({"a": "v > 0", "b": "v > 1"}, "and")).count() == 1


def test_quality_edges(spark):
    a = spark.createDataFrame([(1, "5"), (2, "x"), (3, "0")], "k int, v string")
    b = spark.createDataFrame([(1, "5.04"), (2, "x"), (4, "1"), (3, "1")], "k int, v string")
    got = dict((r.k, r.status) for r in quality.equivalence(a, b, ["k"], "v").collect())
    assert got == {1: "passed", 2: "passed", 3: "failed", 4: "missing"}
    names = spark.createDataFrame([("Sales Region",), ("Profit",)], "n string"), spark.createDataFrame([("sales_region",), ("region",), ("prophet",)], "m string")
    assert values(quality.fuzzy_match(names[0], "n", names[1], "m", 0.5)) == [("Sales Region", "region", pytest.approx(6 / 11)), ("Sales Region", "sales_region", 1.0)]
    assert quality.jaccard_columns(a, b) == 1.0


def test_matches_equal_brute_force(spark):
    rng = __import__("random").Random(4)
    names = ["".join(rng.choice("aabbccd1 ") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    left, right = names[:60], names[60:] + names[:10]
    frames = spark.createDataFrame([(n,) for n in left], "n string"), spark.createDataFrame([(n,) for n in right], "m string")

    def score(a, b, tokens, inside, blank=""):
        # Table names lose their blanks, other names have underscores instead.
        a, b = a.replace(" ", blank), b.replace(" ", blank)
        x, y = tokens(a), tokens(b)
        if not x & y:
            return 0.0
        return 1.0 if a == b else inside(a, b) if a in b or b in a else len(x & y) / len(x | y)

    pairs = lambda s: {i + "," for i in s} if len(s) < 2 else {s[i : i + 2] for i in range(len(s) - 1)}
    ratio = lambda a, b: min(len(a), len(b)) / max(len(a), len(b))
    want = {(a, b, round(score(a, b, pairs, ratio), 6)) for a in left for b in right if score(a, b, pairs, ratio) >= 0.5}
    assert {(r.left, r.right, round(r.score, 6)) for r in quality.fuzzy_match(frames[0], "n", frames[1], "m", 0.5).collect()} == want
    best = {a: min((-score(a, b, set, lambda *_: 0.8, "_"), b) for b in right) for a in left}
    got = {r.left: (round(r.score, 6), r.right) for r in quality.best_match(frames[0], "n", frames[1], "m", 0.7).collect()}
    assert got == {a: (round(-s, 6), b) for a, (s, b) in best.items() if s <= -0.7}


def test_chains_double_and_leave_rings_out(spark):
    edges = [(i, i + 1) for i in range(100, 137)] + [(1, 2), (2, 3), (3, 1), (50, 51), (50, 52), (52, 53)]
    got = {(r.head, r.node, r.place) for r in lineage.chains(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {(100, 100 + i, i) for i in range(38)} | {(52, 52, 0), (52, 53, 1)}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    with pytest.raises(ValueError):
        lineage.layers(edges)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a int, b int")
    assert {r.cluster for r in lineage.clusters(pairs, spark.range(1, 41).select(C("id").cast("int").alias("n"))).collect()} == {1}


def test_scorecard_and_sla(spark):
    df = spark.createDataFrame([(1, 50.0, 0.9, True), (2, 500.0, 0.2, None)], "i int, t double, s double, ok boolean")
    got = {r.i: (r.breaches, r.compliant) for r in kpi.sla(df, ("t", 100), ("s", 0.5), "ok").collect()}
    assert got == {1: ([], True), 2: (["time", "score", "validation"], False)}


def test_merge_counts_conflicts(spark):
    a = spark.createDataFrame([(1, "mine", 1), (2, None, 2)], "k int, note string, v int")
    b = spark.createDataFrame([(1, "theirs", 9), (2, "theirs", 8), (3, "theirs", 7)], "k int, note string, v int")
    assert values(incremental.merge(a, b, "k", ["note"])) == [(1, "mine", 9, 1), (2, "theirs", 8, 0), (3, "theirs", 7, 0)]


def test_option_builders():
    assert readers.jdbc_options("postgresql", "h", "d", "t", port=5432, split=("id", 0, 100, 8)) == {"url": "jdbc:postgresql://h:5432/d", "dbtable": "t", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    assert readers.jdbc_options("oracle", "h", "d", query="select 1", port=1521)["query"] == "select 1"
    assert readers.connector_options("bigquery", "p.d.t", parentProject="p") == ("bigquery", {"table": "p.d.t", "parentProject": "p"})
    assert set(readers.JDBC) >= {"sqlserver", "postgresql", "mysql", "oracle", "azuresql", "synapse", "redshift", "teradata", "saphana", "vertica", "impala", "presto", "trino", "athena", "db2", "derby"}
    assert "`a` BIGINT NOT NULL" in writers.ddl("t", {"a": "integer"}, {"a"})


def test_jdbc_scan_is_split_and_filtered_by_the_database(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, id * 1.5D, null) as v", "concat('n', id) as name")
    where = {"kind": "derby", "host": "", "database": "memory:library;create=true", "table": "scanned"}
    writers.save_jdbc(rows, types="name VARCHAR(20)", **where)
    read = readers.jdbc(spark, split=("id", 0, 100, 4), **where).filter("v > 30")
    assert read.rdd.getNumPartitions() == 4
    assert "PushedFilters: [*IsNotNull(v), *GreaterThan(v,30.0)]" in read._jdf.queryExecution().toString()
    assert sorted(r.name for r in read.collect()) == sorted(f"n{i}" for i in range(22, 100, 2))
    more = {**where, "table": None, "query": "SELECT COUNT(*) AS N FROM scanned"}
    assert readers.jdbc(spark, **more).first()[0] == 100
    writers.save_jdbc(rows.limit(0), types="name VARCHAR(20)", **where)
    assert readers.jdbc(spark, **where).count() == 0


def test_permissive_and_guarded(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n")
    rows = readers.permissive(spark, str(tmp_path / "x.csv"), {"a": "integer", "b": "integer"}).cache()
    assert [(r.a, r._corrupt_record) for r in rows.collect()] == [(1, None), (None, "x,3")]
    assert readers.guarded(spark, lambda: readers.extract(spark, str(tmp_path / "none")), {"a": "integer"}).count() == 0


def test_throttle(spark):
    at = [(1, "r", "2024-01-01 00:10:00"), (2, "r", "2024-01-01 00:50:00"), (3, "r", "2024-01-01 01:10:00"), (4, "r", "2024-01-02 01:10:00")]
    raised = spark.createDataFrame(at, "i int, rule string, ts string").withColumn("ts", C("ts").cast("timestamp"))
    assert [jobs.throttled(raised, how).count() for how in ("once", "hourly", "daily")] == [1, 3, 2]


def test_sorting(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(10)], "g int, v int")
    assert values(df.transform(sorting.top_per_group(1, ["g"], "-v")), "g", "v") == [(0, 9), (1, 7), (2, 8)]
    assert df.transform(sorting.skip(4, "v")).agg(F.min("v")).first()[0] == 4 and df.transform(sorting.remove_last(3, "v")).agg(F.max("v")).first()[0] == 6
