"""Joins, aggregates and level-of-detail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators.quantiles import quantiles
from tallyloom.operators import joins, lod

from .registry import query, r

C = F.col


def one():
    """Row count."""
    return F.count(F.lit(1))


OC = [("o_custkey", "c_custkey")]


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


def _cust(t):
    return t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")


for _id, _kind, _sql in (
    ("jon_01_inner", "inner", f"SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("jon_02_left", "left", f"SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    ("jon_03_right", "right", f"SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey"),
    ("jon_04_full", "full", f"SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey"),
    ("jon_05_left_only", "leftOnly", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)"),
    ("jon_06_right_only", "rightOnly", f"SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)"),
    ("jon_07_not_inner", "notInner", f"SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NULL OR c_custkey IS NULL"),
):
    query(_id, _sql)(lambda t, k=_kind: joins.join(_orders(t), _cust(t), OC, k))
query("jon_08_cross", "SELECT n_name, r_name FROM nation, region")(lambda t: joins.cross(t.nation.select("n_name"), t.region.select("r_name")))
query("jon_09_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS again FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")(lambda t: joins.join(t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"), C("l_quantity").alias("again")), [("l_orderkey", "k"), ("l_linenumber", "n")], "inner"))
query("jon_10_computed_key", "SELECT o_orderkey, year(o_orderdate) AS y, n.n_name FROM orders JOIN nation n ON year(o_orderdate) % 25 = n_nationkey")(lambda t: joins.join(t.orders.select("o_orderkey", F.year("o_orderdate").alias("y")), t.nation, [(C("y") % 25, "n_nationkey")], "inner", ["n_name"]))
query("jon_11_expand", "SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment AS cust_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(lambda t: joins.join(_orders(t), _cust(t), OC, "left", ["c_mktsegment"], "cust_"))
query("jon_12_buffered", "SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: joins.join(t.orders.select("o_orderkey", "o_custkey"), joins.buffered(_cust(t)), OC, "inner").select("o_orderkey", "c_mktsegment", "c_nationkey"))
query("jon_13_blend", "SELECT c_custkey AS k, c_mktsegment, n FROM customer LEFT JOIN (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) o ON c_custkey = o.k")(lambda t: joins.blend(t.customer.select(C("c_custkey").alias("k"), "c_mktsegment"), t.orders.select(C("o_custkey").alias("k")), ["k"], {"n": one()}))
query("jon_14_related", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")(lambda t: joins.related(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.part, [("l_partkey", "p_partkey")], ["p_brand"]).drop("l_partkey"))
query("jon_15_lookup_value", "SELECT c_custkey, CASE WHEN lo = hi THEN lo END AS o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY 1) ON c_custkey = o_custkey")(lambda t: joins.lookup_value(t.customer.select("c_custkey"), t.orders, ("c_custkey", "o_custkey"), "o_orderstatus"))
query("jon_16_star", "SELECT c_mktsegment, p_brand, round(sum(l_extendedprice), 2) AS v FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL")(lambda t: joins.star_totals(t.lineitem, [(joins.snowflake(t.orders.select("o_orderkey", "o_custkey"), (t.customer, "o_custkey", "c_custkey", ["c_mktsegment"])), "l_orderkey", "o_orderkey", ["c_mktsegment"]), (t.part, "l_partkey", "p_partkey", ["p_brand"])], {"v": C("l_extendedprice")}).withColumn("v", F.round("v", 2)))
query("jon_16_star_rows", "SELECT l_orderkey, l_linenumber, o_orderpriority, p_brand FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")(lambda t: joins.star(t.lineitem, (t.orders, "l_orderkey", "o_orderkey"), (t.part, "l_partkey", "p_partkey")).select("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand"))
query("jon_17_cardinality", "SELECT a AS left_most, b AS right_most, CASE WHEN a > 1 THEN 'many' ELSE 'one' END || '-to-' || CASE WHEN b > 1 THEN 'many' ELSE 'one' END AS kind FROM (SELECT max(n) AS a FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)), (SELECT max(n) AS b FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey))")(lambda t: joins.cardinality(t.orders, t.customer, ("o_custkey", "c_custkey")))
query("jon_18_aligned", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: joins.join(t.orders.select("o_orderkey", "o_custkey"), joins.aligned(t.orders, t.customer.select(C("c_custkey").cast("string").alias("c_custkey"), "c_mktsegment"), ("o_custkey", "c_custkey")), OC, "inner").select("o_orderkey", "c_mktsegment"))


def G(key, measure, sql):
    """A measure of lineitem by return flag and line status."""
    query(key, f"SELECT l_returnflag, l_linestatus, {sql} AS v FROM lineitem GROUP BY 1, 2")(lambda t: A.group(t.lineitem, ["l_returnflag", "l_linestatus"], {"v": measure()}))


Q, E = "l_quantity", "l_extendedprice"
query("agg_01_group", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1")(lambda t: A.group(t.lineitem, ["l_returnflag"], {"n": one(), "qty": r(F.sum(Q), 2), "disc": r(F.avg("l_discount"), 6)}))
G("agg_02_sum", lambda: r(A.by_name("sum", E), 2), "round(sum(l_extendedprice), 2)")
G("agg_03_avg", lambda: r(A.by_name("avg", E), 4), "round(avg(l_extendedprice), 4)")
G("agg_04_min", lambda: A.by_name("min", E), "min(l_extendedprice)")
G("agg_05_max", lambda: A.by_name("max", E), "max(l_extendedprice)")
G("agg_06_count", lambda: A.by_name("cnt", F.nullif(C("l_linenumber"), F.lit(1))), "CAST(count(nullif(l_linenumber, 1)) AS BIGINT)")
G("agg_07_counta", lambda: F.count(F.nullif(C("l_linestatus"), F.lit("O"))), "CAST(count(nullif(l_linestatus, 'O')) AS BIGINT)")
G("agg_08_rows", lambda: A.by_name("rows", Q), "CAST(count(*) AS BIGINT)")
query("agg_09_records", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")(lambda t: t.lineitem.agg(one().alias("n")))
G("agg_10_countd", lambda: A.by_name("ctd", "l_partkey"), "CAST(count(DISTINCT l_partkey) AS BIGINT)")
query("agg_11_median", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2")(lambda t: quantiles(t.lineitem, E, {"v": 0.5}, ["l_returnflag", "l_linestatus"]).withColumn("v", F.round("v", 4)))
query("agg_12_percentile", "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS v FROM lineitem GROUP BY 1, 2")(lambda t: quantiles(t.lineitem, E, {"v": 0.9}, ["l_returnflag", "l_linestatus"]).withColumn("v", F.round("v", 4)))
query("agg_12_whole_table", "SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.999), 4) AS p999, quantile_cont(l_quantity, 0.5) AS quantity FROM lineitem")(lambda t: quantiles(t.lineitem, E, {"p05": 0.05, "p50": 0.5, "p999": 0.999}).select(*[F.round(c, 4).alias(c) for c in ("p05", "p50", "p999")]).crossJoin(quantiles(t.lineitem, Q, {"quantity": 0.5})))  # one row each
query("agg_12_many_groups", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1")(lambda t: quantiles(t.lineitem, E, {"q1": 0.25, "q3": 0.75}, ["l_suppkey"]).select("l_suppkey", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3")))
G("agg_13_stdev", lambda: r(A.by_name("stdev", Q)), "round(stddev_samp(l_quantity), 4)")
G("agg_14_stdevp", lambda: r(A.by_name("stdevp", Q)), "round(stddev_pop(l_quantity), 4)")
G("agg_15_var", lambda: r(A.by_name("var", Q)), "round(var_samp(l_quantity), 4)")
G("agg_16_varp", lambda: r(A.by_name("varp", Q)), "round(var_pop(l_quantity), 4)")
G("agg_17_corr", lambda: r(A.corr(Q, E)), "round(coalesce(corr(l_quantity, l_extendedprice), 0), 4)")
G("agg_18_covar", lambda: r(F.covar_samp(Q, E), 2), "round(covar_samp(l_quantity, l_extendedprice), 2)")
G("agg_19_covarp", lambda: r(F.covar_pop(Q, E), 2), "round(covar_pop(l_quantity, l_extendedprice), 2)")
query("agg_20_attr", "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status FROM orders GROUP BY 1")(lambda t: A.group(t.orders, ["o_custkey"], {"status": A.attr("o_orderstatus")}))
query("agg_21_collect", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS points, round(sum(o_totalprice), 2) AS lat_sum FROM orders GROUP BY 1")(lambda t: A.group(t.orders, ["o_custkey"], {"p": A.collect_points(C("o_totalprice"), C("o_orderkey"))}).select("o_custkey", F.size("p").cast("long").alias("points"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["lat"]), 2).alias("lat_sum")))
query("agg_21_collect_parts", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS points, round(sum(l_quantity), 2) AS lat_sum FROM lineitem GROUP BY 1")(lambda t: A.collect_parts(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice").groupBy("l_returnflag").agg(F.sum(F.size("points")).alias("points"), F.round(F.sum(F.aggregate("points", F.lit(0.0), lambda a, x: a + x["lat"])), 2).alias("lat_sum")))
G("agg_22_conditional", lambda: r(A.when_true(F.sum, C("l_discount") > 0.05, C(E)), 2), "round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2)")
G("agg_23_conditional_distinct", lambda: A.when_true(A.distinct_count, C("l_discount") > 0.05, C("l_suppkey")), "CAST(count(DISTINCT l_suppkey) FILTER (WHERE l_discount > 0.05) AS BIGINT)")
G("agg_24_row_expression", lambda: r(F.sum(C(E) * (1 - C("l_discount")) * (1 + C("l_tax"))), 2), "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2)")
query("agg_25_cross_table", "SELECT p_brand, round(sum(l_quantity * p_retailprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")(lambda t: A.group(joins.related(t.lineitem, t.part, [("l_partkey", "p_partkey")], ["p_brand", "p_retailprice"]).filter("p_brand is not null"), ["p_brand"], {"v": r(F.sum(C(Q) * C("p_retailprice")), 2)}))
G("agg_26_ratio", lambda: r(A.ratio(F.sum(E), F.sum(F.when(C("l_returnflag") == "R", C(Q)).otherwise(0.0)), -1.0)), "round(coalesce(sum(l_extendedprice) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 0), -1), 4)")
query("agg_27_row_minmax", "SELECT l_orderkey, l_linenumber, least(l_tax, l_discount) AS lo, greatest(l_tax, l_discount) AS hi FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.least("l_tax", "l_discount").alias("lo"), F.greatest("l_tax", "l_discount").alias("hi")))
query("agg_28_distinct", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")(lambda t: A.distinct_rows(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], [C("o_orderkey")]))
query("agg_29_group_all", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")(lambda t: A.group_all(t.lineitem.select("l_returnflag", "l_linestatus")))
query("agg_30_totals", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping(l_returnflag) AS INT) AS is_total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())")(lambda t: A.totals(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": one()}))
query("agg_31_subtotals", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")(lambda t: A.subtotals(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": one()}))
query("agg_32_drill", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, CAST(2 - grouping(r_name) - grouping(n_name) AS INT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")(lambda t: A.drill(joins.join(t.customer, joins.snowflake(t.nation, (t.region, "n_regionkey", "r_regionkey", ["r_name"])), [("c_nationkey", "n_nationkey")], "inner", ["r_name", "n_name"]), ["r_name", "n_name"], {"n": one()}))
query("agg_33_date_drill", "SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, day(o_orderdate) AS day, CAST(count(*) AS BIGINT) AS n, CAST(4 - grouping(year(o_orderdate)) - grouping(quarter(o_orderdate)) - grouping(month(o_orderdate)) - grouping(day(o_orderdate)) AS INT) AS level FROM orders GROUP BY ROLLUP (year(o_orderdate), quarter(o_orderdate), month(o_orderdate), day(o_orderdate))")(lambda t: A.date_drill(t.orders, "o_orderdate", {"n": one()}))
query("agg_34_measure_switch", "SELECT l_returnflag, 'n' AS measure, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'q', round(sum(l_quantity), 2) FROM lineitem GROUP BY 1")(lambda t: A.measure_switch(t.lineitem, ["l_returnflag"], {"n": one(), "q": r(F.sum(Q), 2), "unused": F.max(E)}, ["n", "q"]))
query("agg_35_dimension_switch", "SELECT 'l_returnflag' AS dimension, l_returnflag AS member, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")(lambda t: A.dimension_switch(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": one()}))
query("agg_36_what_if", "SELECT d AS discount, round(s * (1 - d), 2) AS revenue FROM (SELECT sum(l_extendedprice) AS s FROM lineitem), (SELECT unnest([0.0, 0.1, 0.25])::DOUBLE AS d)")(lambda t: A.what_if(t.lineitem, "discount", [0.0, 0.1, 0.25], {"s": F.sum(E)}).select("discount", r(C("s") * (1 - C("discount")), 2).alias("revenue")))
query("agg_37_preaggregated", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(sum(l_quantity), 2) AS total, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")(lambda t: A.Cube.build(t.lineitem.withColumn("d", F.to_date("l_shipdate")), ["l_returnflag", "l_linestatus", "d"], [Q]).ask(["l_returnflag"]).select("l_returnflag", "rows", r(C("l_quantity_sum"), 2).alias("total"), C("l_quantity_max").alias("high"), r(C("l_quantity_avg"), 6).alias("mean")))


def _sketched(t):
    """Each estimate beside the exact count, and whether it is within four standard errors."""
    cube = A.Cube.build(t.lineitem.withColumn("y", F.year("l_shipdate")), ["l_returnflag", "l_linestatus", "y"], [], ["l_partkey"])
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))
    return cube.ask(["l_returnflag"]).join(exact, "l_returnflag").select("l_returnflag", "n", (F.abs(C("l_partkey_distinct") - C("n")) <= 4 * 0.01625 * C("n")).alias("close"))


query("agg_10_sketched", "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n, true AS close FROM lineitem GROUP BY 1")(_sketched)


def _shared(t):
    cube = A.Cube.build(t.lineitem, ["l_linestatus", "l_returnflag"], [], ["l_partkey"])
    found = cube.shared(["l_linestatus"], "l_partkey", C("l_returnflag") == "R", C("l_returnflag") == "A")
    flags = t.lineitem.groupBy("l_linestatus", "l_partkey").agg(F.bool_or(C("l_returnflag") == "R").alias("r"), F.bool_or(C("l_returnflag") == "A").alias("a"))
    exact = flags.groupBy("l_linestatus").agg(F.count_if(C("r") & C("a")).alias("n_both"), F.count_if(C("r") | C("a")).alias("n_either"), F.count_if(C("r") & ~C("a")).alias("n_only"))
    # A part's error is that of the whole: 1 / sqrt(4096) of either, four times.
    near = lambda e, n: F.abs(C(e) - C(n)) <= 4 * C("n_either") / 64
    return found.join(exact, "l_linestatus").select("l_linestatus", "n_both", "n_either", "n_only", (near("both", "n_both") & near("either", "n_either") & near("only_one", "n_only")).alias("close"))


query("agg_37_shared_values", "SELECT l_linestatus, CAST(count(*) FILTER (WHERE r AND a) AS BIGINT) AS n_both, CAST(count(*) FILTER (WHERE r OR a) AS BIGINT) AS n_either, CAST(count(*) FILTER (WHERE r AND NOT a) AS BIGINT) AS n_only, true AS close FROM (SELECT l_linestatus, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY 1, 2) GROUP BY 1")(_shared)
query("agg_38_by_name", "SELECT l_linestatus, round(stddev_samp(l_tax), 6) AS stdev, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS ctd, round(median(l_tax), 6) AS median FROM lineitem GROUP BY 1")(lambda t: A.group(t.lineitem, ["l_linestatus"], {"stdev": r(A.by_name("stdev", "l_tax"), 6), "ctd": A.by_name("ctd", "l_suppkey"), "median": r(A.by_name("median", "l_tax"), 6)}))
query("agg_39_measure_names", "SELECT 'qty' AS measure, round(sum(l_quantity), 2) AS value FROM lineitem UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM lineitem")(lambda t: A.measure_switch(t.lineitem, [], {"qty": r(F.sum(Q), 2), "rows": one()}))
query("agg_40_validation", "SELECT l_shipmode AS flag, n, q FROM (SELECT l_returnflag AS l_shipmode, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1)")(lambda t: A.validation_grid(t.lineitem.withColumn("flag", C("l_returnflag")), "flag", {"n": one(), "q": r(F.sum(Q), 2)}))

query("lod_01_fixed", "SELECT o_orderkey, CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE) AS first_order, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders")(lambda t: lod.fixed(t.orders, ["o_custkey"], {"first_order": F.to_date(F.min("o_orderdate")), "n": one()}).select("o_orderkey", "first_order", "n"))
query("lod_02_fixed_all", "SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS share FROM orders")(lambda t: lod.fixed(t.orders, [], {"m": F.max("o_totalprice")}).select("o_orderkey", (C("o_totalprice") / C("m")).alias("share")))
query("lod_03_fixed_tables", "SELECT o_orderkey, s AS segment_buyers FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT c_mktsegment AS g, CAST(count(DISTINCT o_custkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON g = c_mktsegment")(lambda t: lod.fixed(joins.join(_orders(t), _cust(t), OC, "inner"), ["c_mktsegment"], {"segment_buyers": F.count_distinct(C("o_custkey"))}).select("o_orderkey", "segment_buyers"))
query("lod_04_include", "SELECT c_mktsegment, round(avg(s), 2) AS v FROM (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")(lambda t: lod.include(joins.join(_orders(t), _cust(t), OC, "inner"), ["c_mktsegment"], ["o_custkey"], {"s": F.sum("o_totalprice")}, {"v": r(F.avg("s"), 2)}))
query("lod_05_exclude", "SELECT l_returnflag, l_linestatus, n, CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS flag_n FROM (SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)")(lambda t: lod.exclude(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_linestatus"], {"n": one()}, {"flag_n": one()}))


def _nested(t):
    best = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("b"))
    return t.orders.select("o_orderkey").crossJoin(best.agg(r(F.avg("b"), 2).alias("mean_best")))  # one row


query("lod_06_nested", "SELECT o_orderkey, round(m, 2) AS mean_best FROM orders, (SELECT avg(b) AS m FROM (SELECT max(o_totalprice) AS b FROM orders GROUP BY o_custkey))")(lambda t: _nested(t))
query("lod_07_outer", "SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS v FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")(lambda t: lod.over(t.orders, ["o_orderstatus"], ["o_custkey"], {"n": one()}, {"v": F.sum("n")}))
