"""Calendars, time intelligence, KPIs, analytics and row security."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import analytics, joins, kpi, security
from tallyloom.operators import timeintel as ti

from .registry import query, r

C = F.col


def one():
    """Row count."""
    return F.count(F.lit(1))


SALES = "(SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS v, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2)"
DENSE = f"(SELECT c.p, c.period, s.v, s.n FROM (SELECT p, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM {SALES} GROUP BY p) c LEFT JOIN {SALES} s ON c.p = s.p AND c.period = s.period)"


def grid(t, measure=None, name="n"):
    return ti.dense(t.orders.withColumn("p", C("o_orderpriority")), "o_orderdate", ["p"], one() if measure is None else measure, "month", name)


query("cal_01_calendar", "SELECT CAST(d AS DATE) AS Date, year(d) AS Year, 'Q' || quarter(d) AS Quarter, month(d) AS Month, monthname(d) AS MonthName, day(d) AS Day, isodow(d) AS DayOfWeek, dayname(d) AS DayName, CAST(count(o_orderkey) AS BIGINT) AS orders FROM (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) AS d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY d")(lambda t: ti.calendar(t.spark, 1992, 2002).join(t.orders.groupBy(F.to_date("o_orderdate").alias("Date")).agg(one().alias("orders")), "Date", "left").fillna({"orders": 0}))
query("cal_02_attach", "SELECT o_orderkey, dayname(o_orderdate) AS DayName, 'Q' || quarter(o_orderdate) AS Quarter FROM orders")(lambda t: ti.attach(t.orders, ti.calendar(t.spark, 1990, 2005), "o_orderdate").select("o_orderkey", "DayName", "Quarter"))
query("cal_04_ytd", f"SELECT p, period, n, CAST(sum(n) OVER (PARTITION BY p, year(period) ORDER BY period) AS BIGINT) AS ytd FROM {DENSE}")(lambda t: ti.to_date_total(grid(t), ["p"], "year", "n"))
query("cal_05_prior_year", f"SELECT a.p, a.period, a.n, b.n AS prior FROM {DENSE} a LEFT JOIN {DENSE} b ON a.p = b.p AND b.period = CAST(a.period - INTERVAL 1 YEAR AS DATE)")(lambda t: ti.shifted(grid(t), ["p"], 12, "n"))
query("cal_06_yoy", f"SELECT a.p, a.period, a.n, b.n AS n_py, round((a.n - b.n) / b.n, 6) AS n_yoy FROM {DENSE} a LEFT JOIN {DENSE} b ON a.p = b.p AND b.period = CAST(a.period - INTERVAL 1 YEAR AS DATE)")(lambda t: ti.year_over_year(grid(t), ["p"], "n").withColumn("n_yoy", F.round("n_yoy", 6)))
query("cal_07_batch", f"SELECT a.p, a.period, a.n, CAST(sum(a.n) OVER (PARTITION BY a.p, year(a.period) ORDER BY a.period) AS BIGINT) AS n_ytd, b.n AS n_py, a.v, b.v AS v_py FROM {DENSE} a LEFT JOIN {DENSE} b ON a.p = b.p AND b.period = CAST(a.period - INTERVAL 1 YEAR AS DATE)")(lambda t: ti.standard_set(t.orders.withColumn("p", C("o_orderpriority")), "o_orderdate", ["p"], {"n": one(), "v": F.round(F.sum("o_totalprice"), 2)}).select("p", "period", "n", "n_ytd", "n_py", "v", "v_py"))
query("cal_08_qtd", f"SELECT p, period, n, CAST(sum(n) OVER (PARTITION BY p, date_trunc('quarter', period) ORDER BY period) AS BIGINT) AS qtd FROM {DENSE}")(lambda t: ti.to_date_total(grid(t), ["p"], "quarter", "n", "qtd"))
query("cal_09_balances", "SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, arg_min(o_totalprice, (CAST(o_orderdate AS DATE), -o_totalprice)) AS opening, arg_max(o_totalprice, (CAST(o_orderdate AS DATE), o_totalprice)) AS closing FROM orders GROUP BY 1, 2")(lambda t: ti.balances(t.orders.withColumn("p", C("o_orderpriority")), "o_orderdate", ["p"], "o_totalprice"))
query("cal_10_cadence", "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")(lambda t: t.orders.groupBy(ti.cadence("week", C("o_orderdate")).alias("period")).agg(one().alias("n")))


def K(key, measure, sql, digits=6):
    query(key, f"SELECT l_returnflag, round({sql}, {digits}) AS v FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(r(measure(), digits).alias("v")))




def COST():
    return C("l_extendedprice") * C("l_discount")


K("kpi_01_per_row", lambda: kpi.per_row("l_quantity"), "sum(l_quantity) / count(*)")
K("kpi_02_share", lambda: kpi.share(C("l_discount") > 0.05), "count(*) FILTER (WHERE l_discount > 0.05) / count(*)")
K("kpi_03_ratio", lambda: kpi.ratio_of_sums("l_tax", "l_quantity"), "sum(l_tax) / sum(l_quantity)", 8)
K("kpi_04_mean", lambda: kpi.mean("l_tax"), "avg(l_tax)", 8)
K("kpi_05_net", lambda: kpi.net(C("l_extendedprice"), COST()), "sum(l_extendedprice) - sum(l_extendedprice * l_discount)", 2)
K("kpi_06_variance", lambda: kpi.variance_percent(C("l_extendedprice"), C("l_quantity") * 1000), "(sum(l_extendedprice) - sum(l_quantity * 1000)) / sum(l_quantity * 1000)")
query("kpi_07_revenue_ytd", f"SELECT p, period, round(sum(v) OVER (PARTITION BY p, year(period) ORDER BY period), 2) AS ytd FROM {DENSE}")(lambda t: ti.to_date_total(grid(t, F.round(F.sum("o_totalprice"), 2), "v"), ["p"], "year", "v").select("p", "period", r(C("ytd"), 2).alias("ytd")))
query("kpi_08_days_outstanding", "SELECT y, round(a / b * 365, 6) AS days FROM (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) FULL JOIN (SELECT year(l_shipdate) AS y, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1) USING (y)")(lambda t: kpi.across(t.orders.filter("o_orderstatus = 'O'").withColumn("y", F.year("o_orderdate")), t.lineitem.withColumn("y", F.year("l_shipdate")), ["y"], F.sum("o_totalprice"), F.sum("l_extendedprice"), "days", 365.0).withColumn("days", F.round("days", 6)))
K("kpi_09_per_distinct", lambda: kpi.per_distinct("l_quantity", "l_orderkey"), "sum(l_quantity) / count(DISTINCT l_orderkey)")
query("kpi_10_turnover", "SELECT k, round(a / b, 6) AS turnover FROM (SELECT l_partkey AS k, sum(l_quantity) AS a FROM lineitem GROUP BY 1) FULL JOIN (SELECT p_partkey AS k, sum(p_size) AS b FROM part GROUP BY 1) USING (k)")(lambda t: kpi.across(t.lineitem.withColumn("k", C("l_partkey")), t.part.withColumn("k", C("p_partkey")), ["k"], F.sum("l_quantity"), F.sum("p_size"), "turnover").withColumn("turnover", F.round("turnover", 6)))
query("kpi_11_same_store", "SELECT CAST(count(*) AS BIGINT) AS stores, round(sum(a), 2) AS now, round(sum(b), 2) AS before, round((sum(a) - sum(b)) / sum(b), 6) AS growth FROM (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS a, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")(lambda t: kpi.same_store_growth(t.orders.withColumn("y", F.year("o_orderdate")), "o_custkey", "y", "o_totalprice", 1997, 1996).select("stores", F.round("now", 2).alias("now"), F.round("before", 2).alias("before"), F.round("growth", 6).alias("growth")))
query("kpi_12_lifetime", "SELECT o_orderstatus, round(avg(s), 2) AS lifetime_value, CAST(count(*) AS BIGINT) AS entities FROM (SELECT o_orderstatus, o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) GROUP BY 1")(lambda t: kpi.lifetime_value(t.orders, "o_custkey", "o_totalprice", ["o_orderstatus"]).withColumn("lifetime_value", F.round("lifetime_value", 2)))
query("kpi_13_scorecard", "SELECT 'orders' AS metric, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS value, 18.0::DOUBLE AS target, CASE WHEN count(*) >= 18 THEN 'on target' WHEN count(*) >= 16.2 THEN 'at risk' ELSE 'behind' END AS status FROM orders GROUP BY 2 UNION ALL SELECT 'largest', CAST(date_trunc('year', o_orderdate) AS DATE), max(o_totalprice), 400000.0::DOUBLE, CASE WHEN max(o_totalprice) >= 400000 THEN 'on target' WHEN max(o_totalprice) >= 360000 THEN 'at risk' ELSE 'behind' END FROM orders WHERE o_orderstatus = 'F' GROUP BY 2")(lambda t: kpi.scorecard(t.orders, "o_orderdate", [{"name": "orders", "value": "o_orderkey", "aggregation": "rows", "grain": "month", "target": 18}, {"name": "largest", "value": "o_totalprice", "aggregation": "max", "grain": "year", "target": 400000, "filter": C("o_orderstatus") == "F"}]))
query("kpi_14_sla", "SELECT event_type, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS met, round(avg(CAST(ok AS INT)), 6) AS rate FROM (SELECT event_type, value <= 80 AND value >= 10 AND user_id % 10 <> 0 AS ok FROM events) GROUP BY 1")(lambda t: kpi.sla_rate(kpi.sla(t.events.withColumn("fine", C("user_id") % 10 != 0), ("value", 80.0), ("value", 10.0), "fine"), ["event_type"]).withColumn("rate", F.round("rate", 6)))
query("kpi_15_run_log", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS sessions, round(sum(value), 4) AS total_duration, round(avg(value), 6) AS avg_duration, CAST(count(*) FILTER (WHERE value < 1) AS BIGINT) AS errors FROM events GROUP BY 1")(lambda t: kpi.run_log(t.events, "user_id", "value", C("value") < 1, ["event_type"]).withColumns({"total_duration": F.round("total_duration", 4), "avg_duration": F.round("avg_duration", 6)}))
query("kpi_16_bottlenecks", "SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS issues, array_to_string(list_sort(list_distinct(list(o_orderkey)))[1:3], ',') AS samples FROM orders GROUP BY 1, 2")(lambda t: kpi.bottlenecks(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey").withColumn("samples", F.array_join("samples", ",")))
query("kpi_17_progress", "SELECT event_type, CAST(count(*) FILTER (WHERE value >= 80) AS BIGINT) AS done, CAST(count(*) FILTER (WHERE value > 0 AND value < 80) AS BIGINT) AS partial, CAST(count(*) FILTER (WHERE value <= 0 OR value IS NULL) AS BIGINT) AS pending FROM events GROUP BY 1")(lambda t: t.events.groupBy("event_type").agg(*kpi.progress("value")))

PART = "p_partkey, p_brand, p_retailprice"


def parts(t):
    return t.part.select("p_partkey", "p_brand", "p_retailprice")


query("anl_01_reference_line", "SELECT p_partkey, p_brand, p_retailprice, round(median(p_retailprice) OVER (PARTITION BY p_brand), 4) AS line FROM part")(lambda t: analytics.reference_line(parts(t), "p_retailprice", "median", ["p_brand"]).withColumn("line", F.round("line", 4)))
query("anl_02_mode", "SELECT p_partkey, b AS line FROM part, (SELECT p_brand AS b FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1)")(lambda t: analytics.reference_line(parts(t), "p_brand", "mode").select("p_partkey", "line"))
query("anl_03_band", "SELECT p_partkey, p_retailprice BETWEEN 950 AND 1400 AS in_band FROM part")(lambda t: analytics.band(parts(t), "p_retailprice", F.lit(950), F.lit(1400)).select("p_partkey", "in_band"))
query("anl_04_deviation_band", "SELECT p_partkey, round(avg(p_retailprice) OVER w - stddev_samp(p_retailprice) OVER w, 4) AS band_low, round(avg(p_retailprice) OVER w + stddev_samp(p_retailprice) OVER w, 4) AS band_high FROM part WINDOW w AS (PARTITION BY p_brand)")(lambda t: analytics.deviation_band(parts(t), "p_retailprice", ["p_brand"]).select("p_partkey", F.round("band_low", 4).alias("band_low"), F.round("band_high", 4).alias("band_high")))
query("anl_05_iqr_band", "SELECT p_partkey, round((SELECT quantile_cont(p_retailprice, 0.25) FROM part), 4) AS band_low, round((SELECT quantile_cont(p_retailprice, 0.75) FROM part), 4) AS band_high FROM part")(lambda t: analytics.percentile_band(parts(t), "p_retailprice").select("p_partkey", F.round("band_low", 4).alias("band_low"), F.round("band_high", 4).alias("band_high")))
query("anl_06_confidence", "SELECT p_partkey, round(avg(p_retailprice) OVER w - 1.959963984540054 * stddev_samp(p_retailprice) OVER w / sqrt(count(p_retailprice) OVER w), 4) AS band_low FROM part WINDOW w AS (PARTITION BY p_brand)")(lambda t: analytics.confidence_band(parts(t), "p_retailprice", ["p_brand"]).select("p_partkey", F.round("band_low", 4).alias("band_low")))
query("anl_07_trend", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")(lambda t: analytics.trend(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n"))
query("anl_08_power_trend", "SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")(lambda t: analytics.trend(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"], "power").select("l_returnflag", F.round("slope", 6).alias("slope")))
PARABOLA = """WITH s AS (SELECT l_returnflag, count(*)::DOUBLE AS a, sum(x) AS b, sum(x * x) AS c, sum(x * x * x) AS d, sum(x * x * x * x) AS e, sum(y) AS t, sum(x * y) AS u, sum(x * x * y) AS v
  FROM (SELECT l_returnflag, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY 1),
m AS (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS w FROM s)
SELECT l_returnflag, round((t * (c * e - d * d) - u * (b * e - c * d) + v * (b * d - c * c)) / w, 2) AS c0,
       round((a * (u * e - v * d) - b * (t * e - v * c) + c * (t * d - u * c)) / w, 3) AS c1,
       round((a * (c * v - d * u) - b * (b * v - d * t) + c * (b * u - c * t)) / w, 5) AS c2 FROM m"""
query("anl_09_parabola", PARABOLA)(lambda t: analytics.parabola(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", r(C("c0"), 2).alias("c0"), r(C("c1"), 3).alias("c1"), r(C("c2"), 5).alias("c2")))
query("anl_10_r2", "SELECT l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")(lambda t: analytics.trend(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("r2", 6).alias("r2")))


def MONTHS():
    return F.year("o_orderdate") * 12 + F.month("o_orderdate")


query("anl_11_forecast", "WITH s AS (SELECT o_orderpriority AS p, year(o_orderdate) * 12 + month(o_orderdate) AS x, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2), l AS (SELECT p, max(x) AS m FROM s GROUP BY 1), f AS (SELECT s.p, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, any_value(m) AS m FROM s JOIN l ON s.p = l.p WHERE x <= m - 1 GROUP BY 1) SELECT p, CAST(m - 1 + i AS INT) AS x, round(a + b * (m - 1 + i), 4) AS forecast FROM f, (SELECT unnest([1, 2, 3, 4]) AS i)")(lambda t: analytics.forecast(t.orders.groupBy(C("o_orderpriority").alias("p"), MONTHS().alias("x")).agg(one().cast("double").alias("y")), "x", "y", 3, ["p"], ignore_last=1).select("p", C("x").cast("int").alias("x"), F.round("forecast", 4).alias("forecast")))
#: Level, trend, twelve seasons and squared errors, carried from month to month; a series under two years has no seasons.
HOLT_WINTERS = """WITH RECURSIVE r AS (SELECT p, x, y, row_number() OVER (PARTITION BY p ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY p) AS n
  FROM (SELECT o_orderpriority AS p, year(o_orderdate) * 12 + month(o_orderdate) AS x, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2)),
g AS (SELECT p, list(y ORDER BY i) AS ys, max(x) AS last, count(*)::INT AS len, CASE WHEN count(*) >= 24 THEN 12 ELSE 1 END AS m FROM r WHERE i < greatest(n - 1, 1) GROUP BY p),
t AS (SELECT *, CASE WHEN len >= 2 * m THEN (list_sum(ys[m + 1:2 * m]) - list_sum(ys[1:m])) / m / m ELSE 0.0 END AS trend, list_sum(ys[1:m]) / m AS middle FROM g),
w AS (SELECT p, ys, last, len, m, 0 AS i, middle - trend * (m + 1) / 2 AS level, trend, CASE WHEN m > 1 THEN list_transform(range(m), lambda k: ys[k + 1] - (middle + trend * (k - (m - 1) / 2.0))) ELSE [0.0::DOUBLE] END AS seasons, 0.0::DOUBLE AS sq FROM t
  UNION ALL
  SELECT p, ys, last, len, m, i + 1, l, 0.05 * (l - level) + 0.95 * trend, CASE WHEN m > 1 THEN list_concat(list_concat(seasons[1:j - 1], [0.2 * (v - l) + 0.8 * s]), seasons[j + 1:m]) ELSE seasons END, sq + CASE WHEN i >= m THEN (v - (level + trend + s)) * (v - (level + trend + s)) ELSE 0 END
  FROM (SELECT *, 0.3 * (v - s) + 0.7 * (level + trend) AS l FROM (SELECT *, ys[i + 1] AS v, seasons[i % m + 1] AS s, i % m + 1 AS j FROM w WHERE i < len))),
f AS (SELECT p, last + k AS x, level + k * trend + seasons[(len + k - 1) % m + 1] AS forecast, 1.959963984540054 * sqrt(sq / greatest(len - m, 1)) * sqrt(1 + coalesce(list_sum(list_transform(range(1, k), lambda q: power(0.3 * (1 + q * 0.05) + CASE WHEN m > 1 AND q % m = 0 THEN 0.14 ELSE 0 END, 2))), 0)) AS half
  FROM w, (SELECT unnest(range(1, 8)) AS k) WHERE i = len)
SELECT p, CAST(x AS BIGINT) AS x, round(forecast, 6) AS forecast, round(forecast - half, 6) AS low, round(forecast + half, 6) AS high FROM f"""
query("anl_11_holt_winters", HOLT_WINTERS)(lambda t: analytics.holt_winters(t.orders.groupBy(C("o_orderpriority").alias("p"), MONTHS().alias("x")).agg(one().cast("double").alias("y")), "x", "y", 6, "p", ignore_last=1).select("p", "x", *[F.round(c, 6).alias(c) for c in ("forecast", "low", "high")]))
CENTRES = [(5.0, 1000.0), (20.0, 1200.0), (40.0, 1500.0)]
query("anl_12_assigned", f"SELECT p_partkey, list_position(d, list_min(d)) - 1 AS cluster, round(list_min(d), 4) AS distance FROM (SELECT p_partkey, [{', '.join(f'(p_size - {a}) * (p_size - {a}) + (p_retailprice - {b}) * (p_retailprice - {b})' for a, b in CENTRES)}] AS d FROM part)")(lambda t: analytics.assigned(t.part, ["p_size", "p_retailprice"], CENTRES).select("p_partkey", C("cluster").alias("cluster"), F.round("distance", 4).alias("distance")))
query("anl_12_clusters")(lambda t: analytics.clusters(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 4))
query("anl_13_histogram", "SELECT CAST(floor(o_totalprice / 25000) * 25000 AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")(lambda t: analytics.histogram(t.orders, "o_totalprice", 25000).select(C("bin").cast("long").alias("bin"), "n"))


def _mapping(t):
    return t.nation.select(F.concat(F.lit("user"), C("n_regionkey")).alias("user"), C("n_nationkey").alias("value"))


query("sec_01_allowed", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")(lambda t: security.allowed_values(t.customer, _mapping(t), "user2", "c_nationkey").select("c_custkey"))
query("sec_02_own", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda t: security.own_rows(t.customer, "c_mktsegment", "BUILDING").select("c_custkey"))
query("sec_03_by_dimension", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)")(lambda t: security.by_dimension(t.orders, t.customer, ("o_custkey", "c_custkey"), C("c_acctbal") > 8000).select("o_orderkey"))
query("sec_04_member", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")(lambda t: security.member_of(t.customer, t.nation.select(C("n_name").alias("user"), F.lit("admins").alias("group")), "nobody", "admins", C("c_acctbal") < 0).select("c_custkey", "c_acctbal"))
query("sec_05_combine", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 3")(lambda t: t.customer.filter(security.combine({"rich": "c_acctbal > 9000", "rich2": "c_acctbal  >  9000", "three": "c_nationkey = 3"})).select("c_custkey"))
ROLES = [("sales", "rich", "customer", "c_acctbal > 9000"), ("hr", "rich", "customer", "c_acctbal  >  9500"), ("hr", "three", "customer", "c_nationkey = 3"), ("sales", "three", "customer", "c_nationkey  = 3"), ("hr", "orders", "orders", "o_custkey = 1")]
query("sec_05_namespaced", "SELECT 'sales.rich' AS role, c_custkey FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'hr.rich', c_custkey FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 'three', c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'orders', c_custkey FROM customer")(lambda t: security.visible(t.customer, "customer", security.consolidate(ROLES, "namespace")).select("role", "c_custkey"))
query("sec_05_merged", "SELECT 'rich' AS role, c_custkey FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 'three', c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'orders', c_custkey FROM customer")(lambda t: security.visible(t.customer, "customer", security.consolidate(ROLES, "and")).select("role", "c_custkey"))
query("sec_07_propagate", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")(lambda t: security.propagate(t.orders, (security.propagate(t.customer, (t.nation.filter("n_regionkey = 1"), "c_nationkey", "n_nationkey")), "o_custkey", "c_custkey")).select("o_orderkey"))
query("sec_08_classify", "SELECT 'contact' AS \"column\", 'email' AS kind, 'value' AS \"by\", 1.0::DOUBLE AS share UNION ALL SELECT 'host', 'ip', 'value', 1.0::DOUBLE UNION ALL SELECT 'c_name', 'name', 'name', NULL WHERE false")(lambda t: security.classify(t.customer.select(F.concat(F.lit("c"), C("c_custkey"), F.lit("@example.com")).alias("contact"), F.concat(F.lit("10.0.0."), C("c_nationkey")).alias("host"), C("c_mktsegment").alias("seg"))))
query("sec_09_masked", "SELECT sha256(CAST(c_custkey AS VARCHAR)) AS c_custkey, regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS c_name, c_mktsegment FROM (SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer)")(lambda t: security.masked(t.customer.select("c_custkey", F.upper("c_name").alias("c_name"), "c_acctbal", "c_mktsegment"), {"c_custkey": "hash", "c_name": "mask", "c_acctbal": "drop", "c_mktsegment": "public"}))
query("jon_19_secured_star", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY 1")(lambda t: joins.join(t.orders, security.allowed_values(t.customer, _mapping(t), "user0", "c_nationkey"), [("o_custkey", "c_custkey")], "inner").groupBy("c_mktsegment").agg(one().alias("n")))
