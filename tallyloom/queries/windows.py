"""Table calculations over a view: revenue by nation and month, and others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import tablecalc as T

from .registry import query, r

C = F.col
#: The view: orders and their value by priority and month.
VIEW = "(SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"
S = T.spec(["m", "p"])


def view(t):
    return t.orders.groupBy(C("o_orderpriority").alias("p"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))


def V(key, value, sql):
    query(key, f"SELECT p, m, {sql} AS x FROM {VIEW}")(lambda t: view(t).select("p", "m", value().alias("x")))


O, FR = "PARTITION BY p ORDER BY m", "PARTITION BY p ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
V("win_01_sum", lambda: r(T.window("sum", S, "v"), 2), "round(sum(v) OVER (PARTITION BY p), 2)")
V("win_02_framed", lambda: r(T.window("sum", S, "v", first=-2, last=1), 2), f"round(sum(v) OVER ({O} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2)")
V("win_03_avg", lambda: r(T.window("avg", S, "n"), 8), "round(avg(n) OVER (PARTITION BY p), 8)")
V("win_04_max", lambda: T.window("max", S, "v"), "max(v) OVER (PARTITION BY p)")
V("win_05_min", lambda: T.window("min", S, "v"), "min(v) OVER (PARTITION BY p)")
V("win_06_count", lambda: T.window("count", S, "v"), "CAST(count(v) OVER (PARTITION BY p) AS BIGINT)")
V("win_07_median", lambda: r(T.window("median", S, "n", first=-4, last=0), 4), f"round(median(n) OVER ({O} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4)")
V("win_08_stdev", lambda: r(T.window("stdev", S, "n"), 4), "round(stddev_samp(n) OVER (PARTITION BY p), 4)")
V("win_09_stdevp", lambda: r(T.window("stdevp", S, "n"), 4), "round(stddev_pop(n) OVER (PARTITION BY p), 4)")
V("win_10_var", lambda: r(T.window("var", S, "n"), 7), "round(var_samp(n) OVER (PARTITION BY p), 7)")
V("win_11_varp", lambda: r(T.window("varp", S, "n"), 7), "round(var_pop(n) OVER (PARTITION BY p), 7)")
V("win_12_percentile", lambda: r(T.window_percentile(S, "n", 0.25), 4), "round(quantile_cont(n, 0.25) OVER (PARTITION BY p), 4)")
V("win_13_corr", lambda: r(T.window("corr", S, "n", "v"), 4), "round(corr(n, v) OVER (PARTITION BY p), 4)")
V("win_14_covar", lambda: r(T.window("covar", S, "n", "v"), 0), "round(covar_samp(n, v) OVER (PARTITION BY p), 0)")
V("win_15_covarp", lambda: r(T.window("covarp", S, "n", "v"), 0), "round(covar_pop(n, v) OVER (PARTITION BY p), 0)")
V("win_16_running_sum", lambda: r(T.running("sum", S, "v"), 2), f"round(sum(v) OVER ({FR}), 2)")
V("win_17_running_avg", lambda: r(T.running("avg", S, "n"), 8), f"round(avg(n) OVER ({FR}), 8)")
V("win_18_running_count", lambda: T.running("count", S, "v"), f"CAST(count(v) OVER ({FR}) AS BIGINT)")
V("win_19_running_max", lambda: T.running("max", S, "v"), f"max(v) OVER ({FR})")
V("win_20_running_min", lambda: T.running("min", S, "v"), f"min(v) OVER ({FR})")
V("win_21_rank", lambda: T.rank(S, "n").cast("long"), "CAST(rank() OVER (PARTITION BY p ORDER BY n DESC) AS BIGINT)")
V("win_22_rank_dense", lambda: T.rank(S, "n", "dense").cast("long"), "CAST(dense_rank() OVER (PARTITION BY p ORDER BY n DESC) AS BIGINT)")
V("win_23_rank_unique", lambda: T.rank(S, "n", "unique").cast("long"), "CAST(row_number() OVER (PARTITION BY p ORDER BY n DESC, m) AS BIGINT)")
V("win_24_rank_modified", lambda: T.rank(S, "n", "modified"), "CAST(count(*) OVER (PARTITION BY p ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)")
V("win_25_rank_percentile", lambda: r(T.rank(S, "n", "percentile"), 6), "round(percent_rank() OVER (PARTITION BY p ORDER BY n DESC), 6)")
V("win_26_index", lambda: T.index(S).cast("long"), f"CAST(row_number() OVER ({O}) AS BIGINT)")
V("win_27_first", lambda: T.first(S).cast("long"), f"CAST(1 - row_number() OVER ({O}) AS BIGINT)")
V("win_28_last", lambda: T.last(S), f"CAST(count(*) OVER (PARTITION BY p) - row_number() OVER ({O}) AS BIGINT)")
V("win_29_size", lambda: T.size(S), "CAST(count(*) OVER (PARTITION BY p) AS BIGINT)")
V("win_30_lookup", lambda: T.lookup(S, "v", -3), f"lag(v, 3) OVER ({O})")
query("win_31_previous_value", f"WITH RECURSIVE w AS (SELECT *, row_number() OVER ({O}) AS i FROM {VIEW}), rec AS (SELECT p, m, n, i, CAST(100 AS DOUBLE) * 0.5 + n AS x FROM w WHERE i = 1 UNION ALL SELECT w.p, w.m, w.n, w.i, rec.x * 0.5 + w.n FROM rec JOIN w ON w.p = rec.p AND w.i = rec.i + 1) SELECT p, m, round(x, 4) AS x FROM rec")(lambda t: T.previous_value(view(t), S, "x", 100.0, lambda before, row: before * 0.5 + row["n"]).select("p", "m", r(C("x")).alias("x")))
query("win_32_total", f"SELECT p, m, a AS total_avg FROM {VIEW} JOIN (SELECT o_orderpriority AS q, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY 1) ON p = q")(lambda t: T.total(t.orders.withColumn("p", C("o_orderpriority")), view(t), ["p"], {"total_avg": r(F.avg("o_totalprice"), 2)}).select("p", "m", "total_avg"))
V("win_33_percent_of_total", lambda: r(T.percent_of_total(S, "v"), 6), "round(v / sum(v) OVER (PARTITION BY p), 6)")
V("win_34_percent_difference", lambda: r(T.percent_difference(S, "v"), 4), f"round((v - lag(v) OVER ({O})) / lag(v) OVER ({O}), 4)")
V("win_35_difference", lambda: r(T.difference(S, "v"), 2), f"round(v - lag(v) OVER ({O}), 2)")
V("win_36_quick_running", lambda: T.running("sum", T.spec(order_by=["m"], partition_by=["p"]), "n"), f"CAST(sum(n) OVER ({FR}) AS BIGINT)")
V("win_37_quick_rank", lambda: T.rank(T.spec(partition_by=["p"], order_by=["m"]), "v", "unique").cast("long"), "CAST(row_number() OVER (PARTITION BY p ORDER BY v DESC, m) AS BIGINT)")
V("win_38_multi_level", lambda: T.index(T.spec(partition_by=["p"], order_by=["-n"], match_by=["m"])).cast("long"), "CAST(row_number() OVER (PARTITION BY p ORDER BY n DESC, m) AS BIGINT)")
V("win_39_moving_avg", lambda: r(T.moving_avg(S, "n", 3), 8), f"round(avg(n) OVER ({O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 8)")

# Over whole tables, which no task holds.
RA = "ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
query("win_16_running_all", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({RA}), 2) AS total, CAST(count(*) OVER ({RA}) AS BIGINT) AS n, min(o_totalprice) OVER ({RA}) AS low, max(o_totalprice) OVER ({RA}) AS high FROM orders")(lambda t: T.running_all(t.orders.select("o_orderkey", "o_totalprice"), T.spec(order_by=["o_orderkey"]), {"total": ("sum", "o_totalprice"), "n": ("count", "o_totalprice"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")}).select("o_orderkey", r(C("total"), 2).alias("total"), "n", "low", "high"))
query("win_16_running_panes", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders")(lambda t: T.running_all(t.orders, T.spec(order_by=["-o_orderdate"], partition_by=["o_orderstatus"], match_by=["o_orderkey"]), {"total": ("sum", "o_totalprice")}).select("o_orderkey", r(C("total"), 2).alias("total")))
query("win_31_since_urgent", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY g ORDER BY o_orderkey) + CASE WHEN g = 0 THEN 100 ELSE 0 END AS DOUBLE) AS x FROM (SELECT o_orderkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) AS g FROM orders)")(lambda t: T.previous_value(t.orders, T.spec(order_by=["o_orderkey"]), "x", 100.0, lambda before, row: F.when(row["o_orderpriority"] == "1-URGENT", 0.0).otherwise(before) + 1).select("o_orderkey", "x"))
query("win_31_folded", f"WITH RECURSIVE w AS (SELECT *, row_number() OVER ({O}) AS i FROM {VIEW}), rec AS (SELECT p, m, n, i, greatest(CAST(0 AS DOUBLE), n - 3.0) AS x FROM w WHERE i = 1 UNION ALL SELECT w.p, w.m, w.n, w.i, greatest(0, rec.x + w.n - 3.0) FROM rec JOIN w ON w.p = rec.p AND w.i = rec.i + 1) SELECT p, m, round(x, 4) AS x FROM rec")(lambda t: T.folded(view(t), S, "x", 0.0, lambda before, row: max(0.0, before + row["n"] - 3.0)).select("p", "m", r(C("x")).alias("x")))
