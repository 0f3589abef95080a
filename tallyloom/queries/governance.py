"""Data quality, lineage, incremental loads, streams, scripts, flows, sources and sinks over the given tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import scripts
from tallyloom.operators import columns, filters, incremental, joins, lineage, quality, reshape
from tallyloom.plans.flow import Flow
from tallyloom.shared import shared_dir
from tallyloom.sources import documents, readers, writers
from tallyloom.streaming import jobs

from .registry import query, r

C = F.col


def one():
    """Row count."""
    return F.count(F.lit(1))




def shared(t) -> str:
    """A fresh folder that executors see."""
    return f"{shared_dir(t.spark)}/queries/{uuid.uuid4().hex}"


query("qlt_01_profile", "SELECT 'c_custkey' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(c_custkey) AS BIGINT) AS nulls, CAST(count(DISTINCT c_custkey) AS BIGINT) AS \"distinct\", CAST(min(c_custkey) AS VARCHAR) AS min, CAST(max(c_custkey) AS VARCHAR) AS max FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer")(lambda t: quality.profile(t.customer.select("c_custkey", "c_mktsegment")))
query("qlt_02_foreign_key", "SELECT CAST((SELECT count(DISTINCT o_custkey) FROM orders) AS BIGINT) AS child_keys, CAST((SELECT count(DISTINCT c_custkey) FROM customer) AS BIGINT) AS parent_keys, CAST((SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS missing, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS is_foreign_key")(lambda t: quality.inclusion(t.orders, "o_custkey", t.customer, "c_custkey"))
query("qlt_03_suggest_keys", "SELECT 'orders' AS child, 'o_custkey' AS child_key, 'customer' AS parent, 'c_custkey' AS parent_key, round((SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) / (SELECT count(DISTINCT o_custkey) FROM orders), 6) AS overlap UNION ALL SELECT 'customer', 'c_custkey', 'orders', 'o_custkey', round((SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) / (SELECT count(*) FROM customer), 6)")(lambda t: quality.suggest_keys({"orders": t.orders, "customer": t.customer.drop("c_nationkey")}).withColumn("overlap", F.round("overlap", 6)))
query("qlt_04_jaccard", "SELECT CAST(count(*) FILTER (WHERE n = 2) AS BIGINT) AS shared, CAST(count(*) AS BIGINT) AS all_values, count(*) FILTER (WHERE n = 2) / count(*) AS jaccard FROM (SELECT v, count(*) AS n FROM (SELECT DISTINCT o_custkey AS v, 1 AS s FROM orders UNION ALL SELECT DISTINCT c_custkey, 2 FROM customer) GROUP BY v)")(lambda t: quality.jaccard_values(t.orders, "o_custkey", t.customer, "c_custkey"))
KEYED = "SELECT 'orders' AS t, 'o_custkey' AS c, o_custkey AS v FROM orders UNION ALL SELECT 'orders', 'o_orderkey', o_orderkey FROM orders UNION ALL SELECT 'customer', 'c_custkey', c_custkey FROM customer UNION ALL SELECT 'lineitem', 'l_orderkey', l_orderkey FROM lineitem UNION ALL SELECT 'lineitem', 'l_partkey', l_partkey FROM lineitem UNION ALL SELECT 'lineitem', 'l_suppkey', l_suppkey FROM lineitem UNION ALL SELECT 'part', 'p_partkey', p_partkey FROM part UNION ALL SELECT 'supplier', 's_suppkey', s_suppkey FROM supplier"
query("qlt_04_overlapping", f"WITH k AS (SELECT DISTINCT t, c, v FROM ({KEYED})), n AS (SELECT t, c, count(*) AS n FROM k GROUP BY 1, 2), s AS (SELECT a.t AS child, a.c AS child_key, b.t AS parent, b.c AS parent_key, count(*) AS shared FROM k a JOIN k b ON a.v = b.v AND a.t <> b.t GROUP BY ALL), j AS (SELECT s.*, a.n AS child_values, b.n AS parent_values, shared / (a.n + b.n - shared) AS jaccard FROM s JOIN n a ON a.t = child AND a.c = child_key JOIN n b ON b.t = parent AND b.c = parent_key WHERE a.n < b.n OR (a.n = b.n AND (child < parent OR (child = parent AND child_key < parent_key)))) SELECT child, child_key, parent, parent_key, child_values, parent_values, shared, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.5")(lambda t: quality.overlapping_columns({"orders": t.orders.select("o_custkey", "o_orderkey"), "customer": t.customer.select("c_custkey"), "lineitem": t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), "part": t.part.select("p_partkey"), "supplier": t.supplier.select("s_suppkey")}).withColumn("jaccard", F.round("jaccard", 6)))
EQ = "SELECT k, status FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'missing' WHEN abs(b.v - a.v) / abs(a.v) <= 0.01 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey + 2 AS k, sum(o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 1.001 END) AS v FROM orders GROUP BY 1) b ON a.k = b.k)"


def _equivalence(t):
    a = t.orders.groupBy(C("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    b = t.orders.groupBy((C("o_custkey") + 2).alias("k")).agg(F.sum(C("o_totalprice") * F.when(C("o_custkey") % 2 == 0, 1).otherwise(1.001)).alias("v"))
    return quality.equivalence(a, b, ["k"], "v")


query("qlt_05_equivalence", EQ)(lambda t: _equivalence(t).select("k", "status"))
query("qlt_06_report", f"SELECT CAST(count(*) FILTER (WHERE status = 'passed') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE status = 'missing') AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS total, 'failed' AS overall FROM ({EQ})")(lambda t: quality.equivalence_report(_equivalence(t)))
query("qlt_07_snapshot", "SELECT 'nation' AS \"table\", 'unchanged' AS status, CAST(count(*) AS BIGINT) AS old_rows, CAST(count(*) AS BIGINT) AS new_rows FROM nation UNION ALL SELECT 'orders', 'changed', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0)")(lambda t: quality.snapshot_diff(quality.snapshot({"nation": t.nation, "orders": t.orders}), quality.snapshot({"nation": t.nation, "orders": t.orders.filter("o_orderkey % 2 = 0")})))
query("qlt_08_schema_drift", "SELECT 'orders' AS \"table\", c AS \"column\", a AS old_type, b AS new_type, s AS status FROM (VALUES ('o_custkey', 'bigint', 'string', 'type changed'), ('extra', NULL, 'int', 'added'), ('o_orderstatus', 'string', NULL, 'removed')) v(c, a, b, s) WHERE (SELECT count(*) FROM orders) > 0")(lambda t: quality.schema_drift(quality.schema_table({"orders": t.orders}), quality.schema_table({"orders": t.orders.withColumn("o_custkey", C("o_custkey").cast("string")).withColumn("extra", F.lit(1)).drop("o_orderstatus")})))
PARTS = "SELECT DISTINCT p_name || ' ' || p_brand AS s FROM part"
PAIRS = "WITH b AS (SELECT x.s AS l, y.t AS r, {0} AS ln, {1} AS rn FROM (" + PARTS + ") x, (SELECT DISTINCT replace(lower(s), 'in', '') AS t FROM (" + PARTS + ")) y)"
TABLE_NAMES = PAIRS.format(*[f"translate(lower(regexp_replace(regexp_extract(regexp_replace(trim({c}), '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), '[^.]*$'), '^[\\[\\]]+|[\\[\\]]+$', '', 'g')), '_- ', '')" for c in ("x.s", "y.t")])
PLAIN_NAMES = PAIRS.format(*[f"trim(translate(lower({c}), ' -', '__'))" for c in ("x.s", "y.t")])


def _parts(t):
    """Parts by name and brand, and the same spelled without "in"."""
    names = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("s"))
    return names, names.select(F.replace(F.lower("s"), F.lit("in"), F.lit("")).alias("m"))


query("qlt_09_fuzzy_match", TABLE_NAMES + ", g AS (SELECT l, r, ln, rn, list_distinct(list_transform(range(1, length(ln)), lambda i: ln[i:i + 1])) AS x, list_distinct(list_transform(range(1, length(rn)), lambda i: rn[i:i + 1])) AS y FROM b), sc AS (SELECT l, r, CASE WHEN ln = rn THEN 1.0 WHEN contains(ln, rn) OR contains(rn, ln) THEN least(length(ln), length(rn)) / greatest(length(ln), length(rn)) ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS score, len(list_intersect(x, y)) AS c FROM g) SELECT l AS \"left\", r AS \"right\", round(CAST(score AS DOUBLE), 6) AS score FROM sc WHERE score >= 0.8 AND c > 0")(lambda t: quality.fuzzy_match(*[x for df, c in zip(_parts(t), "sm", strict=True) for x in (df, c)], 0.8).withColumn("score", F.round("score", 6)))
query("qlt_10_best_match", PLAIN_NAMES + ", g AS (SELECT l, r, ln, rn, list_distinct(string_split(ln, '')) AS x, list_distinct(string_split(rn, '')) AS y FROM b), sc AS (SELECT l, r, CASE WHEN ln = rn THEN 1.0 WHEN contains(ln, rn) OR contains(rn, ln) THEN 0.8 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END::DOUBLE AS score FROM g) SELECT l AS \"left\", r AS \"right\", round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS i FROM sc WHERE score >= 0.7) WHERE i = 1")(lambda t: quality.best_match(*[x for df, c in zip(_parts(t), "sm", strict=True) for x in (df, c)]).withColumn("score", F.round("score", 6)))


def _following(t):
    """Each order and its customer's next one."""
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select(C("o_orderkey").alias("src"), F.lead("o_orderkey").over(by_customer).alias("dst")).filter("dst is not null")


query("qlt_11_clusters", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster FROM orders")(lambda t: lineage.clusters(_following(t).toDF("a", "b"), t.orders.select(C("o_orderkey").alias("node"))))
query("qlt_12_fingerprint", "SELECT sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) AS fingerprint, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")(lambda t: quality.duplicate_texts(t.documents.filter("text is not null"), "doc_id", "text"))
query("qlt_13_lineage_edges", "SELECT DISTINCT 'flow' || c_nationkey AS flow, c_name AS output, 'next' || c_nationkey AS to_flow, CASE WHEN c_custkey % 3 = 0 THEN 'fingerprint' WHEN c_custkey % 2 = 0 THEN 'exact' ELSE 'name' END AS how FROM customer")(lambda t: lineage.match_edges(t.customer.select(F.concat(F.lit("flow"), C("c_nationkey")).alias("flow"), C("c_name").alias("name"), F.sha2("c_name", 256).alias("fingerprint")), t.customer.select(F.concat(F.lit("next"), C("c_nationkey")).alias("flow"), F.when(C("c_custkey") % 3 == 0, "renamed").when(C("c_custkey") % 2 == 0, C("c_name")).otherwise(F.upper("c_name")).alias("name"), F.when(C("c_custkey") % 3 == 0, F.sha2("c_name", 256)).alias("fingerprint"))))
#: A tree over all customer keys.
EDGES = "(SELECT DISTINCT c_custkey // 2 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 0)"


def edges(t):
    return t.customer.filter("c_custkey > 0").select(F.floor(C("c_custkey") / 2).alias("src"), C("c_custkey").cast("long").alias("dst"))


query("qlt_14_layers", f"WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS layer UNION ALL SELECT dst, layer + 1 FROM w JOIN {EDGES} e ON src = node) SELECT node, layer FROM w")(lambda t: lineage.layers(edges(t)))
query("qlt_15_chains", "SELECT head, node, place FROM (SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS head, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")(lambda t: lineage.chains(_following(t)))
query("qlt_16_isolated", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda t: lineage.isolated(t.customer.select(C("c_custkey").alias("node")), t.orders.select(C("o_custkey").alias("src"), C("o_custkey").alias("dst"))))
query("qlt_17_ends", f"SELECT DISTINCT src AS node, 'source' AS role FROM {EDGES} WHERE src NOT IN (SELECT dst FROM {EDGES}) UNION ALL SELECT DISTINCT dst, 'sink' FROM {EDGES} WHERE dst NOT IN (SELECT src FROM {EDGES})")(lambda t: lineage.sources_and_sinks(edges(t)))
query("qlt_20_provenance", "SELECT nation, array_to_string(list_sort(list_distinct(list(s))), ',') AS sources FROM (SELECT c_nationkey AS nation, 'customer' AS s FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY 1")(lambda t: lineage.provenance(reshape.union_named({"customer": t.customer.select(C("c_nationkey").alias("nation")), "supplier": t.supplier.select(C("s_nationkey").alias("nation"))}), "nation").withColumn("sources", F.array_join("sources", ",")))


def _refresh(t):
    path = shared(t)
    orders = t.orders.select("o_orderkey", "o_orderdate", C("o_totalprice").alias("v"))
    incremental.first_load(orders, path, "o_orderdate", "year")
    changed = orders.withColumn("v", C("v") + 1).filter("o_orderdate < date '1998-01-01'")
    return incremental.refresh(changed, path, "o_orderdate", datetime.date(1997, 6, 1), "year", 1, 3).select("o_orderkey", r(C("v"), 2).alias("v"))


query("inc_01_refresh", "SELECT o_orderkey, round(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS v FROM orders WHERE year(o_orderdate) >= 1995")(_refresh)


def _retained(t):
    """What is left of a table after two refreshes that delete expired years: the files themselves are read."""
    path = shared(t)
    orders = t.orders.select("o_orderkey", "o_orderdate", C("o_totalprice").alias("v"))
    incremental.first_load(orders, path, "o_orderdate", "year")
    for _ in range(2):  # a rerun changes nothing
        incremental.refresh(orders.filter("o_orderdate < date '1998-01-01'"), path, "o_orderdate", datetime.date(1997, 6, 1), "year", 1, 3, drop=True)
    return t.spark.read.parquet(path).select("o_orderkey", r(C("v"), 2).alias("v"))


query("inc_01_retention", "SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders WHERE year(o_orderdate) >= 1995")(_retained)


def _items(t):
    return t.documents.select("doc_id", C("n_chars").alias("stamp"), F.sha2("text", 256).alias("digest"))


def _manifest(t):
    return _items(t).filter("doc_id % 4 <> 0").withColumn("stamp", C("stamp") - (C("doc_id") % 4 > 1).cast("int")).withColumn("digest", F.when(C("doc_id") % 4 == 3, "old").otherwise(C("digest")))


query("inc_03_changed", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'same' WHEN 2 THEN 'touched' ELSE 'changed' END AS status FROM documents")(lambda t: incremental.changed(_items(t), _manifest(t), "doc_id", "stamp", "digest").select("doc_id", "status"))
query("inc_04_manifest", "SELECT doc_id, n_chars AS stamp FROM documents")(lambda t: incremental.update_manifest(_manifest(t), _items(t), "doc_id", "stamp").select("doc_id", "stamp"))


def _versions(t):
    old = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    new = old.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(C("c_custkey") % 3 == 0, C("c_acctbal") + 1).otherwise(C("c_acctbal"))).withColumn("c_custkey", F.when(C("c_custkey") % 11 == 0, -C("c_custkey") - 1).otherwise(C("c_custkey")))
    return old, new


query("inc_05_merge", "SELECT c_custkey, round(c_acctbal + 1, 2) AS c_acctbal, c_mktsegment, CAST(c_mktsegment <> 'NEW' AS INT) AS conflicts FROM customer")(lambda t: incremental.merge(_versions(t)[0], _versions(t)[0].withColumn("c_acctbal", C("c_acctbal") + 1).withColumn("c_mktsegment", F.lit("NEW")), "c_custkey", ["c_mktsegment"]).select("c_custkey", r(C("c_acctbal"), 2).alias("c_acctbal"), "c_mktsegment", "conflicts"))
def _observed(t):
    """Rows, additions and conflicts of a merge, counted by the pass that writes it."""
    old, new = _versions(t)
    seen = Observation("merge")
    path = shared(t)
    incremental.merge(old, new, "c_custkey", ["c_acctbal"], seen).write.parquet(path)
    counts = seen.get
    return t.spark.read.parquet(path).agg(one().alias("rows"), F.sum("conflicts").cast("long").alias("conflicts")).select("rows", "conflicts", *[F.lit(counts[c]).cast("long").alias("seen_" + c) for c in ("rows", "added", "kept", "conflicts")])


MERGED = "(SELECT o.c_custkey AS o, n.k AS k, CASE WHEN o.c_custkey = n.k AND n.v <> o.c_acctbal THEN 1 ELSE 0 END AS x FROM customer o FULL JOIN (SELECT CASE WHEN c_custkey % 11 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 7 <> 0) n ON o.c_custkey = n.k)"
query("inc_05_observed", f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(x) AS BIGINT) AS conflicts, CAST(count(*) AS BIGINT) AS seen_rows, CAST(count(*) FILTER (WHERE o IS NULL) AS BIGINT) AS seen_added, CAST(count(*) FILTER (WHERE k IS NULL) AS BIGINT) AS seen_kept, CAST(sum(x) AS BIGINT) AS seen_conflicts FROM {MERGED}")(_observed)
query("inc_06_diff", "WITH n AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS k, CASE WHEN c_custkey % 3 = 0 THEN 'm' ELSE 'u' END AS s FROM customer WHERE c_custkey % 7 <> 0) SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'added' WHEN k IS NULL THEN 'removed' WHEN s = 'm' THEN 'modified' ELSE 'unchanged' END AS status FROM customer FULL JOIN n ON c_custkey = k")(lambda t: incremental.versions(*_versions(t), ["c_custkey"]))


#: A pattern, as a stream's path names a folder or a pattern and the table may be one file.
EVENTS = "event[s].parquet"


def stream(t):
    """The events table as a stream."""
    kind = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    return t.spark.readStream.schema(kind).parquet(f"{t.sf_dir}/{EVENTS}").withColumn("ts", C("ts").cast("timestamp"))


#: Rules are dealt to all event types in turn.
CYCLE = ((">", 90.0), ("<", 1.0), (">=", 95.0), ("!=", 1000.0))


def _rules(t):
    """A rule for each event type; the types are a handful, whatever the number of events."""
    number = F.row_number().over(Window.orderBy("event_type")) - 1
    dealt = F.array(*[F.struct(F.lit(o).alias("operator"), F.lit(v).alias("threshold")) for o, v in CYCLE])
    types = t.events.select("event_type").distinct().withColumn("i", number).withColumn("rule_", F.get(dealt, (F.col("i") % len(CYCLE)).cast("int")))
    return types.select(F.concat(F.lit("r"), C("i")).alias("rule"), C("event_type").alias("key"), "rule_.operator", "rule_.threshold")


RULES = "(SELECT event_id, ts, 'r' || (i - 1) AS rule FROM events JOIN (SELECT event_type AS k, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)) ON event_type = k WHERE (i % 4 = 1 AND value > 90) OR (i % 4 = 2 AND value < 1) OR (i % 4 = 3 AND value >= 95) OR (i % 4 = 0 AND value <> 1000))"


def _run(t, df, keys=None):
    base = shared(t)
    return jobs.run_updates(df, base + "/out", base + "/state", keys) if keys else jobs.run_once(df, base + "/out", base + "/state")


def _raised(t):
    return jobs.alerts(stream(t).select("event_id", "event_type", "value", "ts"), _rules(t), "event_type", "value")


def _run_silenced(t, silence):
    base = shared(t)
    return jobs.run_once(jobs.silenced(_raised(t), silence), base + "/out", base + "/state", rocksdb=True).select("rule", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


query("stm_01_alerts", f"SELECT event_id, rule FROM {RULES}")(lambda t: _run(t, jobs.alerts(stream(t).select("event_id", "event_type", "value", "ts"), _rules(t), "event_type", "value").select("event_id", "rule")))
query("stm_02_throttled", f"SELECT rule, CAST(count(DISTINCT date_trunc('day', ts)) AS BIGINT) AS n FROM {RULES} GROUP BY 1")(lambda t: _run(t, jobs.throttled(jobs.alerts(stream(t).select("event_id", "event_type", "value", "ts"), _rules(t), "event_type", "value"), "daily").select("rule", "alert_period")).groupBy("rule").agg(one().alias("n")))
query("stm_02_hourly", f"SELECT rule, CAST(count(DISTINCT date_trunc('hour', ts)) AS BIGINT) AS n FROM {RULES} GROUP BY 1")(lambda t: _run(t, jobs.throttled(_raised(t), "hourly").select("rule", "alert_period")).groupBy("rule").agg(one().alias("n")))
query("stm_02_once", f"SELECT rule, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS at FROM {RULES} GROUP BY 1")(lambda t: _run_silenced(t, None))
query("stm_02_silenced", f"WITH RECURSIVE a AS MATERIALIZED (SELECT rule, ts FROM {RULES}), s AS (SELECT rule, min(ts) AS ts FROM a GROUP BY 1 UNION ALL SELECT s.rule, min(a.ts) FROM s JOIN a ON a.rule = s.rule AND a.ts >= s.ts + INTERVAL 1 DAY GROUP BY s.rule, s.ts) SELECT rule, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM s")(lambda t: _run_silenced(t, "1 DAY"))
query("stm_03_metric", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda t: _run(t, jobs.metric(stream(t), "ts", "1 hour", ["event_type"], "value"), ["window_start", "event_type"]).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("h"), "event_type", "n", F.round("total", 4).alias("total")))
query("stm_04_breaches", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS d, event_type, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE value > 90) AS BIGINT) AS breaches FROM events GROUP BY 1, 2")(lambda t: _run(t, jobs.breaches(stream(t), "ts", "1 day", ["event_type"], "value", 90.0), ["window_start", "event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("d"), "event_type", "items", "breaches"))


def _load(t):
    base = shared(t)
    kind = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    for _ in range(2):  # the second call finds nothing new
        jobs.load_new(t.spark, f"{t.sf_dir}/{EVENTS}", base + "/out", base + "/state", kind)
    return t.spark.read.parquet(base + "/out").select("event_id", "value")


query("stm_05_load_new", "SELECT event_id, value FROM events")(_load)

query("udf_01_real", "SELECT p_partkey, p_retailprice * 2 AS v FROM part")(lambda t: t.part.select("p_partkey", scripts.script("real", lambda s: s * 2, C("p_retailprice")).alias("v")))
query("udf_02_int", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS v FROM part")(lambda t: t.part.select("p_partkey", scripts.script("int", lambda s: s + 1, C("p_size")).alias("v")))
query("udf_03_bool", "SELECT p_partkey, p_size > 10 AS v FROM part")(lambda t: t.part.select("p_partkey", scripts.script("bool", lambda s: s > 10, C("p_size")).alias("v")))
query("udf_04_str", "SELECT p_partkey, upper(p_name) AS v FROM part")(lambda t: t.part.select("p_partkey", scripts.script("str", lambda s: s.str.upper(), C("p_name")).alias("v")))
query("udf_05_table_step", "SELECT o_custkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS d FROM orders")(lambda t: t.orders.select("o_custkey", "o_totalprice").transform(scripts.table_step(lambda p: p.assign(d=p.o_totalprice - p.groupby("o_custkey", dropna=False).o_totalprice.transform("mean"))[["o_custkey", "d"]], "o_custkey long, d double", ["o_custkey"], together=True)).select("o_custkey", F.round("d", 7).alias("d")))


def _predict(t):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="x").transform(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    model = LinearRegression(featuresCol="x", labelCol="l_extendedprice", solver="normal").fit(rows)
    return scripts.predict(model, rows).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("v"))


query("udf_06_predict", "SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + l_quantity * (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem), 2) AS v FROM lineitem")(_predict)
query("udf_07_aggregate", "SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS v FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_orderstatus").agg(scripts.aggregate(lambda s: float(s.max() - s.min()))(C("o_totalprice")).alias("v")))


def _flow(t):
    flow = Flow(orders=t.orders, customer=t.customer)
    flow.step("open", "orders", filters.values("o_orderstatus", ["O"]), columns.keep("o_orderkey", "o_custkey", "o_totalprice"))
    flow.combine("named", "open", "customer", lambda a, b: joins.join(a, b, [("o_custkey", "c_custkey")], "inner", ["c_mktsegment"]))
    flow.step("by_segment", "named", lambda df: df.groupBy("c_mktsegment").agg(one().alias("n"), r(F.sum("o_totalprice"), 2).alias("v")))
    return flow.outputs()["by_segment"]


query("udf_08_flow", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1")(_flow)

CUST = {"c_custkey": "integer", "c_name": "string", "c_acctbal": "real"}
CUST_SQL = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _cust(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


def _csv(t):
    path = shared(t)
    writers.save_csv(_cust(t), path)
    return readers.csv(t.spark, path, CUST)


query("src_01_csv", CUST_SQL)(_csv)


def _json(t):
    path = shared(t)
    _cust(t).write.json(path)
    return readers.json(t.spark, path, CUST, multi_line=False)


query("src_03_json", CUST_SQL)(_json)


def _json_list(t):
    """One file for each ten thousand keys, a list of its records."""
    path = shared(t)
    record = F.struct("c_custkey", "c_name", "c_acctbal")
    lists = _cust(t).groupBy(F.floor(C("c_custkey") / 10_000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    lists.write.partitionBy("part").text(path)
    return readers.json(t.spark, path, CUST, multi_line=True).drop("part")


query("src_03_json_list", CUST_SQL)(_json_list)


def _geojson(t):
    path = shared(t)
    point = F.struct(F.lit("Point").alias("type"), F.array(C("c_custkey").cast("double"), C("c_nationkey").cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(C("c_name").alias("name")).alias("properties"), point.alias("geometry"))
    lists = t.customer.groupBy(F.floor(C("c_custkey") / 10_000).alias("part")).agg(F.collect_list(feature).alias("features"))
    lists.write.partitionBy("part").json(path)
    return readers.geojson(t.spark, path).select("name", F.get_json_object("geometry", "$.type").alias("kind"))


query("src_04_geojson", "SELECT c_name AS name, 'Point' AS kind FROM customer")(_geojson)


def _xml(t):
    path = shared(t)
    _cust(t).write.format("xml").option("rowTag", "row").save(path)
    return readers.xml(t.spark, path, "row", CUST)


query("src_05_xml", CUST_SQL)(_xml)


def _wildcard(t):
    path = shared(t)
    _cust(t).repartition(3, "c_custkey").write.option("header", True).csv(path)
    return readers.wildcard(t.spark, path, ".csv", ",", CUST).filter("file_name like 'part-%'").drop("file_name")


query("src_06_wildcard", CUST_SQL)(_wildcard)
query("src_07_object_store", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")(lambda t: readers.stored(t.spark, f"{t.sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"))


def _jdbc(t):
    """Written, and read back in four key ranges with the filter in the database.

    The database is embedded in a local session; on a cluster spark.tallyloom.jdbc.database must name one that every
    executor reaches.
    """
    name = f"customer_{uuid.uuid4().hex}"
    where = {"kind": "derby", "host": "", "database": t.spark.conf.get("spark.tallyloom.jdbc.database", "memory:tallyloom;create=true"), "table": name}
    writers.save_jdbc(_cust(t), types="c_name VARCHAR(200)", **where)
    ends = _cust(t).agg(F.min("c_custkey"), F.max("c_custkey")).first()
    split = ("c_custkey", ends[0] or 0, (ends[1] or 0) + 1, 4)
    return readers.jdbc(t.spark, split=split, **where).filter("c_acctbal > 0")


query("src_08_jdbc", CUST_SQL + " WHERE c_acctbal > 0")(_jdbc)


def _catalog(t):
    name = f"catalog_{uuid.uuid4().hex}"
    writers.save_table(_cust(t), name)
    return readers.catalog(t.spark, f"spark_catalog.default.{name}")


def _documents(t):
    """Customers as documents, scanned with filters that the source takes over."""
    path = shared(t)
    documents.write(t.customer.select("c_custkey", "c_name", "c_acctbal", F.struct("c_nationkey", "c_mktsegment").alias("home")), path, "customer", rows_per_file=1000)
    found = documents.read(t.spark, path, "customer", "c_custkey long, c_name string, c_acctbal double, home struct<c_nationkey:int,c_mktsegment:string>")
    return found.filter("c_acctbal > 0 and c_custkey >= 100 and home.c_nationkey <> 3").select("c_custkey", "c_name", "c_acctbal", "home.c_mktsegment")


query("src_09_documents", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_custkey >= 100 AND c_nationkey <> 3")(_documents)
query("src_10_catalog", CUST_SQL)(_catalog)


def _custom(t):
    readers.publish(t.customer, "published_customer")
    return readers.custom_sql(t.spark, "SELECT c_custkey, c_acctbal FROM published_customer WHERE c_acctbal > :least AND c_mktsegment = :segment", {"least": 5000, "segment": "BUILDING"})


query("src_12_custom_sql", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")(_custom)
query("src_13_extract", "SELECT o_orderkey, o_totalprice FROM orders")(lambda t: readers.extract(t.spark, f"{t.sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"))
query("src_14_inline", "SELECT c_custkey, label FROM customer JOIN (VALUES (0, 'zero'), (1, 'one')) v(k, label) ON c_nationkey = k")(lambda t: t.customer.join(readers.inline(t.spark, [(0, "zero"), (1, "one")], {"k": "integer", "label": "string"}), C("c_nationkey") == C("k")).select("c_custkey", "label"))
query("src_15_guarded", "SELECT c_custkey, c_name, c_acctbal FROM customer")(lambda t: readers.guarded(t.spark, lambda: readers.extract(t.spark, f"{t.sf_dir}/no_such_table.parquet"), CUST).unionByName(_cust(t)))


def _permissive(t):
    path = shared(t)
    writers.save_csv(_cust(t).withColumn("c_custkey", F.when(C("c_custkey") % 10 == 0, "none").otherwise(C("c_custkey").cast("string"))), path)
    return readers.permissive(t.spark, path, CUST).withColumn("broken", C("_corrupt_record").isNotNull()).drop("_corrupt_record")


query("src_15_permissive", "SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS c_custkey, c_name, c_acctbal, c_custkey % 10 = 0 AS broken FROM customer")(_permissive)
query("src_16_typed", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, try_cast(o_orderstatus AS BIGINT) AS o_orderstatus FROM orders")(lambda t: readers.typed(t.orders, {"o_orderkey": "integer", "o_custkey": "string", "o_orderstatus": "integer"}))
query("src_17_published", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders")(lambda t: (readers.publish(t.orders, "published_orders"), readers.catalog(t.spark, "published_orders").agg(one().alias("n")))[1])


def _table(t):
    name = f"saved_{uuid.uuid4().hex}"
    writers.save_table(_cust(t), name)
    return t.spark.table(name)


query("snk_01_table", CUST_SQL)(_table)


def _ddl(t):
    name = f"made_{uuid.uuid4().hex}"
    writers.create_table(t.spark, name, CUST, {"c_custkey"})
    _cust(t).write.insertInto(name)
    return t.spark.table(name)


query("snk_02_ddl", CUST_SQL)(_ddl)
query("snk_03_csv", CUST_SQL)(_csv)


def _outputs(t):
    base, upstream = shared(t), _cust(t).filter("c_acctbal > 0")
    writers.save_outputs({"a": (upstream, "parquet", base + "/a"), "b": (upstream.groupBy().agg(one().alias("n")), "csv", base + "/b")}, [upstream])
    return t.spark.read.parquet(base + "/a").crossJoin(readers.csv(t.spark, base + "/b", {"n": "integer"}))  # one row


query("snk_04_outputs", "SELECT c_custkey, c_name, c_acctbal, CAST(count(*) OVER () AS BIGINT) AS n FROM customer WHERE c_acctbal > 0")(_outputs)
