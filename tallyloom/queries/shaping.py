"""Columns, cleaning, filters, sorting, sets and nested values."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import clean, columns, filters, reshape, sorting

from .registry import query, r, scalar

C = F.col

def _named(t):
    return t.customer.select("c_custkey", "c_name", "c_nationkey")


query("prj_01_rename", "SELECT c_custkey AS k, c_name AS customer, c_nationkey FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.rename({"c_custkey": "k", "c_name": "customer"})))
query("prj_02_remove", "SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.remove("c_nationkey")))
query("prj_03_keep", "SELECT c_custkey, c_mktsegment FROM customer")(lambda t: t.customer.transform(columns.keep("c_custkey", "c_mktsegment")))
query("prj_04_duplicate", "SELECT *, c_name AS copy FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.duplicate("c_name", "copy")))
query("prj_05_reorder", "SELECT c_name, c_custkey, c_nationkey FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.reorder("c_name")))
query("prj_06_change_type", "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, try_cast(o_orderstatus AS BIGINT) AS s FROM orders")(lambda t: t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"), C("o_orderstatus").alias("s")).transform(columns.change_type({"p": "bigint", "s": "bigint"})))
query("prj_07_add", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")(lambda t: t.lineitem.transform(columns.add_column("revenue", r(C("l_extendedprice") * (1 - C("l_discount"))))).select("l_orderkey", "l_linenumber", "revenue"))
query("prj_08_conditional", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS class FROM part")(lambda t: t.part.transform(columns.conditional("class", [(C("p_size") > 40, "large"), (C("p_size") > 20, "medium")], "small")).select("p_partkey", "class"))
query("prj_09_split", "SELECT p_partkey, string_split(p_brand, '#')[1] AS p_brand_1, string_split(p_brand, '#')[2] AS p_brand_2 FROM part")(lambda t: t.part.select("p_partkey", "p_brand").transform(columns.split_by("p_brand", "#")).drop("p_brand"))
query("prj_10_split_at", "SELECT p_partkey, substr(p_brand, 1, 2) AS p_brand_1, substr(p_brand, 3, 3) AS p_brand_2, substr(p_brand, 6) AS p_brand_3 FROM part")(lambda t: t.part.select("p_partkey", "p_brand").transform(columns.split_at("p_brand", [0, 2, 5])).drop("p_brand"))
query("prj_11_merge", "SELECT c_nationkey, c_custkey || '-' || c_name AS label FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.merge(["c_custkey", "c_name"], "label", "-")))
query("prj_12_combined", "SELECT *, c_name || ', ' || c_nationkey AS both FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.combined(["c_name", "c_nationkey"], "both")))
query("prj_13_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) * 10 AS i FROM customer")(lambda t: t.customer.transform(columns.index("i", ["c_acctbal", "c_custkey"], 10, 10)).select("c_custkey", "i"))
query("prj_15_aliases", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS o_orderstatus FROM orders")(lambda t: t.orders.transform(columns.aliases("o_orderstatus", {"O": "open", "F": "final"})).select("o_orderkey", "o_orderstatus"))
query("prj_16_set", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'IN' ELSE 'OUT' END AS member, CASE WHEN c_acctbal > 5000 THEN 'IN' ELSE 'OUT' END AS rich FROM customer")(lambda t: t.customer.transform(columns.set_column("member", "c_mktsegment", ["BUILDING", "MACHINERY"])).transform(columns.set_column("rich", condition=C("c_acctbal") > 5000)).select("c_custkey", "member", "rich"))
query("prj_17_group", "SELECT c_custkey, CASE WHEN c_custkey IN (1, 2, 3) THEN 'first' WHEN c_custkey IN (4, 5) THEN 'second' ELSE 'Other' END AS g FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).transform(columns.group_column("g", "c_custkey", {"first": [1, 2, 3], "second": [4, 5]})).select("c_custkey", "g"))
query("prj_18_large_group", "SELECT c_custkey, CASE WHEN c_custkey <= 300 THEN 'g' || (c_custkey % 3) ELSE 'Other' END AS g FROM customer")(lambda t: t.customer.transform(columns.group_column("g", "c_custkey", {f"g{i}": [k for k in range(301) if k % 3 == i] for i in range(3)})).select("c_custkey", "g"))
query("prj_19_combined_group", "SELECT o_orderkey, year(o_orderdate) || ' | ' || month(o_orderdate) || ' | ' || o_orderstatus AS g FROM orders")(lambda t: t.orders.transform(columns.combined_group("g", F.year("o_orderdate"), F.month("o_orderdate"), "o_orderstatus")).select("o_orderkey", "g"))
query("prj_20_bin", "SELECT p_partkey, CAST(floor(p_retailprice / 250) * 250 AS DOUBLE) AS bin FROM part")(lambda t: t.part.transform(columns.bin_column("bin", "p_retailprice", 250)).select("p_partkey", C("bin").cast("double").alias("bin")))
query("prj_21_derive", "SELECT o_orderkey, CAST(quarter(o_orderdate) AS BIGINT) AS qr, CAST(date_trunc('month', o_orderdate) AS DATE) AS tmn FROM orders")(lambda t: t.orders.transform(columns.derive("qr", "o_orderdate", "qr")).transform(columns.derive("tmn", "o_orderdate", "tmn")).select("o_orderkey", C("qr").cast("long").alias("qr"), "tmn"))
scalar("prj_22_format", "lineitem", "l_orderkey", lambda: columns.formatted(C("l_quantity"), "0.0%"), "format('{:.1f}%', l_quantity * 100)")
scalar("prj_23_magnitude", "orders", "o_orderkey", lambda: columns.magnitude(F.floor(C("o_totalprice")) * 1000.0, 3), "CASE WHEN floor(o_totalprice) >= 1000000 THEN format('{:.3f}B', floor(o_totalprice) / 1e6) WHEN floor(o_totalprice) >= 1000 THEN format('{:.3f}M', floor(o_totalprice) / 1e3) ELSE format('{:.3f}K', floor(o_totalprice)) END")
query("prj_25_coerce", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS BIGINT) AS k FROM orders")(lambda t: t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), C("o_custkey").cast("string").alias("k")).transform(columns.coerce({"d": "date", "k": "bigint"})))


def X(key, step, sql, name="text"):
    query(key, f"SELECT doc_id, {sql} AS {name} FROM documents")(lambda t: t.documents.transform(step()).select("doc_id", name))


X("cln_01_replace", lambda: clean.replace_value("source", "src1", "first"), "CASE WHEN source = 'src1' THEN 'first' ELSE source END", "source")
query("cln_02_replace_nulls", "SELECT d.doc_id, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")(lambda t: t.documents.join(t.labels, "doc_id", "left").transform(clean.replace_nulls({"toxic": -1})).select("doc_id", "toxic"))
X("cln_03_trim", lambda: clean.trim("text"), "trim(text, ' ')")
X("cln_04_clean", lambda: clean.clean("text"), r"regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')")
X("cln_05_upper", lambda: clean.upper("lang"), "upper(lang)", "lang")
X("cln_06_lower", lambda: clean.lower("source"), "lower(source)", "source")
X("cln_07_proper", lambda: clean.proper("lang"), "upper(lang[1]) || lower(lang[2:])", "lang")
X("cln_08_remove_kind", lambda: clean.remove_kind("numbers", "text"), r"regexp_replace(text, '\p{N}', '', 'g')")
query("cln_09_fill_down", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")(lambda t: t.conversations.withColumn("asked", F.when(C("role") == "user", C("text"))).transform(clean.fill_down(["asked"], ["turn"], ["conv_id"])).select("conv_id", "turn", "asked"))
query("cln_10_fill_up", "SELECT conv_id, turn, first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS answer FROM conversations")(lambda t: t.conversations.withColumn("answer", F.when(C("role") == "assistant", C("text"))).transform(clean.fill_up(["answer"], ["turn"], ["conv_id"])).select("conv_id", "turn", "answer"))
URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END"


def _urgent(t):
    return t.orders.select("o_orderkey", F.when(C("o_orderpriority") == "1-URGENT", C("o_totalprice")).alias("price"))


query("cln_09_fill_down_all", f"SELECT o_orderkey, last_value({URGENT} IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM orders")(lambda t: _urgent(t).transform(clean.fill_down(["price"], ["o_orderkey"])))
query("cln_10_fill_up_all", f"SELECT o_orderkey, first_value({URGENT} IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM orders")(lambda t: _urgent(t).transform(clean.fill_up(["price"], ["o_orderkey"])))
X("cln_11_group_replace", lambda: clean.group_replace("lang", {"roman": ["fr", "es"], "german": ["de", "en"]}), "CASE WHEN lang IN ('fr', 'es') THEN 'roman' WHEN lang IN ('de', 'en') THEN 'german' ELSE lang END", "lang")
X("cln_12_extract", lambda: clean.extract_values("text", "[a-z0-9.]+@[a-z0-9.]+", "mail"), "nullif(regexp_extract(text, '[a-z0-9.]+@[a-z0-9.]+'), '')", "mail")
scalar("cln_13_delimiters", "pages", "page_id", lambda: F.concat_ws(";", clean.text_before(C("url"), "://"), clean.text_between(C("url"), "://", "/")), "string_split(url, '://')[1] || ';' || string_split(substr(url, instr(url, '://') + 3), '/')[1]")
scalar("cln_14_pad", "customer", "c_custkey", lambda: F.concat(clean.pad_start(C("c_custkey").cast("string"), 8, "0"), clean.pad_end(C("c_mktsegment"), 12, ".")), "lpad(CAST(c_custkey AS VARCHAR), 8, '0') || rpad(c_mktsegment, 12, '.')")
query("cln_15_remove_errors", "SELECT event_id, try_cast(event_type[1] || '1' AS BIGINT) AS n FROM events WHERE try_cast(event_type[1] || '1' AS BIGINT) IS NOT NULL UNION ALL SELECT event_id, CAST(user_id AS BIGINT) FROM events WHERE user_id % 2 = 0")(lambda t: t.events.select("event_id", F.when(C("user_id") % 2 == 0, C("user_id").cast("string")).otherwise("x").alias("n")).transform(clean.remove_errors({"n": "bigint"})))
query("cln_16_replace_errors", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id ELSE -1 END AS n FROM events")(lambda t: t.events.select("event_id", F.when(C("user_id") % 2 == 0, C("user_id").cast("string")).otherwise("x").alias("n")).transform(clean.replace_errors({"n": "bigint"}, -1)))
scalar("cln_17_try_otherwise", "orders", "o_orderkey", lambda: clean.try_otherwise(C("o_orderstatus").try_cast("int"), C("o_custkey")), "o_custkey")
query("cln_18_parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value FROM events")(lambda t: t.events.transform(clean.parse_json("props", "map<string,string>", "p")).select("event_id", F.element_at(F.map_values("p"), 1).alias("first_value")))
scalar("cln_19_parse_xml", "customer", "c_custkey", lambda: F.from_xml(F.concat(F.lit("<r><name>"), C("c_name"), F.lit("</name></r>")), "name string")["name"], "c_name")
query("cln_20_regex_match", "SELECT page_id, regexp_matches(html, '<h1[^>]*>') AS h FROM pages")(lambda t: t.pages.transform(clean.regex_match("html", "<h1[^>]*>", "h")).select("page_id", "h"))
query("cln_21_regex_extract", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")(lambda t: t.pages.transform(clean.regex_extract("html", "<title>([^<]*)</title>", "title")).select("page_id", "title"))
query("cln_22_regex_replace", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS html FROM pages")(lambda t: t.pages.transform(clean.regex_replace("html", "<[^>]+>", " ")).select("page_id", "html"))
query("cln_23_blank_rows", "SELECT toxic, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL OR quality IS NOT NULL")(lambda t: t.documents.join(t.labels, "doc_id", "left").select("toxic", "quality").transform(clean.remove_blank_rows()))


def L(key, step, where):
    query(key, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {where}")(lambda t: t.orders.transform(step()).select("o_orderkey", "o_totalprice"))


L("flt_01_keep", lambda: filters.keep_rows(C("o_totalprice") > 200000), "o_totalprice > 200000")
L("flt_02_remove", lambda: filters.remove_rows(F.nullif(C("o_orderstatus"), F.lit("P")) == "O"), "coalesce(NOT nullif(o_orderstatus, 'P') = 'O', true)")
L("flt_03_values", lambda: filters.values("o_orderstatus", ["O", "P"]), "o_orderstatus IN ('O', 'P')")
L("flt_04_exclude", lambda: filters.exclude("o_orderstatus", ["O"]), "o_orderstatus <> 'O' OR o_orderstatus IS NULL")
L("flt_05_range", lambda: filters.in_range("o_totalprice", 1000, 50000), "o_totalprice BETWEEN 1000 AND 50000")
query("flt_06_nulls", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")(lambda t: t.documents.join(t.labels, "doc_id", "left").transform(filters.nulls("toxic")).select("doc_id"))
L("flt_07_contains", lambda: filters.wildcard("o_orderpriority", "URG"), "contains(o_orderpriority, 'URG')")
L("flt_08_wildcard", lambda: filters.wildcard("o_orderpriority", "1-", "starts"), "starts_with(o_orderpriority, '1-')")
L("flt_09_relative_dates", lambda: filters.relative_dates("o_orderdate", "month", datetime.date(1996, 6, 15), last=3, include_anchor=False), "CAST(o_orderdate AS DATE) >= date '1996-03-01' AND CAST(o_orderdate AS DATE) < date '1996-06-01'")
L("flt_10_top_members", lambda: filters.top_members("o_custkey", F.round(F.sum("o_totalprice"), 2), 10), "o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 10)")
L("flt_11_context", lambda: filters.context(filters.values("o_orderstatus", ["F"]), filters.top_members("o_custkey", F.count(F.lit(1)), 5)), "o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 5)")
L("flt_12_dataset", lambda: filters.dataset({"o_orderstatus": ["O", "F"]}, {"o_orderpriority": ["5-LOW"]}, {"o_totalprice": (None, 100000)}), "o_orderstatus IN ('O', 'F') AND o_orderpriority <> '5-LOW' AND o_totalprice <= 100000")
L("flt_13_date_part", lambda: filters.date_part("o_orderdate", "year", [1995, 1997]), "year(o_orderdate) IN (1995, 1997)")
L("flt_14_group", lambda: filters.any_of(C("o_orderstatus") == "P", C("o_totalprice").between(1, 5000)), "o_orderstatus = 'P' OR o_totalprice BETWEEN 1 AND 5000")

query("srt_01_sort", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")(lambda t: t.orders.transform(sorting.sort("o_orderstatus", "-o_totalprice")).select("o_orderkey", "o_orderstatus", "o_totalprice"))
query("srt_02_by_measure", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS sort_key FROM orders GROUP BY 1")(lambda t: t.orders.transform(sorting.sort_by_measure("o_orderpriority", F.count(F.lit(1)))))
query("srt_03_manual", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS place FROM orders")(lambda t: t.orders.select("o_orderkey", sorting.manual_rank("o_orderstatus", ["P", "O"]).cast("long").alias("place")).orderBy("place"))
query("srt_04_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda t: t.orders.transform(sorting.top(25, "-o_totalprice", "o_orderkey")).select("o_orderkey", "o_totalprice"))
query("srt_05_bottom", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")(lambda t: t.orders.transform(sorting.bottom(25, "-o_totalprice", "-o_orderkey")).select("o_orderkey", "o_totalprice"))
query("srt_06_top_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")(lambda t: t.orders.transform(sorting.top_per_group(2, ["o_custkey"], "-o_totalprice", "o_orderkey")).select("o_custkey", "o_orderkey"))
query("srt_07_skip", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 100")(lambda t: t.orders.transform(sorting.skip(100, "o_orderdate", "o_orderkey")).select("o_orderkey"))
query("srt_08_remove_last", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC OFFSET 50")(lambda t: t.orders.transform(sorting.remove_last(50, "o_orderdate", "o_orderkey")).select("o_orderkey"))
query("srt_09_sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(md5('0:' || l_orderkey), 1, 8))::BIGINT % 1000000 < 100000")(lambda t: t.lineitem.transform(sorting.sample(0.1, "l_orderkey")).select("l_orderkey", "l_linenumber"))
query("srt_10_by_column", "SELECT monthname(o_orderdate) AS m, CAST(min(month(o_orderdate)) AS BIGINT) AS sort_key FROM orders GROUP BY 1")(lambda t: t.orders.select(F.date_format("o_orderdate", "MMMM").alias("m"), F.month("o_orderdate").cast("long").alias("n")).transform(sorting.sort_by_column("m", "n")))


def _two(t):
    return t.customer.select(C("c_nationkey").alias("nation"), C("c_acctbal").alias("bal"), C("c_mktsegment").alias("segment")), t.supplier.select(C("s_nationkey").alias("nation"), C("s_acctbal").alias("bal"))


query("set_01_union", "SELECT c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier")(lambda t: reshape.union(*_two(t)))
query("set_02_union_named", "SELECT c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment, 'customer' AS \"Table Names\" FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier")(lambda t: reshape.union_named(dict(zip(("customer", "supplier"), _two(t), strict=True))))
query("set_03_union_widened", "SELECT CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier")(lambda t: reshape.union_widened(t.customer.select(C("c_nationkey").alias("v")), t.supplier.select(C("s_acctbal").alias("v"))))
query("set_05_unpivot", "SELECT p_partkey, 'p_size' AS Attribute, CAST(p_size AS DOUBLE) AS Value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")(lambda t: t.part.select("p_partkey", C("p_size").cast("double").alias("p_size"), "p_retailprice").transform(reshape.unpivot(["p_partkey"], ["p_size", "p_retailprice"])))
query("set_06_unpivot_others", "SELECT c_custkey, 'c_name' AS Attribute, c_name AS Value FROM (SELECT c_custkey, c_name, c_nationkey FROM customer) UNION ALL SELECT c_custkey, 'region', CAST(c_nationkey AS VARCHAR) FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).select("c_custkey", "c_name", C("c_nationkey").cast("string").alias("region")).transform(reshape.unpivot(["c_custkey"], None)))
query("set_07_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")(lambda t: t.lineitem.transform(reshape.pivot(["l_returnflag"], "l_linestatus", F.round(F.sum("l_quantity"), 2), ["F", "O"])))
query("set_08_transpose", "SELECT 'n' AS key, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS A, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS N, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS R FROM lineitem")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).transform(reshape.transpose("l_returnflag")))
query("set_09_promote", "SELECT c_name AS header FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)")(lambda t: t.customer.select("c_custkey", "c_name").transform(reshape.promote_headers("c_custkey")).toDF("header"))
query("set_10_demote", "SELECT CAST(c_custkey AS VARCHAR) AS Column1, c_name AS Column2 FROM customer UNION ALL SELECT 'c_custkey', 'c_name'")(lambda t: t.customer.select("c_custkey", "c_name").transform(reshape.demote_headers()))
query("set_11_compare_keys", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'shared' END AS status FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 3 AS k FROM orders) b ON a.k = b.k")(lambda t: reshape.compare_keys(t.customer.select(C("c_custkey").alias("k")), t.orders.select((C("o_custkey") + 3).alias("k")), ["k"]))
query("arr_01_contains", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")(lambda t: t.customer.filter(reshape.list_contains("c_mktsegment", ["BUILDING", "FURNITURE"])).select("c_custkey"))
query("arr_02_expand_record", "SELECT c_custkey, c_name AS r_name, c_nationkey AS r_region FROM (SELECT c_custkey, c_name, c_nationkey FROM customer)")(lambda t: _named(t).select("c_custkey", F.struct(C("c_name").alias("name"), C("c_nationkey").alias("region")).alias("rec")).transform(reshape.expand_record("rec", "r_")))
query("arr_03_expand_list", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")(lambda t: t.part.select("p_partkey", F.split("p_type", " ").alias("word")).transform(reshape.expand_list("word")))
scalar("arr_04_to_json", "region", "r_regionkey", lambda: reshape.to_json_text(F.struct(C("r_name").alias("name"))), "'{\"name\":\"' || r_name || '\"}'")
