"""Text, number, date and logic calculations, each over every row of a table."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyloom.functions import dates, logic, numbers, text

from .registry import r, scalar

C = F.col


def P(key, value, sql):
    scalar(key, "part", "p_partkey", value, sql)


P("str_01_ascii", lambda: text.ascii_code(C("p_name")), "ascii(p_name)")
P("str_02_char", lambda: text.char(C("p_size") + 65), "chr(p_size + 65)")
P("str_03_contains", lambda: text.contains(C("p_type"), "brass", ignore_case=True), "contains(lower(p_type), 'brass')")
P("str_04_startswith", lambda: text.startswith(C("p_brand"), "Brand#1"), "starts_with(p_brand, 'Brand#1')")
P("str_05_endswith", lambda: text.endswith(C("p_brand"), "3"), "suffix(p_brand, '3')")
P("str_06_find", lambda: text.find(C("p_name"), "a", 3).cast("long"), "CAST(CASE WHEN instr(substr(p_name, 3), 'a') > 0 THEN instr(substr(p_name, 3), 'a') + 2 ELSE 0 END AS BIGINT)")
P("str_07_findnth", lambda: text.find_nth(C("p_name"), "r", 2).cast("long"), "CAST(CASE WHEN len(string_split(p_name, 'r')) > 2 THEN len(string_split(p_name, 'r')[1]) + len(string_split(p_name, 'r')[2]) + 2 ELSE 0 END AS BIGINT)")
P("str_08_left", lambda: text.left(C("p_name"), 4), "left(p_name, 4)")
P("str_09_right", lambda: text.right(C("p_name"), 4), "right(p_name, 4)")
P("str_10_mid", lambda: text.mid(C("p_name"), 3, 5), "substr(p_name, 3, 5)")
P("str_11_len", lambda: text.length(C("p_name")).cast("long"), "length(p_name)")
P("str_12_upper", lambda: text.upper(C("p_name")), "upper(p_name)")
P("str_13_lower", lambda: text.lower(C("p_type")), "lower(p_type)")
P("str_14_proper", lambda: text.proper(C("p_type")), "array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')")
P("str_15_trim", lambda: text.trim(F.concat(F.lit("  "), C("p_name"), F.lit("  "))), "p_name")
P("str_16_ltrim", lambda: text.ltrim(F.concat(F.lit("  "), C("p_name"), F.lit(" "))), "p_name || ' '")
P("str_17_rtrim", lambda: text.rtrim(F.concat(F.lit(" "), C("p_name"), F.lit("  "))), "' ' || p_name")
P("str_18_replace", lambda: text.replace(C("p_brand"), "Brand", "B"), "replace(p_brand, 'Brand', 'B')")
P("str_19_space", lambda: F.concat(text.space(C("p_size")), F.lit("|")), "repeat(' ', p_size) || '|'")
P("str_20_repeat", lambda: text.repeat(C("p_brand"), 2), "repeat(p_brand, 2)")
P("str_21_reverse", lambda: text.reverse(C("p_name")), "reverse(p_name)")
P("str_22_split", lambda: text.split(C("p_brand"), "#", -1), "string_split(p_brand, '#')[-1]")
P("str_23_concat", lambda: text.concat(C("p_brand"), F.lit("-"), C("p_type")), "p_brand || '-' || p_type")
P("str_24_regexp_match", lambda: text.regexp_match(C("p_brand"), "#[0-9]*5$"), "regexp_matches(p_brand, '#[0-9]*5$')")
P("str_25_regexp_extract", lambda: text.regexp_extract(C("p_brand"), "#([0-9])"), "nullif(regexp_extract(p_brand, '#([0-9])', 1), '')")
P("str_26_regexp_extract_nth", lambda: text.regexp_extract(C("p_brand"), "(Br)(and#)([0-9]+)", 3), "nullif(regexp_extract(p_brand, '(Br)(and#)([0-9]+)', 3), '')")
P("str_27_regexp_replace", lambda: text.regexp_replace(C("p_name"), "[aeiou]", "*"), "regexp_replace(p_name, '[aeiou]', '*', 'g')")


def N(key, value, sql, digits=6):
    scalar(key, "customer", "c_custkey", lambda: r(value(), digits), f"round(CAST({sql} AS DOUBLE), {digits})")




def BAL():
    return C("c_acctbal")


def KEY():
    return C("c_custkey").cast("double")


N("mth_01_abs", lambda: numbers.absolute(BAL()), "abs(c_acctbal)")
N("mth_02_ceiling", lambda: numbers.ceiling(BAL()), "ceil(c_acctbal)")
N("mth_03_floor", lambda: numbers.floor(BAL()), "floor(c_acctbal)")
N("mth_04_round", lambda: numbers.rounded(BAL()), "round(c_acctbal)")
N("mth_05_power", lambda: numbers.power(BAL() / 1000, 3), "pow(c_acctbal / 1000, 3)")
N("mth_06_sqrt", lambda: numbers.square_root(BAL()), "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END")
N("mth_07_square", lambda: numbers.square(BAL()), "c_acctbal * c_acctbal", 3)
N("mth_08_log", lambda: numbers.log(KEY(), 2.0) + numbers.log(KEY()), "ln(nullif(c_custkey, 0)) / ln(2) + log10(nullif(c_custkey, 0))")
N("mth_09_ln", lambda: numbers.ln(KEY()), "ln(nullif(c_custkey, 0))")
N("mth_10_exp", lambda: numbers.exp(BAL() / 10000), "exp(c_acctbal / 10000)")
N("mth_11_sign", lambda: numbers.sign(BAL()), "sign(c_acctbal)")
N("mth_12_pi", lambda: numbers.pi() * KEY(), "pi() * c_custkey")
N("mth_13_sin", lambda: numbers.sin(KEY()), "sin(c_custkey)")
N("mth_14_cos", lambda: numbers.cos(KEY()), "cos(c_custkey)")
N("mth_15_tan", lambda: numbers.tan(KEY() / 1000), "tan(c_custkey / 1000)", 3)
N("mth_16_acos", lambda: numbers.acos(BAL() / 10000), "CASE WHEN c_acctbal / 10000 BETWEEN -1 AND 1 THEN acos(c_acctbal / 10000) END")
N("mth_17_asin", lambda: numbers.asin(BAL() / 10000), "CASE WHEN c_acctbal / 10000 BETWEEN -1 AND 1 THEN asin(c_acctbal / 10000) END")
N("mth_18_atan", lambda: numbers.atan(BAL()), "atan(c_acctbal)")
N("mth_19_atan2", lambda: numbers.atan2(BAL(), KEY()), "atan2(c_acctbal, c_custkey)")
N("mth_20_cot", lambda: numbers.cot(KEY() / 10000), "cos(c_custkey / 10000) / nullif(sin(c_custkey / 10000), 0)", 3)
N("mth_21_radians", lambda: numbers.radians(BAL()), "radians(c_acctbal)")
N("mth_22_degrees", lambda: numbers.degrees(BAL() / 1000), "degrees(c_acctbal / 1000)")
N("mth_23_div", lambda: numbers.div(BAL(), C("c_nationkey")), "CASE WHEN c_nationkey <> 0 THEN trunc(c_acctbal / c_nationkey) END")
N("mth_24_mod", lambda: numbers.mod(BAL().cast("long"), F.lit(7)), "CAST(trunc(c_acctbal) AS BIGINT) - 7 * floor(trunc(c_acctbal) / 7)")
HEX = "CASE WHEN (x-round(x))**2 + (y-round(y/h)*h)**2 <= (x-round(x-0.5)-0.5)**2 + (y-(round(y/h-0.5)+0.5)*h)**2 THEN {0} ELSE {1} END"
for _k, _f, _a, _b in (("mth_25_hexbinx", numbers.hexbin_x, "round(x)", "round(x-0.5)+0.5"), ("mth_26_hexbiny", numbers.hexbin_y, "round(y/h)*h", "(round(y/h-0.5)+0.5)*h")):
    N(_k, lambda f=_f: f(BAL() / 997, C("c_nationkey") * 1.37), "(SELECT " + HEX.format(_a, _b) + " FROM (SELECT c_acctbal / 997 AS x, c_nationkey * 1.37::DOUBLE AS y, sqrt(3.0::DOUBLE) AS h))")


def _point(a, b):
    return numbers.make_point(a, b)


scalar("mth_27_makepoint", "customer", "c_custkey", lambda: F.to_json(_point(C("c_nationkey"), KEY())), "'{\"lat\":' || c_nationkey || '.0,\"lon\":' || c_custkey || '.0}'")
N("mth_28_distance", lambda: numbers.distance_km(_point(C("c_nationkey") * 2.0, BAL() / 100), _point(F.lit(48.1), F.lit(11.6))), "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(48.1) - radians(c_nationkey * 2.0)) / 2), 2) + cos(radians(c_nationkey * 2.0)) * cos(radians(48.1)) * pow(sin(radians(11.6 - c_acctbal / 100) / 2), 2))))", 3)
scalar("mth_29_makeline", "customer", "c_custkey", lambda: F.size(numbers.make_line(_point(BAL(), BAL()), _point(KEY(), KEY()))).cast("long"), "CAST(2 AS BIGINT)")


def D(key, value, sql):
    scalar(key, "orders", "o_orderkey", value, sql)




def OD():
    return F.col("o_orderdate")


for _i, _p in enumerate(("year", "quarter", "month")):
    D(f"dat_{_i + 1:02d}_trunc_{_p}", lambda p=_p: dates.trunc(p, OD()), f"CAST(date_trunc('{_p}', o_orderdate) AS DATE)")
D("dat_04_trunc_week", lambda: dates.trunc("week", OD()), "CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT)")
for _i, _p in enumerate(("year", "quarter", "month", "day")):
    D(f"dat_{_i + 5:02d}_part_{_p}", lambda p=_p: dates.part(p, OD()).cast("long"), f"CAST({_p}(o_orderdate) AS BIGINT)")
for _i, _p in enumerate(("hour", "minute", "second")):
    scalar(f"dat_{_i + 9:02d}_part_{_p}", "events", "event_id", lambda p=_p: dates.part(p, C("ts")).cast("long"), f"CAST({_p}(ts) AS BIGINT)")
D("dat_12_part_week", lambda: dates.part("week", OD()).cast("long"), "CAST(floor((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) + 1 - 2) / 7) + 1 AS BIGINT)")
D("dat_13_part_weekday", lambda: dates.part("weekday", OD()).cast("long"), "CAST(dayofweek(o_orderdate) + 1 AS BIGINT)")
D("dat_14_name", lambda: F.concat_ws(" ", dates.name("month", OD()), dates.name("weekday", OD()), dates.name("quarter", OD())), "monthname(o_orderdate) || ' ' || dayname(o_orderdate) || ' ' || quarter(o_orderdate)")
D("dat_15_add_months", lambda: dates.add("quarter", 1, F.to_date(OD())), "CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE)")
D("dat_16_add_days", lambda: dates.add("week", 2, F.to_date(OD())), "CAST(o_orderdate AS DATE) + 14")
scalar("dat_17_add_hours", "events", "event_id", lambda: F.unix_seconds(dates.add("hour", 5, C("ts"))), "CAST(floor(epoch(ts + INTERVAL 5 HOUR)) AS BIGINT)")
for _i, _p in enumerate(("year", "quarter", "month", "week", "day")):
    _sql = {"year": "year(date '2000-03-15') - year(o_orderdate)", "quarter": "(2000 - year(o_orderdate)) * 4 + 1 - quarter(o_orderdate)", "month": "(2000 - year(o_orderdate)) * 12 + 3 - month(o_orderdate)", "week": "(date '2000-03-12' - (CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT))) // 7", "day": "date '2000-03-15' - CAST(o_orderdate AS DATE)"}[_p]
    D(f"dat_18_diff_{_p}", lambda p=_p: dates.diff(p, OD(), F.lit(datetime.date(2000, 3, 15))), f"CAST({_sql} AS BIGINT)")
D("dat_19_parse", lambda: F.to_date(dates.parse(F.date_format(OD(), "dd/MM/yyyy"), "dd/MM/yyyy")), "CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE)")
D("dat_20_isdate", lambda: dates.is_date(F.when(C("o_orderkey") % 2 == 0, F.date_format(OD(), "yyyy-MM-dd")).otherwise("no date")), "o_orderkey % 2 = 0")
D("dat_21_makedate", lambda: dates.make_date(F.year(OD()), F.month(OD()), F.lit(1)), "make_date(year(o_orderdate), month(o_orderdate), 1)")
D("dat_22_makedatetime", lambda: F.date_format(dates.make_datetime(OD(), F.lit(5), F.lit(6), F.lit(7)), "yyyy-MM-dd HH:mm:ss"), "strftime(o_orderdate, '%Y-%m-%d') || ' 05:06:07'")
scalar("dat_23_maketime", "events", "event_id", lambda: F.round(F.extract(F.lit("SECOND"), dates.make_time(F.hour("ts"), F.minute("ts"), F.lit(9))).cast("double") + 60 * F.minute("ts"), 0).cast("long"), "CAST(9 + 60 * minute(ts) AS BIGINT)")
D("dat_24_today", lambda: F.datediff(dates.today(datetime.date(2020, 1, 1)), OD()).cast("long"), "CAST(date '2020-01-01' - CAST(o_orderdate AS DATE) AS BIGINT)")
D("dat_25_now", lambda: dates.now() > OD(), "true")
D("dat_26_literal", lambda: F.to_date(OD()) >= dates.literal("1996-01-01"), "o_orderdate >= date '1996-01-01'")

D("log_01_if", lambda: logic.if_else((C("o_totalprice") > 300000, "high"), (C("o_totalprice") > 150000, "mid"), otherwise="low"), "CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'mid' ELSE 'low' END")
D("log_02_case", lambda: logic.case(C("o_orderstatus"), {"O": "open", "F": "final"}), "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END")
D("log_03_iif", lambda: logic.iif(F.nullif(C("o_orderstatus"), F.lit("P")) == "O", "yes", "no", "unknown"), "CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'no' END")
D("log_04_isnull", lambda: logic.is_null(F.nullif(C("o_orderstatus"), F.lit("O"))), "nullif(o_orderstatus, 'O') IS NULL")
D("log_05_ifnull", lambda: logic.if_null(F.nullif(C("o_orderstatus"), F.lit("O")), "none"), "coalesce(nullif(o_orderstatus, 'O'), 'none')")
D("log_06_zn", lambda: logic.zn(F.when(C("o_orderstatus") == "O", C("o_totalprice"))), "CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END")
D("log_07_isnumber", lambda: logic.is_number(F.substring("o_orderpriority", 1, 1)) & ~logic.is_number(C("o_orderpriority")), "try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL")
D("log_08_bool", lambda: logic.or_(logic.and_(C("o_orderstatus") == "O", logic.not_(C("o_totalprice") > 100000)), C("o_orderkey") % 5 == 0), "(o_orderstatus = 'O' AND NOT o_totalprice > 100000) OR o_orderkey % 5 = 0")
D("log_09_compare", lambda: logic.compare(C("o_totalprice"), ">=", 100000.0) & logic.compare(C("o_orderstatus"), "<>", "F"), "o_totalprice >= 100000 AND o_orderstatus <> 'F'")
D("log_10_int", lambda: logic.to_int(-C("o_totalprice")), "CAST(trunc(-o_totalprice) AS BIGINT)")
D("log_11_float", lambda: logic.to_float(F.substring("o_orderpriority", 1, 1)), "try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE)")
D("log_12_str", lambda: logic.to_str(C("o_custkey")), "CAST(o_custkey AS VARCHAR)")
D("log_13_date", lambda: logic.to_date(F.date_format(OD(), "yyyy-MM-dd")), "CAST(o_orderdate AS DATE)")
D("log_14_datetime", lambda: F.to_date(logic.to_datetime(F.date_format(OD(), "yyyy-MM-dd HH:mm:ss"))), "CAST(o_orderdate AS DATE)")
D("log_15_username", lambda: logic.user_name("ann"), "'ann'")
D("log_16_parameter", lambda: C("o_totalprice") > logic.parameter({"limit": 200000}, "limit"), "o_totalprice > 200000")
