"""Scalar functions by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import arrays, dates, jsons, maths, strings
from millrace.plans.registry import query

c = F.col


@query("SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name)::INTEGER AS n, octet_length(c_name::BLOB)::INTEGER AS bytes, substring(c_name, 3, 4) AS mid, left(c_name, 3) AS l, right(c_name, 3) AS r, reverse(c_name) AS back FROM customer")
def string_basics(t):
    name = c("c_name")
    return t.customer.select(
        "c_custkey", F.lower(name).alias("lo"), F.upper("c_mktsegment").alias("up"), F.char_length(name).alias("n"), strings.byte_length(name).alias("bytes"),
        strings.substring(name, 3, 4).alias("mid"), F.left(name, F.lit(3)).alias("l"), F.right(name, F.lit(3)).alias("r"), F.reverse(name).alias("back"),
    )


@query("SELECT s_suppkey, concat(s_name, NULL, '-', s_nationkey) AS skipped, s_name || NULL AS strict, concat_ws('/', s_name, NULL, s_nationkey) AS joined FROM supplier")
def string_concat(t):
    nothing = F.lit(None).cast("string")
    return t.supplier.select(
        "s_suppkey", strings.concat(c("s_name"), nothing, F.lit("-"), c("s_nationkey").cast("string")).alias("skipped"), F.concat("s_name", nothing).alias("strict"), F.concat_ws("/", "s_name", nothing, c("s_nationkey").cast("string")).alias("joined")
    )


@query("SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('xx' || p_name, 'x') AS lt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, repeat(p_brand, 2) AS twice, replace(p_type, 'E', '3') AS swapped FROM part")
def string_padding(t):
    return t.part.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"), F.ltrim(F.concat(F.lit("xx"), "p_name"), F.lit("x")).alias("lt"), F.lpad("p_brand", 12, "*").alias("lp"),
        F.rpad("p_brand", 12, "*").alias("rp"), F.repeat("p_brand", F.lit(2)).alias("twice"), F.replace("p_type", F.lit("E"), F.lit("3")).alias("swapped"),
    )


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, regexp_extract(p_brand, '[0-9]+', 0) AS digits, position('a' IN p_name)::INTEGER AS at FROM part")
def string_regexp(t):
    name = c("p_name")
    return t.part.select("p_partkey", strings.regexp_replace_first(name, "[aeiou]", "_").alias("first"), F.regexp_replace(name, "[aeiou]", "_").alias("every"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("digits"), strings.position("a", name).alias("at"))


@query("SELECT p_partkey, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha2, lower(hex(p_name::BLOB)) AS hex, to_base64(p_name::BLOB) AS b64 FROM part")
def string_digests(t):
    name = c("p_name")
    return t.part.select("p_partkey", F.md5(name).alias("md5"), F.sha1(name).alias("sha1"), F.sha2(name, 256).alias("sha2"), strings.encode_hex(name).alias("hex"), F.base64(name.cast("binary")).alias("b64"))


@query("SELECT c_custkey, 'x=' || c_name || ' \"' || c_name || '\" ''' || c_name || '''' AS f, split_part(c_name, '#', 1) AS before, upper(left(c_name, 1)) || lower(substring(c_name, 2)) AS cap, chr((65 + c_custkey % 26)::INTEGER) AS letter, ascii(c_name) AS code FROM customer")
def string_format(t):
    return t.customer.select(
        "c_custkey", strings.formatted("x=%s %I %L", c("c_name"), c("c_name"), c("c_name")).alias("f"), F.substring_index("c_name", "#", 1).alias("before"),
        strings.initcap(c("c_name")).alias("cap"), F.char(F.lit(65) + c("c_custkey") % 26).alias("letter"), F.ascii("c_name").alias("code"),
    )


@query("SELECT p_partkey, p_name GLOB '*[aeiou]?' AS g, regexp_replace(regexp_replace(p_name, '^(red )+', ''), '(t)+$', '') AS trimmed FROM part")
def string_glob_trim(t):
    return t.part.select("p_partkey", strings.glob(c("p_name"), "*[aeiou]?").alias("g"), strings.trim_string(strings.trim_string(c("p_name"), "red ", "leading"), "t", "trailing").alias("trimmed"))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::BIGINT AS up, floor(s_acctbal)::BIGINT AS down, round(s_acctbal, 1) AS r, trunc(s_acctbal)::DOUBLE AS cut, s_suppkey % 7 AS m, -s_suppkey % 7 AS neg, sign(s_acctbal)::DOUBLE AS s FROM supplier")
def math_basics(t):
    bal, key = c("s_acctbal"), c("s_suppkey")
    return t.supplier.select(
        "s_suppkey", F.abs(bal).alias("a"), F.ceil(bal).alias("up"), F.floor(bal).alias("down"), F.round(bal, 1).alias("r"), maths.truncate(bal).alias("cut"), (key % 7).alias("m"), (-key % 7).alias("neg"), F.signum(bal).alias("s"),
    )


@query("SELECT p_partkey, round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 9) AS q, round(exp(p_size / 50.0), 9) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(ln(p_size) / ln(3), 9) AS l3 FROM part")
def math_powers(t):
    size = c("p_size").cast("double")
    r = lambda x: F.round(x, 9)
    return t.part.select("p_partkey", F.round(F.pow(size, F.lit(2)), 6).alias("p"), r(F.sqrt(size)).alias("q"), r(F.exp(size / 50)).alias("e"), r(F.ln(size)).alias("l"), r(maths.log(size)).alias("l10"), r(F.log2(size)).alias("l2"), r(F.log(3.0, size)).alias("l3"))


@query("SELECT p_partkey, round(sin(p_size), 9) AS si, round(cos(p_size), 9) AS co, round(tan(p_size), 6) AS ta, round(asin(p_size / 100.0), 9) AS si1, round(acos(p_size / 100.0), 9) AS co1, round(atan(p_size), 9) AS ta1 FROM part")
def math_trig(t):
    x = c("p_size").cast("double")
    r = lambda v, d=9: F.round(v, d)
    return t.part.select("p_partkey", r(F.sin(x)).alias("si"), r(F.cos(x)).alias("co"), r(F.tan(x), 6).alias("ta"), r(F.asin(x / 100)).alias("si1"), r(F.acos(x / 100)).alias("co1"), r(F.atan(x)).alias("ta1"))


@query("SELECT o_orderkey, o_orderkey // 7 AS whole, round(o_totalprice / 7, 9) AS part, o_orderkey + 1 AS plus, o_orderkey - 1 AS minus, o_orderkey * 2 AS twice, CASE WHEN o_orderkey % 2 <> 0 THEN round(o_totalprice / (o_orderkey % 2), 6) END AS forgiving FROM orders")
def math_division(t):
    key = c("o_orderkey")
    return t.orders.select(
        "o_orderkey", maths.div(key, F.lit(7), True).alias("whole"), F.round(maths.div(c("o_totalprice"), F.lit(7), False), 9).alias("part"), (key + 1).alias("plus"), (key - 1).alias("minus"), (key * 2).alias("twice"),
        F.round(maths.forgiving_div(c("o_totalprice"), (key % 2).cast("double")), 6).alias("forgiving"),
    )


@query("SELECT event_id, date_trunc('minute', ts) AS mi, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d, date_trunc('week', ts) AS w, date_trunc('month', ts) AS m, date_trunc('quarter', ts) AS q, date_trunc('year', ts) AS y FROM events")
def date_trunc(t):
    units = {"mi": "minute", "h": "hour", "d": "day", "w": "week", "m": "month", "q": "quarter", "y": "year"}
    return t.events.select("event_id", *[dates.start_of(u, c("ts")).alias(k) for k, u in units.items()])


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def start_of_hour(t):
    return t.events.groupBy(dates.start_of("hour", c("ts")).alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT (year(o_orderdate) * 100 + month(o_orderdate))::INTEGER AS yyyymm, count(*) AS n, max((year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INTEGER) AS last FROM orders GROUP BY 1")
def yyyymm(t):
    return t.orders.groupBy(dates.yyyymm(c("o_orderdate")).alias("yyyymm")).agg(F.count("*").alias("n"), F.max(dates.yyyymmdd(c("o_orderdate"))).alias("last"))


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, dayofweek(o_orderdate)::INTEGER AS dow, (isodow(o_orderdate) - 1)::INTEGER AS weekday,
    dayofyear(o_orderdate)::INTEGER AS doy, week(o_orderdate)::INTEGER AS week, last_day(o_orderdate) AS last, epoch(o_orderdate) AS epoch FROM orders""")
def date_parts(t):
    d = c("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.day(d).alias("d"), dates.day_of_week(d).alias("dow"), F.weekday(d).alias("weekday"), F.dayofyear(d).alias("doy"),
        F.weekofyear(d).alias("week"), F.last_day(d).alias("last"), dates.epoch(d).alias("epoch"),
    )


@query("SELECT o_orderkey, o_orderdate + INTERVAL 40 DAY AS later, o_orderdate - INTERVAL 3 HOUR AS before, o_orderdate + INTERVAL 1 MONTH AS next FROM orders")
def date_add(t):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", dates.modified(d, "+40 days").alias("later"), dates.modified(d, "-3 hours").alias("before"), (d + F.expr("INTERVAL 1 MONTH")).alias("next"))


@query("SELECT event_id, date_sub('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours, date_sub('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS days, date_sub('month', TIMESTAMP '2023-11-15', ts) AS months FROM events")
def date_diff_elapsed(t):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    ts = c("ts")
    return t.events.select("event_id", dates.elapsed("hour", at("2024-01-01 00:30:00"), ts).alias("hours"), dates.elapsed("day", at("2024-01-01 12:00:00"), ts).alias("days"), dates.elapsed("month", at("2023-11-15 00:00:00"), ts).alias("months"))


@query("SELECT event_id, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours, date_diff('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS days, date_diff('month', TIMESTAMP '2023-11-15', ts) AS months, date_diff('year', TIMESTAMP '2023-11-15', ts) AS years FROM events")
def date_diff_boundary(t):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    ts = c("ts")
    return t.events.select("event_id", *[dates.boundaries(u, at(s), ts).alias(f"{u}s") for u, s in (("hour", "2024-01-01 00:30:00"), ("day", "2024-01-01 12:00:00"), ("month", "2023-11-15 00:00:00"), ("year", "2023-11-15 00:00:00"))])


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%d/%m/%y') AS short, strptime(strftime(ts, '%d.%m.%Y %H'), '%d.%m.%Y %H') AS back, round(julian(ts) - 0.5, 4) AS julian FROM events")
def date_format_parse(t):
    ts = c("ts")
    return t.events.select(
        "event_id", dates.to_char(ts, "YYYY-MM-DD HH24:MI:SS").alias("shown"), dates.percent_format(ts, "%d/%m/%y").alias("short"), dates.to_timestamp(dates.to_char(ts, "DD.MM.YYYY HH24"), "DD.MM.YYYY HH24").alias("back"), F.round(dates.julian_day(ts), 4).alias("julian"),
    )


@query("SELECT event_id, make_timestamp(year(ts), month(ts), 1, hour(ts), 0, 0.0) AS made, (ts AT TIME ZONE 'Europe/Rome') AT TIME ZONE 'UTC' AS rome FROM events")
def date_make_zone(t):
    ts = c("ts")
    return t.events.select("event_id", F.make_timestamp_ntz(F.year(ts), F.month(ts), F.lit(1), F.hour(ts), F.lit(0), F.lit(0)).alias("made"), dates.at_time_zone(ts, "Europe/Rome").alias("rome"))


@query("""SELECT o_orderkey, date_sub('month', o_orderdate, TIMESTAMP '2002-03-31') AS months,
    date_sub('day', o_orderdate + to_months(date_sub('month', o_orderdate, TIMESTAMP '2002-03-31')::INTEGER), TIMESTAMP '2002-03-31') AS days FROM orders""")
def date_age(t):
    age = dates.age(F.lit("2002-03-31").cast("timestamp_ntz"), c("o_orderdate"))
    return t.orders.select("o_orderkey", age["months"].alias("months"), age["days"].alias("days"))


@query("""WITH a AS (SELECT o_custkey, list((o_orderkey % 10)::INTEGER ORDER BY o_orderkey % 10) AS xs FROM orders GROUP BY 1)
    SELECT o_custkey, list_has_all(xs, [2, 3]) AS has, list_has_any(xs, [0, 1, 2]) AS meets, len(xs) AS n, list_position(xs, 7) AS at, array_to_string(xs, '-') AS shown,
    len(list_filter(xs, lambda x: x = 7)) > 0 AS any7, len(list_filter(xs, lambda x: x <> 7)) = 0 AS all7, to_json(list_concat([100], xs, [200])) AS grown,
    to_json(list_filter(xs, lambda x: x <> 7)) AS less, to_json(list_transform(xs, lambda x: CASE WHEN x = 7 THEN 70 ELSE x END)) AS swapped FROM a""")
def array_functions(t):
    xs, seven = c("xs"), F.lit(7)
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list((c("o_orderkey") % 10).cast("int"))).alias("xs"))
    return rows.select(
        "o_custkey", arrays.contains(xs, F.array(F.lit(2), F.lit(3))).alias("has"), arrays.overlaps(xs, F.array(F.lit(0), F.lit(1), F.lit(2))).alias("meets"), arrays.length(xs).cast("long").alias("n"),
        arrays.position(xs, seven).cast("int").alias("at"), arrays.to_string(xs.cast("array<string>"), "-").alias("shown"), arrays.equals_any(seven, xs).alias("any7"), arrays.equals_all(seven, xs).alias("all7"),
        F.to_json(F.array_append(F.array_prepend(xs, F.lit(100)), F.lit(200))).alias("grown"), F.to_json(F.array_remove(xs, 7)).alias("less"), F.to_json(arrays.replace(xs, seven, F.lit(70))).alias("swapped"),
    )


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece FROM part")
def unnest(t):
    return t.part.select("p_partkey", F.explode(arrays.from_string(c("p_name"), " ")).alias("piece"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, json_extract_string(props, '$.zz') AS none, json_exists(props, '$.k') AS has FROM events")
def json_access(t):
    doc = c("props")
    return t.events.select("event_id", jsons.get_text(doc, "k").alias("k"), jsons.typed(doc, "bigint", "k").alias("n"), jsons.get_text(doc, "zz").alias("none"), jsons.has_key(doc, "k").alias("has"))


@query("SELECT s_suppkey, '{\"name\":\"' || s_name || '\",\"key\":' || s_suppkey || ',\"none\":null}' AS o, '[' || s_suppkey || ',' || s_nationkey || ']' AS a, 2::INTEGER AS n, 'array' AS kind FROM supplier")
def json_build(t):
    built = jsons.build_array(c("s_suppkey"), c("s_nationkey"))
    return t.supplier.select("s_suppkey", jsons.build_object(name=c("s_name"), key=c("s_suppkey"), none=F.lit(None).cast("string")).alias("o"), built.alias("a"), jsons.array_length(built).alias("n"), jsons.kind(built).alias("kind"))


@query("SELECT s_suppkey, '{\"a\":1,\"k\":' || s_suppkey || '}' AS patched, '{\"a\":1,\"b\":null,\"k\":' || s_suppkey || '}' AS merged, s_suppkey = 3 AS holds, '{\"a\":1,\"b\":{\"c\":' || s_suppkey || '}}' AS put FROM supplier")
def json_mutation(t):
    doc = F.lit('{"a":1,"b":{"c":0}}')
    mine = F.concat(F.lit('{"b":null,"k":'), c("s_suppkey").cast("string"), F.lit("}"))
    patched = jsons.merge_patch(doc, mine)
    return t.supplier.select(
        "s_suppkey", patched.alias("patched"), jsons.merge_shallow(doc, mine).alias("merged"), jsons.contains(patched, F.lit('{"k":3}')).alias("holds"), jsons.set_path(doc, ["b", "c"], c("s_suppkey").cast("string")).alias("put"),
    )
