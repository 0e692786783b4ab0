"""Rules of operators and functions on small rows, above all for NULL, nothing and ties."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import arrays, dates, jsons, maths, strings
from millrace.operators import aggregates, engines, geo, joins, paging, predicates, relations, sets, vectors, writes
from millrace.sources import tables
from millrace.sources.tables import TENANT, Table, all_of, any_of, owner, write, write_bucketed

c = F.col


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: predicates.all_of(), True), (lambda: predicates.any_of(None), False), (lambda: predicates.negated(None), False),
        (lambda: predicates.in_list(F.lit(None), []), False), (lambda: predicates.not_in_list(F.lit(None), []), True), (lambda: predicates.in_list(F.lit(None).cast("int"), [1]), None),
        (lambda: predicates.distinct_from(F.lit(None), F.lit(None)), False),
        (lambda: predicates.in_projection(F.lit(1), F.lit(False), F.lit(True), F.lit(False)), None), (lambda: predicates.in_projection(F.lit(None), F.lit(False), F.lit(False), F.lit(True)), False),
        (lambda: strings.concat(F.lit("a"), F.lit(None), F.lit("b")), "ab"), (lambda: strings.substring(F.lit("hello"), -1, 4), "he"), (lambda: strings.substring(F.lit("hello"), 3), "llo"),
        (lambda: strings.trim_string(F.lit("ababxab"), "ab"), "x"), (lambda: strings.regexp_replace_first(F.lit("a1b2"), "([0-9])", "<$1>"), "a<1>b2"),
        (lambda: strings.regexp_match(F.lit("k=v"), "(\\w)=(\\w)", 2), ["k", "v"]), (lambda: strings.regexp_match(F.lit("-"), "(\\w)", 1), None),
        (lambda: strings.initcap(F.lit("hELLO wORLD-x")), "Hello World-X"), (lambda: strings.formatted("%s %I %L %%", F.lit(None), F.lit('a"b'), F.lit("it's")), ' "a""b" \'it\'\'s\' %'),
        (lambda: strings.glob(F.lit("abc.txt"), "a*.t?t"), True), (lambda: strings.glob(F.lit("Abc"), "[^a-z]bc"), True), (lambda: strings.glob(F.lit("aXc"), "a.c"), False), (lambda: strings.quote_literal(F.lit(None).cast("string")), "NULL"),
        (lambda: maths.div(F.lit(-5), F.lit(2), True), -2), (lambda: maths.log(F.lit(1000.0)), 3.0), (lambda: maths.truncate(F.lit(-2.567), 2), -2.56), (lambda: maths.round_half_even(F.lit(2.5)), 2.0),
        (lambda: maths.greatest(F.lit(1), F.lit(None).cast("int")), 1), (lambda: maths.least(F.lit(1), F.lit(None).cast("int"), nulls="propagate"), None), (lambda: maths.forgiving_div(F.lit(1.0), F.lit(0.0)), None),
        (lambda: arrays.contains(F.array(F.lit(1), F.lit(None)), F.array(F.lit(None).cast("int"))), False), (lambda: arrays.contains(F.array(F.lit(1)), F.array().cast("array<int>")), True), (lambda: arrays.length(F.array()), None),
        (lambda: arrays.position(F.array(F.lit(1), F.lit(2)), F.lit(9)), None), (lambda: arrays.positions(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)), [1, 3]), (lambda: arrays.from_string(F.lit("a.b"), "."), ["a", "b"]),
        (lambda: arrays.replace(F.array(F.lit(1), F.lit(None)), F.lit(None).cast("int"), F.lit(5)), [1, 5]),
        (lambda: jsons.get_text(F.lit('{"a":[1,{"b":"x"}]}'), "a", 1, "b"), "x"), (lambda: jsons.get_text(F.lit('{"a":null}'), "a"), None), (lambda: jsons.get(F.lit('{"a":{"b":1}}'), "a"), '{"b":1}'), (lambda: jsons.typed(F.lit('{"a":"x"}'), "int", "a"), None),
        (lambda: jsons.has_all_keys(F.lit('{"a":1,"b":2}'), ["a", "b"]), True), (lambda: jsons.has_any_key(F.lit("{}"), ["a"]), False), (lambda: jsons.contains(F.lit('{"a":[1,{"b":2}],"c":3}'), F.lit('{"a":[{"b":2}]}')), True),
        (lambda: jsons.contains(F.lit("[1,2]"), F.lit("1")), True), (lambda: jsons.contains(F.lit("[true]"), F.lit("[1]")), False), (lambda: jsons.merge_patch(F.lit('{"a":{"b":1,"c":2}}'), F.lit('{"a":{"b":null}}')), '{"a":{"c":2}}'),
        (lambda: jsons.merge_shallow(F.lit('{"a":1}'), F.lit('{"a":null}')), '{"a":null}'), (lambda: jsons.set_path(F.lit('{"a":[1,2]}'), ["a", 1], F.lit("9")), '{"a":[1,9]}'), (lambda: jsons.set_path(F.lit('{"a":1}'), ["a"], F.lit("9"), replace=False), '{"a":1}'),
        (lambda: jsons.set_path(F.lit("{}"), ["a"], F.lit("9"), create=False), "{}"), (lambda: jsons.remove_path(F.lit('{"a":{"b":1,"c":2}}'), ["a", "b"]), '{"a":{"c":2}}'), (lambda: jsons.strip_nulls(F.lit('{"a":null,"b":[{"c":null}]}')), '{"b":[{}]}'),
        (lambda: jsons.kind(F.lit("null")), "null"), (lambda: jsons.kind(F.lit("{oops")), None), (lambda: jsons.kind(F.lit("1.5")), "number"), (lambda: jsons.contains(F.lit("{oops"), F.lit("1")), None),
        (lambda: dates.boundaries("year", F.lit(datetime.date(2023, 12, 31)), F.lit(datetime.date(2024, 1, 1))), 1), (lambda: dates.day_of_week(F.lit(datetime.date(2024, 1, 7))), 0), (lambda: dates.yyyymm(F.lit(datetime.date(2024, 3, 5))), 202403),
        (lambda: dates.modified(F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"), "+1 month", "start of day"), datetime.datetime(2024, 2, 29)), (lambda: dates.percent_format(F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"), "%d.%m.%y at %H"), "31.01.24 at 10"),
        (lambda: dates.percent_parse(F.lit("31/01/2024"), "%d/%m/%Y"), datetime.datetime(2024, 1, 31)), (lambda: dates.converted(F.lit("2024-07-01 12:00:00").cast("timestamp_ntz"), "UTC", "Asia/Tokyo"), datetime.datetime(2024, 7, 1, 21)),
        (lambda: vectors.inner_product([1, 2], [3, 4]), -11.0), (lambda: vectors.cosine([1, 0], [0, 1]), 1.0), (lambda: vectors.cosine([0, 0], [0, 1]), None), (lambda: vectors.ne(F.lit(None).cast("int"), 1), True), (lambda: vectors.not_in(F.lit(1), []), True),
        (lambda: geo.within_box(F.lit(1.0), F.lit(1.0), 1.0, 0.0, 2.0, 2.0), False), (lambda: F.round(geo.metres(F.lit(0.0), F.lit(0.0), 0.0, 1.0)), 111195.0),
    ],
)
def test_value(spark, column, want):
    assert value(spark, column()) == want


def test_age_goes_both_ways(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert tuple(value(spark, dates.age(at("2024-03-15 06:00:00"), at("2024-01-31 00:00:00")))) == (1, 15, 21_600_000_000)
    assert tuple(value(spark, dates.age(at("2024-01-31 00:00:00"), at("2024-03-15 06:00:00")))) == (-1, -15, -21_600_000_000)


def test_aggregates_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "i int, v int")
    got = rows.agg(
        aggregates.total(c("v")).alias("t"), F.size(aggregates.array_agg(c("v"))).alias("kept"), F.size(aggregates.array_agg(c("v"), False)).alias("skipped"), aggregates.sum_if(c("i") > 9, c("v")).alias("none"),
        aggregates.arg_max(c("i"), c("v"), c("i")).alias("best"), aggregates.json_object(F.lit("k"), c("i")).alias("j"),
    ).first()
    assert tuple(got) == (10.0, 3, 2, None, 3, '{"k":3}')
    assert rows.limit(0).agg(aggregates.total(c("v")).alias("t"), aggregates.group_concat(c("v").cast("string"), c("i")).alias("g")).first() == (0.0, None)


def test_asof_join_with_ties_nulls_and_far_periods(spark):
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, "a", at(1, 5)), (2, "a", at(9)), (3, "b", at(1)), (4, None, at(2)), (5, "a", None), (6, "a", at(1))], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([(10, "a", at(1, 5)), (11, "a", at(1, 5)), (12, "a", at(1, 6)), (13, "b", at(2)), (14, None, at(1))], "rid int, k string, rts timestamp_ntz")
    got = {r.id: r.rid for r in joins.asof_join(left, right, ["k"], "ts", "rts", "rid", how="left").collect()}
    assert got == {1: 11, 2: 12, 3: None, 4: None, 5: None, 6: None}
    assert sorted(r.id for r in joins.asof_join(left.filter("k is not null"), right, ["k"], "ts", "rts", "rid").collect()) == [1, 2]


def test_quantified_all(spark):
    left, right = spark.createDataFrame([(1,), (5,)], "v int"), spark.createDataFrame([(3,), (4,)], "w int")
    assert [r.v for r in joins.at_least_all(left, "v", right, "w").collect()] == [5]
    assert joins.at_least_all(left, "v", right.limit(0), "w").count() == 2
    assert joins.at_least_all(left, "v", right.union(spark.createDataFrame([(None,)], "w int")), "w").count() == 0


def test_set_chain_binds_intersect_first(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    got = sets.combined(one(1, 2), ("union all", one(2, 3)), ("intersect", one(3)), ("except all", one(1)))
    assert sorted(r.v for r in got.collect()) == [2, 3]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_last", [None, False, True])
def test_pages_visit_every_row_once_across_nulls(spark, descending, nulls_last):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(23)], "id int, k int")
    keys = [paging.Key("k", descending, nulls_last), paging.Key("id")]
    seen, cursor = [], None
    while True:
        page = paging.page(df, keys, 5, cursor)
        seen += [r.id for r in page.items]
        if not page.has_more:
            break
        cursor = page.next_cursor
    assert seen == [r.id for r in df.orderBy(*[k.order() for k in keys]).collect()]
    last = paging.encode(keys, [df.filter(c("id") == seen[10]).first().k, seen[10]])
    assert [r.id for r in paging.page_frame(df, keys, 9, last, forward=False).collect()] == seen[:10][::-1]


def test_cursors_keep_types_and_refuse_strangers():
    keys = [paging.Key(n) for n in "abcdefgh"]
    values = [None, True, 7, 1.5, "x", decimal.Decimal("1.20"), datetime.datetime(2024, 1, 2, 3), b"\x00\xff"]
    assert paging.decode(keys, paging.encode(keys, values)) == values
    for bad in ("", "%%%", paging.encode(keys[:1], [1])):
        with pytest.raises(ValueError):
            paging.decode(keys, bad)
    with pytest.raises(ValueError):
        paging.encode(keys, [1])


def test_relations(spark):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    children = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "pid int, n string")
    many = relations.HasMany(children, "id", "pid")
    assert [r.id for r in relations.where_has(parents, many).collect()] == [1]
    assert {r.id for r in relations.where_doesnt_have(parents, many).collect()} == {2, None}
    assert {r.id: r.n for r in relations.with_count(parents, many, "n").collect()} == {1: 2, 2: 0, None: 0}
    assert {r.id: [x.n for x in r.kids] for r in relations.load(parents, many, "kids", ["n"], "n").collect()} == {1: ["a", "b"], 2: [], None: []}
    tags = spark.createDataFrame([(7, "t"), (8, "u")], "tid int, name string")
    junction = spark.createDataFrame([(1, 7), (1, 7), (1, 9), (2, None)], "pid int, tag int")
    m2m = relations.ManyToMany(junction, "id", "pid", "tag", tags, "tid")
    assert {r.id: r.n for r in relations.with_count(parents, m2m, "n").collect()} == {1: 1, 2: 0, None: 0}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id int, n string, d int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, n string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(writes.upsert(old, new, ["id"], {"n": c("excluded.n")})) == [(1, "a", None), (2, "B", 1), (3, "C", None)]
    assert rows(writes.upsert(old, new, ["id"])) == [(1, "a", None), (2, "b", 1), (3, "C", None)]
    assert rows(writes.delete(old, c("d") > 0)) == [(1, "a", None)] and rows(writes.update(old, c("d") > 0, {"n": F.lit("x")})) == [(1, "a", None), (2, "x", 1)]
    assert rows(writes.soft_delete(old, F.lit(True), "d", F.lit(9)).select("id", "d")) == [(1, 9), (2, 1)]
    assert rows(old.select(writes.changed("d", F.lit(None).cast("int")).alias("v"))) == [(False,), (True,)]
    assert rows(engines.replacing(old.union(old.withColumn("d", F.lit(5))), ["id"], ["d"]).select("id", "d")) == [(1, 5), (2, 5)]


def test_tables_scope_guard_and_files(spark, tmp_path):
    write(spark.createDataFrame([(1, 7, None, "x"), (2, 7, 1, "x"), (3, 8, None, "y")], "id int, tenant int, gone int, who string"), f"{tmp_path}/notes.parquet", sort_by=("id",))
    notes = Table("notes").soft_deleted_by("gone").scoped_by_tenant("tenant")
    with pytest.raises(PermissionError):
        notes.scan(spark, str(tmp_path))
    spark.conf.set(TENANT, "7")
    try:
        ids = lambda df: sorted(r.id for r in df.collect())
        assert ids(notes.scan(spark, str(tmp_path))) == [1] and ids(notes.scan(spark, str(tmp_path), ignore=None)) == [1, 2] == ids(notes.scan(spark, str(tmp_path), ignore=("soft_delete",)))
        guarded = Table("notes").authorized_with(any_of(owner("who", "y"), all_of()))
        assert ids(guarded.scan(spark, str(tmp_path))) == [3] and not ids(Table("notes").authorized_with(any_of()).scan(spark, str(tmp_path)))
    finally:
        spark.conf.unset(TENANT)
    for kind in ("orc", "json", "csv"):
        write(spark.range(3), f"{tmp_path}/n.{kind}", kind, mode="overwrite")
        assert Table("n", kind, StructType.fromDDL("id long")).read(spark, str(tmp_path)).count() == 3


def test_plans_prune_push_and_spread(spark, sf):
    from millrace.plans import catalogue

    def plan(name):
        return catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    text = plan("projection_pushdown")
    assert "PushedFilters: [IsNotNull(l_quantity)" in text and "l_comment" not in text and text.count("Exchange") == 0
    assert "CartesianProduct" not in "".join(map(plan, ("asof_join", "interval_join", "m2m_count", "upsert_merge", "mirror_latest")))
    assert "TakeOrderedAndProject" in plan("top_k") and "Python" not in plan("knn_cosine")


def test_bucketed_tables_join_without_exchange(spark):
    write_bucketed(spark.range(50).withColumn("v", c("id") * 2), "mr_left", 4, ("id",))
    write_bucketed(spark.range(40).withColumn("w", c("id") * 3), "mr_right", 4, ("id",))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("mr_left").join(spark.table("mr_right"), "id")
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("mr_left", "mr_right"):
            spark.sql(f"DROP TABLE {t}")


def test_settings_are_put_back_and_checked(spark):
    from millrace.session import each, one, scoped

    before = spark.conf.get("spark.sql.shuffle.partitions")
    with scoped(spark, {"spark.sql.shuffle.partitions": "3"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(ValueError), scoped(spark, {"a; drop": "1"}):
        pass
    seen = []
    assert each(spark.range(5), seen.append) == 5 and [r.id for r in seen] == [0, 1, 2, 3, 4] and one(spark.range(2)).id == 0
    with pytest.raises(LookupError):
        one(spark.range(0))


def test_numbers_are_gapless(spark):
    from millrace.sources.tables import numbered, shards

    df = spark.range(1000).select((c("id") * 7919 % 1000).alias("id"))
    assert all(r.n == r.id + 1 for r in numbered(df, "n", ["id"]).collect())
    assert shards(spark, ["/root/testdata/sf0.001"] * 2, Table("region")).count() == 10


def test_money(spark):
    from millrace.functions import money

    assert value(spark, money.minor(F.lit("1.005").cast("decimal(10,3)"), "EUR")) == 101 and value(spark, money.shown(F.lit(1234), "JPY")) == "JPY 1234" and value(spark, money.shown(F.lit(1234), "EUR")) == "EUR 12.34"


def test_json_values(spark):
    assert value(spark, jsons.merge_preserve(F.lit('{"a":1}'), F.lit('{"a":2,"b":3}'))) == '{"a":[1,2],"b":3}'
    assert value(spark, jsons.length(F.lit("7"))) == 1 and value(spark, jsons.unquote(F.lit('"a\\nb"'))) == "a\nb" and value(spark, jsons.depth(F.lit("[]"))) == 1
    assert value(spark, jsons.pretty(F.lit('{"a":1}'))) == '{\n    "a": 1\n}'


def test_numbers_of_many_rows_with_payload(spark):
    """So many rows that ranges are sampled: numbers are gapless and in order, whatever columns are read."""
    rows = spark.range(600_000, numPartitions=7).select(F.xxhash64("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), "id")
    out = tables.numbered(rows, "number", ["key"])
    facts = out.agg(F.count_distinct("number").alias("n"), F.min("number").alias("least"), F.max("number").alias("most"), F.count_if(F.length("payload") != 64).alias("bad")).first()
    assert tuple(facts) == (600_000, 1, 600_000, 0)
    keys = [r.key for r in out.orderBy("number").select("key").collect()]
    assert keys == sorted(keys)


def test_quantiles_of_groups(spark):
    rows = spark.createDataFrame([(g, float(v)) for g in (None, 1, 2) for v in range(10 * (g or 1))] + [(3, None), (2, None)], "g int, v double")
    got = {r.g: (r.a, r.b, r.n) for r in aggregates.quantiles(rows, ["g"], "v", {"a": 0.25, "b": 1.0}).collect()}
    assert got == {None: (2.25, 9.0, 10), 1: (2.25, 9.0, 10), 2: (4.75, 19.0, 20)}
    disc = {r.g: (r.a, r.b) for r in aggregates.quantiles(rows, ["g"], "v", {"a": 0.0, "b": 0.5}, discrete=True).collect()}
    assert disc == {None: (0.0, 4.0), 1: (0.0, 4.0), 2: (0.0, 9.0)}
    assert aggregates.quantiles(rows.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_limits_and_rules(spark):
    rows = spark.range(10)
    assert [paging.ceiling(rows, *x).count() for x in ((3, None), (None, 4), (7, 2), (None, None))] == [3, 4, 2, 10]
    with pytest.raises(ValueError):
        paging.ceiling(rows, -1)
    good, bad = writes.validated(rows, {"small": F.col("id") < 8, "known": F.nullif("id", F.lit(3)) >= 0})
    assert good.count() == 7 and {r.id: r.faults for r in bad.collect()} == {3: ["known"], 8: ["small"], 9: ["small"]}


def test_a_vector_sink_gets_each_point_once(spark, tmp_path):
    from millrace.streaming import changes

    rows = [("insert", "a", 1.0, 1), ("delete", "a", None, 2), ("insert", "b", 2.0, 1), ("update", "b", 3.0, 2), ("insert", "c", None, 1)]
    df = spark.createDataFrame(rows, "op string, key string, x double, version long")
    seen = {}
    embed = lambda d: d.withColumn("vector", F.when(F.col("x").isNotNull(), F.array("x")))
    sink = changes.vector_sink(["key"], embed, ["key"], lambda d, n: seen.update(up=d.collect()), lambda d, n: seen.update(down=d.collect()))
    sink(df, 0)
    assert [(r.vector, r.payload) for r in seen["up"]] == [([3.0], '{"key":"b"}')] and len(seen["down"]) == 2
    ids = {r.point_id for r in [*seen["up"], *seen["down"]]}
    sink(df, 1)
    assert ids == {r.point_id for r in [*seen["up"], *seen["down"]]} and len(ids) == 3 and all(len(i) == 36 for i in ids)


def test_json_paths_equal_plain_python(spark):
    """Writes, insertions, replacements and removals at paths of members and places, on documents of any shape."""
    import json
    import random

    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(5 if depth else 3)
        if kind == 3:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return {k: made(depth - 1) for k in rng.sample("abc", rng.randrange(4))} if kind == 4 else rng.choice([1, 2.5, "x", None, True])

    def put(x, at, v, create, replace):
        if not at:
            return v if replace else x
        k, rest = at[0], at[1:]
        if isinstance(x, dict) and isinstance(k, str):
            return {**x, k: put(x[k], rest, v, create, replace)} if k in x else {**x, k: v} if create and not rest else x
        if isinstance(x, list) and isinstance(k, int):
            if -len(x) <= k < len(x):
                return [put(e, rest, v, create, replace) if i == k % len(x) else e for i, e in enumerate(x)]
            return [*x, v] if create and not rest else x
        return x

    def drop(x, at):
        k, rest = at[0], at[1:]
        if isinstance(x, dict) and k in x:
            return {a: drop(b, rest) if a == k else b for a, b in x.items() if a != k or rest}
        if isinstance(x, list) and isinstance(k, int) and -len(x) <= k < len(x):
            return [drop(e, rest) if i == k % len(x) else e for i, e in enumerate(x) if i != k % len(x) or rest]
        return x

    docs = [made(3) for _ in range(120)]
    df = spark.createDataFrame([(i, json.dumps(d), json.dumps(docs[-i - 1])) for i, d in enumerate(docs)], "i int, d string, e string")
    paths, new = [["a"], ["b", "a"], [0], ["c", -1], [1, "a"], ["a", 0, "b"], [-2]], {"n": [1]}
    modes = [(True, True), (True, False), (False, True)]
    columns = [jsons.set_path(c("d"), p, F.lit(json.dumps(new)), *m).alias(f"s{i}_{k}") for i, p in enumerate(paths) for k, m in enumerate(modes)]
    columns += [jsons.remove_path(c("d"), p).alias(f"r{i}") for i, p in enumerate(paths)] + [jsons.merge_shallow(c("d"), c("e")).alias("m")]
    load = lambda text: None if text is None else json.loads(text)
    for r in df.select("i", *columns).collect():
        d, e = docs[r.i], docs[-r.i - 1]
        for i, p in enumerate(paths):
            assert [load(r[f"s{i}_{k}"]) for k in range(3)] == [put(d, p, new, *m) for m in modes] and load(r[f"r{i}"]) == drop(d, p), (d, p)
        assert load(r.m) == ({**d, **e} if isinstance(d, dict) and isinstance(e, dict) else None)


def test_sketches_stand_beside_no_distinct_count(spark, tmp_path):
    """No aggregate keeps a sketch for every distinct value; a group of null flags has its row, and nothing gives nothing."""
    import re

    from millrace.plans import catalogue

    query = catalogue.queries()["approx_distinct_within"]
    rows = spark.range(4000).select(F.when(c("id") % 3 > 0, (c("id") % 3).cast("string")).alias("l_returnflag"), F.nullif(c("id") % 1000, F.lit(5)).alias("l_partkey"))
    for name, df in (("rows", rows), ("nothing", rows.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    out = query(spark, f"{tmp_path}/rows")
    steps = [s for s in re.findall(r"keys=\[(.*?)\], functions=\[(.*?)\]", out._jdf.queryExecution().executedPlan().toString()) if re.search("hll|approx", s[1])]
    assert steps and not any("l_partkey" in keys for keys, _ in steps)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(f, True, True) for f in ("1", "2", None)], key=str)
    assert query(spark, f"{tmp_path}/nothing").collect() == []
