"""Linking, order, validation and canonical JSON of tool calls."""

import json

import duckdb
from pyspark.sql import functions as F

from millrace.llm import chat, queries
from millrace.llm.chat import Argument, from_turns, levels, link_calls

CALLS = "conv_id long, call_id string, name string, arguments string"
RESULTS = "conv_id long, call_id string, content string"
NEEDS = "conv_id long, call_id string, needs string"
SCHEMAS = {"search": {"query": Argument("string", longest=10), "limit": Argument("integer", required=False, least=1)}, "now": {}}


def link(spark, calls, results, needs):
    return link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(needs, NEEDS), SCHEMAS)


def test_statuses_faults_and_messages(spark):
    calls = [
        (1, "a", "search", '{ "query" : "x\\n\\u00e9\\"" , "limit": 3 }'), (1, "b", "search", '{"limit": 0, "query": 7}'), (1, "c", "now", "{}"), (1, "d", "nope", "{}"),
        (1, "e", "search", "[1]"), (1, "f", "search", "{broken"), (1, "g", "now", None), (1, "h", "now", '{"z": 1, "y": 2}'), (1, "i", "search", '{"query": "01234567890"}'),
        (1, "j", "now", "{}"), (1, "k", "now", "{}"), (None, "a", "now", "{}"), (2, None, "now", "{}"),
    ]
    results = [(1, "a", "first"), (1, "a", "second"), (1, "zz", None), (2, "a", "other"), (None, "a", "lost"), (1, "j", ""), (1, "k", "x")]
    rows = link(spark, calls, results, [(1, "j", "k"), (1, "k", "j"), (1, "b", "a"), (1, "c", "b"), (1, "c", "absent")]).collect()
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.call_id, r.name), []).append(r)
    one = lambda *k: by[k][0]
    assert len(rows) == 17
    assert {r.message for r in by[(1, "a", "search")]} == {f'{{"arguments":{{"limit":3,"query":"x\\né\\""}},"content":"{c}","id":"a","level":0,"name":"search"}}' for c in ("first", "second")}
    assert (one(1, "b", "search").status, one(1, "b", "search").faults) == ("invalid", "limit: below 1; query: not string")
    assert (one(1, "c", "now").status, one(1, "c", "now").level) == ("unanswered", 2)
    assert one(1, "d", "nope").faults == "unknown tool" and one(1, "h", "now").faults == "unknown: y+z" and one(1, "i", "search").faults == "query: over 10"
    for k in (("e", "search"), ("f", "search"), ("g", "now")):
        assert one(1, *k).faults == "arguments: not an object"
    assert one(1, "j", "now").status == one(1, "k", "now").status == "cycle" and one(1, "j", "now").level is None
    assert one(1, "zz", None).status == one(2, "a", None).status == "orphan" and one(1, "zz", None).message == '{"id":"zz"}'
    assert [one(None, "a", "now").status, one(2, None, "now").status] == ["unanswered", "unanswered"]
    for r in rows:
        assert json.loads(r.message).get("id") == r.call_id


def test_levels_follow_every_dependency(spark):
    n = 12
    calls = spark.createDataFrame([(1, f"x{i}") for i in range(n)], "conv_id long, call_id string")
    edges = [(1, f"x{i}", f"x{j}") for i in range(n) for j in range(i) if (i * j) % 3 == 1]
    got = {r.call_id: r.level for r in levels(calls, spark.createDataFrame(edges, NEEDS)).collect()}
    want = {}
    for i in range(n):
        want[f"x{i}"] = max([want[e[2]] + 1 for e in edges if e[1] == f"x{i}"], default=0)
    assert got == want


def test_long_chains_take_few_rounds_and_cycles_have_no_level(spark):
    n = 300
    calls = [(c, f"x{i}") for c in (1, 2) for i in range(n)] + [(3, k) for k in "abcdefg"]
    edges = [(c, f"x{i}", f"x{i - 1}") for c in (1, 2) for i in range(1, n)] + [(2, "x0", f"x{n - 1}")]
    edges += [(3, "b", "a"), (3, "c", "b"), (3, "d", "c"), (3, "d", "a"), (3, "e", "d"), (3, "f", "g"), (3, "g", "f")]
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(calls, "conv_id long, call_id string"), spark.createDataFrame(edges, NEEDS)).collect()}
    assert got == {(1, f"x{i}"): i for i in range(n)} | {(3, k): i for i, k in enumerate("abcde")}
    behind = spark.createDataFrame([(3, "h")], "conv_id long, call_id string")
    more = edges + [(3, "h", "f"), (3, "h", "a")]
    got = levels(spark.createDataFrame(calls, "conv_id long, call_id string").union(behind), spark.createDataFrame(more, NEEDS)).filter("conv_id = 3")
    assert {r.call_id: r.level for r in got.collect()} == {k: i for i, k in enumerate("abcde")}


def test_conversations_equal_sql(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = link_calls(*from_turns(turns.withColumn("level", F.lit("x"))), chat.REPLY)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = db.execute(chat.ORACLE_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    assert link_calls(*from_turns(turns.limit(0)), chat.REPLY).count() == 0
    assert link_calls(*from_turns(turns.limit(1).withColumn("text", F.lit(None).cast("string"))), chat.REPLY).count() == 1


def test_no_turn_is_missing(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = [(-1, 0, "system", 'say "x"'), (-1, 1, "user", "a"), (-1, 2, "assistant", "b"), (-1, 3, None, "c"), (-1, 4, "tool", None), (-1, 4, "system", ""), (-1, None, "system", "d")]
    odd = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    all_turns = turns.selectExpr("cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "role", "text").unionByName(odd)
    out = chat.every_turn(all_turns, chat.REPLY).collect()
    seen = set()
    for r in out:
        turn = int(r.call_id[1:]) if r.call_id else None
        if r.status == "message":
            seen.add((r.conv_id, turn))
        else:
            seen |= ({(r.conv_id, turn)} if r.name else set()) | ({(r.conv_id, turn + 1)} if '"content":' in r.message else set())
    assert seen == {(r.conv_id, r.turn) for r in all_turns.collect()}
    assert sum(r.status == "message" for r in out) == all_turns.filter("role is null or role not in ('user', 'assistant')").count()
    messages = sorted(r.message for r in out if r.conv_id == -1 and r.status == "message")
    assert messages == sorted(['{"content":"say \\"x\\"","id":"m0","role":"system"}', '{"content":"c","id":"m3"}', '{"id":"m4","role":"tool"}', '{"content":"","id":"m4","role":"system"}', '{"content":"d","role":"system"}'])
    assert queries.QUERIES["op2_chat_every_turn"](spark, sf).filter("status = 'message'").count() == turns.filter("role is null or role not in ('user', 'assistant')").count()


def test_repeated_identifiers_make_no_pairs(spark):
    """Many calls and many results of one identifier are as many rows; one of either is linked with all of the other."""
    calls = [(1, "a", "now", "{}")] * 300 + [(1, "b", "now", "{}")] * 4 + [(1, "c", "now", "{}")]
    results = [(1, "a", str(i)) for i in range(200)] + [(1, "b", "x")] + [(1, "c", str(i)) for i in range(5)]
    rows = link(spark, calls, results, []).groupBy("call_id", "status", "faults").count().collect()
    assert {(r.call_id, r.status, r.faults): r["count"] for r in rows} == {
        ("a", "invalid", "identifier: repeated"): 300, ("a", "orphan", ""): 200, ("b", "linked", ""): 4, ("c", "linked", ""): 5,
    }
