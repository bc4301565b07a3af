import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.operators import ledger, sessions, skew

T0 = datetime(2024, 1, 1)
DOCS = "doc int, s string, at timestamp, text string, n string"


def steps(spark):
    rows = [
        (1, "a", T0, "user: Compare Redis with Redis please\r\nagent: Redis caches the INSIGHT--REDIS data\nnoise: x\ntool: ran", "x"),
        (2, "a", T0 + timedelta(minutes=61), "agent: Redis wins, compare done", "x"), (3, None, None, "user: Hello", "x"), (4, "b", T0, "", "x"), (5, "b", T0, None, "x"),
    ]
    return sessions.trace_steps(spark.createDataFrame(rows, DOCS), "s", "at", "doc", "text")


def test_steps_and_stats(spark):
    assert steps(spark).count() == 5
    got = {r["session_id"]: r for r in sessions.session_stats(steps(spark), min_messages=3).collect()}
    a = got["a"]
    assert (a["n_user"], a["n_agent"], a["n_tool"], a["minutes"], a["due"]) == (1, 2, 1, 61.0, True) and got[None]["minutes"] is None


def test_topics_and_proposals(spark):
    top = [(r["term"], r["n"]) for r in sessions.topics(steps(spark)).where("session_id = 'a'").orderBy("rank").collect()]
    assert top[0] == ("Redis", 4) and ("Compare", 1) in top and not {"with", "With"} & {t for t, _ in top}
    row = sessions.proposals(steps(spark)).where("session_id = 'a'").collect()
    assert [(r["proposed_id"], r["title"], r["n"]) for r in row] == [("INSIGHT--REDIS", "Redis", 4)]
    assert row[0]["score"] == pytest.approx(0.4 * 0.7 + 0.3 * 3 / 5 + 0.3)
    text = {r["session_id"]: r for r in sessions.summaries(steps(spark)).collect()}
    assert "Compare Redis with Redis please" in text["a"]["summary"] and text["a"]["tags"].startswith("redis,") and text[None]["tags"] == "hello"


@pytest.mark.parametrize("rows_per_task", [10, 100_000])
def test_positions(spark, rows_per_task):
    rng = random.Random(1)
    rows = [(rng.choice(["h", "h", "h", "k", None]), rng.randrange(40), i) for i in range(200)]
    out = skew.positions(spark.createDataFrame(rows, "k string, o long, t int"), ["k"], "o", ["t"], "p", rows_per_task).collect()
    for key in {r[0] for r in rows}:
        want = sorted((o, t) for k, o, t in rows if k == key)
        assert [(r["o"], r["t"]) for r in sorted((r for r in out if r["k"] == key), key=lambda r: r["p"])] == want
        assert sorted(r["p"] for r in out if r["k"] == key) == list(range(len(want)))


def test_cascade_and_strongest(spark):
    rows = spark.createDataFrame([("k", i, 1) for i in range(7)], "k string, o long, v int")
    assert [(r["fold"], r["n_rows"], r["first"], r["last"]) for r in sessions.cascade(rows, ["k"], "o", [], 3, ["v"]).orderBy("fold").collect()] == [(0, 3, 0, 2), (1, 3, 3, 5), (2, 1, 6, 6)]
    df = spark.createDataFrame([("c", 0.5, 1, "x"), ("c", 0.9, 2, "y"), ("c", 0.9, 3, "z"), (None, 1.0, 4, "n"), ("d", None, 5, "m")], "c string, s double, o int, v string")
    assert [tuple(r) for r in sessions.keep_strongest(df, "c", "s", F.col("o"), ["v"]).collect()] == [("c", "y", 0.9)]


def test_usage_and_filled(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 4)], "p string, n int")
    got = {(r["p"], r["grand"]): (r["calls"], r["n"]) for r in ledger.usage_totals(df, ["p"], {"n": F.col("n")}).collect()}
    assert got == {("a", False): (2, 3), (None, False): (1, 4), (None, True): (3, 7)}
    assert {tuple(r) for r in ledger.zero_filled(df, "p", ["a", "z"]).collect()} == {("a", 2), ("z", 0)}
    assert ledger.daily(spark.createDataFrame([(T0,)], "t timestamp"), "t", [], {}).first()["day"] == "2024-01-01"
    assert {tuple(r) for r in ledger.histogram(df, "n", 2.0).collect()} == {(0.0, 1), (2.0, 1), (4.0, 1)}


@pytest.mark.parametrize("rows_per_task", [10, 100_000])
def test_percentiles(spark, rows_per_task):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, rng.randrange(60)])) for _ in range(400)]
    out = ledger.nearest_rank(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", [0, 50, 95, 100], rows_per_task).collect()
    want = {}
    for g in "ab":
        vs = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, float(p)): vs[int(p / 100 * (len(vs) - 1))] for p in (0, 50, 95, 100)}
    assert {(r["g"], r["percent"]): r["value"] for r in out} == want and len(out) == 8


def test_hit_metrics(spark):
    results = spark.createDataFrame([("q1", 1, True), ("q1", 2, False), ("q2", 1, False), ("q2", 4, True), ("q2", 9, True), ("q3", 6, True)], "query_id string, rank int, right boolean")
    queries = spark.createDataFrame([("q1", "x"), ("q2", "x"), ("q3", "y")], "query_id string, t string")
    got = {r["t"]: (r["n_queries"], r["hit_at_1"], r["hit_at_k"]) for r in ledger.hit_metrics(results, queries, 5, "t").collect()}
    assert got == {"x": (2, 50.0, 100.0), "y": (1, 0.0, 0.0), None: (3, 33.33, 66.67)}
