import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memlake.operators import temporal
from memlake.plans import memory

LOG = "id string, k string, seq long, vf long, sup boolean, closed_at_ string"


def replay(rows):
    open_, closed = {}, {}
    for i, k, _, vf, sup, _ in sorted(rows, key=lambda r: r[2]):
        if sup:
            for o in open_.pop(k, []):
                closed[o] = (vf, i)
        open_.setdefault(k, []).append(i)
    return closed


@pytest.mark.parametrize("rows_per_task", [12, 100_000])
def test_supersede_equals_replay(spark, rows_per_task):
    rng = random.Random(4)
    rows = [(f"e{i}", rng.choice(["hot", "hot", "hot", "b", None]), i * 3, rng.randrange(100), rng.random() < 0.2, "x") for i in range(300)]
    out = temporal.supersede(spark.createDataFrame(rows, LOG).repartition(3), ["k"], "seq", "id", "vf", F.col("sup"), rows_per_task).collect()
    assert len(out) == 300
    assert {r["id"]: (r["closed_at"], r["closed_by"]) for r in out if r["closed_by"]} == replay(rows)


def test_supersede_empty(spark):
    assert temporal.supersede(spark.createDataFrame([], LOG), ["k"], "seq", "id", "vf", F.col("sup")).count() == 0


def test_edges_where(spark):
    at = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([("a", "x", "y", "r", at(1), at(5)), ("b", "x", "z", "r", at(3), None), ("c", "w", "y", "s", at(9), None)], "id string, from_node string, to_node string, rel string, valid_from timestamp, valid_to timestamp")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(temporal.edges_where(df)) == ["b", "c"] and ids(temporal.edges_where(df, from_node="x", as_of=F.lit(at(4)))) == ["a", "b"]
    assert ids(temporal.edges_where(df, as_of=F.lit(at(5)))) == ["b"] and ids(temporal.edges_where(df, to_node="y", include_invalid=True, as_of=F.lit(at(2)))) == ["a", "c"]


def test_closures_patches_conflicts(spark):
    closures = spark.createDataFrame([("a", 2, 9, "x"), ("a", 1, 5, None)], "id string, seq int, closed_at int, closed_by string")
    assert temporal.first_closure(closures, "id", "seq").collect()[0].asDict() == {"id": "a", "closed_at": 5, "closed_by": None}
    rows = spark.createDataFrame([("a", "1", None), ("b", "2", "q")], "id string, v string, w string")
    patches = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "y"), ("zz", 1, "n", "n")], "id string, seq int, v string, w string")
    assert {tuple(r) for r in temporal.apply_patches(rows, patches, "id", "seq", ["v", "w"]).select("id", "v", "w").collect()} == {("a", "x", "y"), ("b", "2", "q")}
    pairs = spark.createDataFrame([("n2", 2, 20, "o1", 0.9), ("n1", 1, 10, "o1", 0.8), ("n2", 2, 20, "o2", 0.7), ("n2", 2, 20, "o3", 0.95)], "new_id string, new_seq int, new_valid_from int, old_id string, score double")
    closed, back = temporal.resolve_conflicts(pairs)
    assert {tuple(r) for r in closed.collect()} == {("o1", 10, "n1"), ("o2", 20, "n2"), ("o3", 20, "n2")}
    assert {tuple(r) for r in back.collect()} == {("n1", "o1", 1), ("n2", "o3", 2)}


@pytest.mark.parametrize("rows_per_task", [12, 100_000])
def test_edge_supersede_keeps_edges_recorded_at_the_same_time(spark, monkeypatch, rows_per_task):
    find = memory.skew.find_hot
    monkeypatch.setattr(memory.skew, "find_hot", lambda df, keys, order, *_: find(df, keys, order, rows_per_task))
    rng = random.Random(7)
    rows = [(f"e{i:03}", rng.choice("abc"), rng.choice(["owned_by", "mentions"]), datetime(2024, 1, 1 + i % 28), datetime(2024, 2, 1 + rng.randrange(9))) for i in range(120)]
    rows += [("none", "a", "owned_by", datetime(2024, 1, 1), None)]
    edges = spark.createDataFrame(rows, "id string, from_node string, rel string, valid_from timestamp, recorded_at timestamp")
    monkeypatch.setattr(memory, "_edges", lambda *_: edges)
    out = memory.edge_supersede(spark, "").collect()
    log = sorted((r for r in rows if r[4]), key=lambda r: (r[4], r[0]))
    want = replay([(i, (f, rel), n, vf, rel == "owned_by", "") for n, (i, f, rel, vf, _) in enumerate(log)])
    assert sorted(r["id"] for r in out) == sorted(r[0] for r in log)
    assert {r["id"]: r["closed_by"] for r in out if r["closed_by"]} == {i: by for i, (_, by) in want.items()}
    assert {r["id"]: r["closed_ms"] for r in out if r["closed_by"]} == {r["id"]: r["ms"] for r in spark.createDataFrame([(i, at) for i, (at, _) in want.items()], "id string, at timestamp").selectExpr("id", "unix_millis(at) AS ms").collect()}
