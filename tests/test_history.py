import random
from datetime import datetime, timedelta

import pytest

from memlake.operators.history import appended, change_rates, history, satellites

T0 = datetime(2024, 1, 1)
SCHEMA = "id string, ent string, att string, val string, s timestamp, e timestamp, r timestamp, value string"


def brute(rows):
    best = {}
    for i, ent, att, v, s, e, r in rows:
        if s is None or (e is not None and e <= s):
            continue
        k = (ent, att, s)
        if k not in best or (r is not None, r or 0, i) > best[k][0]:
            best[k] = ((r is not None, r or 0, i), v, e)
    by = {}
    for (ent, att, s), (_, v, e) in best.items():
        by.setdefault((ent, att), []).append((s, v, e))
    out = set()
    for k, items in by.items():
        items.sort()
        versions = []
        for n, (s, v, e) in enumerate(items):
            nxt = items[n + 1][0] if n + 1 < len(items) else None
            end = min((x for x in (e, nxt) if x is not None), default=None)
            if versions and versions[-1][0] == v and versions[-1][2] == s:
                versions[-1][2] = end
            else:
                versions.append([v, s, end])
        out |= {(*k, *v) for v in versions}
    return out


@pytest.mark.parametrize("rows_per_task", [15, 100_000])
def test_versions(spark, rows_per_task):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        ent = rng.choice(["hot", "hot", "hot", "a", "b", None])
        s = rng.randrange(200)
        e = rng.choice([None, s + rng.randrange(-2, 9)])
        rows.append((f"i{i:04}", ent, rng.choice(["x", "x", "y"]), rng.choice(["1", "2", None]), s, e, rng.choice([None, rng.randrange(50)])))
    rows.append(("z", "none", "x", "1", None, None, 1))
    at = lambda m: None if m is None else T0 + timedelta(milliseconds=m)
    df = spark.createDataFrame([(i, n, a, v, at(s), at(e), at(r), "extra") for i, n, a, v, s, e, r in rows], SCHEMA)
    sat = satellites(df, "ent", "att", "val", "s", "e", "r", "id", rows_per_task)
    us = int(T0.timestamp() * 1_000_000)
    ms = lambda v: None if v is None else (v - us) // 1000
    got = [(r["ent"], r["att"], r["value"], ms(r["from_us"]), ms(r["to_us"])) for r in sat.view().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    both = history(df, "ent", "att", "val", "s", "e", "r", "id", rows_per_task)
    assert {r["att"] for r in both.fast.table.collect()} == {"x"} and {r["att"] for r in both.slow.table.collect()} == {"y"}
    split = [(r["ent"], r["att"], r["value"], ms(r["from_us"]), ms(r["to_us"])) for r in both.view().collect()]
    assert sorted(map(str, split)) == sorted(map(str, got)) and both.table().count() == sat.table.count()


def test_a_load_appends_what_changed(spark):
    at = lambda m: T0 + timedelta(milliseconds=m)
    rows = [("1", "a", "x", "p", at(0), None, at(0), ""), ("2", "a", "y", "q", at(0), None, at(0), ""), ("3", "b", "x", None, at(0), None, at(0), "")]
    stored = satellites(spark.createDataFrame(rows, SCHEMA), "ent", "att", "val", "s", "e", "r", "id").table
    load = spark.createDataFrame([("a", "x", "p2", at(5)), ("a", "y", "q", at(5)), ("b", "x", None, at(5)), ("c", "x", "new", at(5)), (None, "x", "n", at(5))], "ent string, att string, val string, t timestamp")
    new = appended(stored, load, ["ent", "att"], "val", "t")
    assert {(r["ent"], r["att"], r["value"]) for r in new.collect()} == {("a", "x", "p2"), ("c", "x", "new"), (None, "x", "n")}
    assert appended(stored.unionByName(new), load, ["ent", "att"], "val", "t").count() == 0


def test_empty_and_rates(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert satellites(df, "ent", "att", "val", "s", "e", "r", "id").view().count() == 0
    some = spark.createDataFrame([("a", "fast")] * 4 + [("a", "slow"), ("b", "slow")], "ent string, att string")
    assert {r["att"]: r["satellite"] for r in change_rates(some, "ent", "att", 1.5).collect()} == {r["att"]: r["satellite"] for r in change_rates(some, "ent", "att").collect()} == {"fast": "fast", "slow": "slow"}
