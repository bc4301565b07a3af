import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from memlake.operators.intervals import IntervalMap, merge_intervals

T0 = datetime(2024, 1, 1)


def brute(rows):
    """Periods and gaps of (key, start, end) by sorting, ends None for open."""
    far = 10**18
    out = set()
    by = {}
    for k, s, e in rows:
        if s is not None and (e is None or e > s):
            by.setdefault(k, []).append((s, far if e is None else e))
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += 1
            else:
                merged.append([s, e, 1])
        for s, e, n in merged:
            out.add((k, "period", s, None if e == far else e, n))
        for a, b in zip(merged, merged[1:]):
            out.add((k, "gap", a[1], b[0], 0))
    return out


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 10)), max_size=30))
def test_map_equals_sorting(items):
    held = IntervalMap()
    for s, d in items:
        held.insert(s, s + d)
    want = brute([("k", s, s + d) for s, d in items])
    got = {("k", "period", *p) for p in held.periods()} | {("k", "gap", *g, 0) for g in held.gaps()}
    assert got == want


def as_df(spark, rows):
    at = lambda m: None if m is None else T0 + timedelta(milliseconds=m)
    return spark.createDataFrame([(k, at(s), at(e), "x") for k, s, e in rows], "k string, s timestamp, e timestamp, n string")


def read(df):
    us = int(T0.timestamp() * 1_000_000)
    ms = lambda v: None if v is None else (v - us) // 1000
    rows = [(r["k"], r["kind"], ms(r["start_us"]), ms(r["end_us"]), r["n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("rows_per_task", [10, 40, 100_000])
def test_hot_entities_are_split_and_stitched(spark, rows_per_task):
    rng = random.Random(5)
    rows = [("hot", s := rng.randrange(3000), s + rng.choice([0, 1, 2, 5, 400 if rng.random() < 0.02 else 3])) for _ in range(600)]
    rows += [("tied", 7, 7 + i % 5) for i in range(200)] + [(None, s := rng.randrange(50), s + 4) for _ in range(30)]
    rows += [("open", 1, None), ("open", 5, 6), ("none", None, 4), ("empty", 4, 4), ("back", 5, 2)]
    assert read(merge_intervals(as_df(spark, rows), ["k"], "s", "e", rows_per_task)) == brute(rows)


def test_empty(spark):
    assert read(merge_intervals(as_df(spark, []), ["k"], "s", "e")) == set()


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=40))
def test_gaps_and_changes_follow_every_insertion(rows):
    held, there = IntervalMap(), {}
    for s, n in rows:
        log = []
        held.insert(s, s + n, log=log)
        for *row, change in log:
            there[tuple(row)] = there.get(tuple(row), 0) + change
        assert list(held.gaps()) == list(zip(held.ends[:-1], held.starts[1:]))
        now = {("period", *p) for p in held.periods()} | {("gap", *g, 0) for g in held.gaps()}
        assert {r for r, c in there.items() if c} == now and all(c in (0, 1) for c in there.values())
