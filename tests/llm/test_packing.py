import random
from bisect import bisect_left, insort

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm.packing import best_fit, fill_containers, pack_documents, packing_report, plan


def one_by_one(sizes, capacity):
    """Best fit decreasing, item by item: the remaining rooms."""
    room = []
    for s in sorted(sizes, reverse=True):
        at = bisect_left(room, s)
        left = room.pop(at) if at < len(room) else capacity
        insort(room, left - s)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_histogram_equals_item_by_item(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    made = best_fit(counts, lambda s, left: 50)
    rooms = sorted(p.capacity - p.used for p in made for _ in range(p.times))
    assert rooms == one_by_one(sizes, 50)
    assert {s: sum(p.content.get(s, 0) * p.times for p in made) for s in counts} == counts


def test_plan_is_small_and_tight():
    rng = random.Random(1)
    counts = {s: rng.randrange(1, 10_000_000) for s in range(1, 2049)}
    made = plan(counts)
    total = sum(s * c for s, c in counts.items())
    unused = sum((p.capacity - p.used) * p.times for p in made)
    assert len(made) < 3 * 2048 and unused < 0.25 * total
    assert all(p.used <= p.capacity for p in made)


@pytest.mark.parametrize("rows_per_task", [7, 100_000])
def test_every_item_is_placed_once(spark, rows_per_task):
    rng = random.Random(3)
    items = [(i, rng.choice([5, 5, 5, rng.randrange(1, 64), rng.randrange(65, 300)]), 1) for i in range(400)] + [(900, 0, 1), (901, None, 1), (5, 5, 1)]
    df = spark.createDataFrame(items, "doc_id long, size int, capacity int")
    out = fill_containers(df, "doc_id", "size", capacities=(16, 64), rows_per_task=rows_per_task).collect()
    assert sum(r["n_tokens"] for r in out) == sum(s or 0 for _, s, _ in items)
    assert {r["doc_id"] for r in out if r["container_id"] is None} == {900, 901}
    bins = {}
    for r in out:
        if r["container_id"] is not None:
            bins.setdefault((r["container_id"], r["capacity"]), []).append((r["offset"], r["offset"] + r["n_tokens"]))
    assert len({c for c, _ in bins}) == len(bins)
    for (_, capacity), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    split = [r for r in out if r["doc_id"] == next(i for i, s, _ in items if s and s > 64)]
    assert sorted(r["start"] for r in split) == [64 * i for i in range(len(split))]
    report = packing_report(spark.createDataFrame(out)).collect()
    assert sum(r["n_tokens"] for r in report) == sum(s or 0 for _, s, _ in items)


def test_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "some words " * 3000, "x"), (2, "", "x"), (3, None, "x"), (4, "short", "x")], "doc_id long, text string, start string")
    out = pack_documents(df, "doc_id", "text").collect()
    assert max(r["n_tokens"] for r in out) == 2048 and {r["doc_id"] for r in out} == {1, 2, 3, 4}
    assert pack_documents(df.limit(0), "doc_id", "text").count() == 0
