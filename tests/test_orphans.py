import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from memlake.operators.bloom import BloomFilter
from memlake.operators.orphans import find_orphans, orphan_report

T0 = datetime(2024, 1, 1)
REFS = "src_table string, src_field string, target_table string, src_id string, target string, at timestamp, kind string"
PARENTS = "target_table string, target string, first_seen timestamp, deleted boolean"


@pytest.mark.parametrize("rows_per_task", [20, 100_000])
def test_kinds(spark, rows_per_task):
    rng = random.Random(1)
    parents = [("n", f"k{i}", rng.choice([None, T0 + timedelta(days=rng.randrange(90))]), i % 7 == 0) for i in range(200)]
    known = {(t, k): (f, d) for t, k, f, d in parents}
    refs = [("s", "f", rng.choice(["n", "m"]), f"r{i}", rng.choice(["k1", "k7", f"k{rng.randrange(260)}", "", None]), rng.choice([None, T0 + timedelta(days=rng.randrange(90))]), "clash") for i in range(800)]
    want = set()
    for _, f, t, s, k, at, _ in refs:
        if k:
            first, gone = known.get((t, k), (None, None))
            kind = "missing" if (t, k) not in known else "deleted" if gone else "late" if first and at and first > at else None
            if kind:
                want.add(("s", f, s, k, kind, at and at.strftime("%Y-%m")))
    out = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), 200, rows_per_task)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(r["n_refs"] for r in orphan_report(out).collect()) == len(want)


def test_empty(spark):
    assert find_orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS), 0).count() == 0


def test_filter_never_denies_a_key_and_stays_bounded(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "h long")
    bloom = BloomFilter.build(df, "h", 5000)
    assert bloom.might_contain(keys).all()
    assert bloom.might_contain(rng.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.02
    assert BloomFilter({}, 1024).might_contain(keys).sum() == 0
