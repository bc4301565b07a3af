import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import similar
from memlake.llm.similar import fit_index, most_similar

SCHEMA = "id string, store string, v array<float>, similarity double"


def brute(rows, least, k):
    out = {}
    good = [(i, s, np.array(v, dtype=np.float32).astype(float)) for i, s, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.all(np.isfinite(v)) and np.any(v)]
    for i, s, v in good:
        near = []
        for j, t, w in good:
            if j != i and s == t:
                c = round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                if c >= least:
                    near.append((-c, j))
        out[i] = [j for _, j in sorted(near)[:k]]
    return {(i, j) for i, near in out.items() for j in near}


def made(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 8))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=8) * 0.25
        rows.append((f"r{i:05}", rng.choice(["a", "b", None], p=[0.7, 0.2, 0.1]), [float(x) for x in v], 0.0))
    one = [float(x) for x in rng.normal(size=8)]
    rows += [(f"c{i:05}", "a", one, 0.0) for i in range(copies)]
    rows += [("twice", "a", [2 * x for x in one], 0.0), ("null", "a", None, 0.0), ("zero", "a", [0.0] * 8, 0.0), ("short", "a", [1.0], 0.0), (None, "a", one, 0.0)]
    rows += [("nan", "a", [float("nan")] * 8, 0.0), ("inf", "a", [float("inf")] * 8, 0.0), ("gap", "a", [None] + one[1:], 0.0), ("empty", "a", [], 0.0)]
    return [(i, None if s is None else str(s), v, x) for i, s, v, x in rows]


def found(spark, rows, **options):
    got = most_similar(spark.createDataFrame(rows, SCHEMA), "id", "store", "v", 8, **options).collect()
    assert len({(r["id"], r["neighbour_id"]) for r in got}) == len(got)
    return {(r["id"], r["neighbour_id"]) for r in got}


@pytest.mark.parametrize("rows_per_task", [20, 100_000])
def test_equals_brute_force(spark, rows_per_task):
    rows = made(1, 300, copies=60)
    assert found(spark, rows, least=0.85, k=5, rows_per_task=rows_per_task) == brute(rows, 0.85, 5)


def test_cells_lists_and_tiles_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL_ROWS", 256)
    monkeypatch.setattr(similar, "LIST_ROWS", 16)
    monkeypatch.setattr(similar, "TILE", 100)
    rows = made(2, 1500, copies=40)
    got, want = found(spark, rows, least=0.9, k=5), brute(rows, 0.9, 5)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_cells_grow_with_each_store(spark, monkeypatch):
    df = spark.createDataFrame(made(3, 1400), SCHEMA).where("v is not null").where("size(v) = 8").where(similar.usable(F.col("v"), 8)).select("store", "v")
    assert fit_index(df, 8).levels == {} and fit_index(df.limit(0), 8).levels == {}
    monkeypatch.setattr(similar, "CELL_ROWS", 128)
    index = fit_index(df, 8)
    sizes = {r["store"]: r["count"] for r in df.groupBy("store").count().collect()}
    assert {s: n for s, n in sizes.items() if n > 128}.keys() == index.levels.keys() and None in index.levels
    for s, level in index.levels.items():
        assert sizes[s] / 128 <= len(index.books[level]) < sizes[s] / 64


def work(n: int, monkeypatch) -> tuple[float, float]:
    """Entries shipped, and pairs whose first block is compared, for ``n`` vectors in groups of ten."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 10, 64))
    x = similar._unit((centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, 64)) * 0.35).astype(np.float32))
    c = similar._kmeans(x, max(1, n // similar.CELL_ROWS))
    wide = similar._nearest(x, c, 3)
    pairs = 0
    for cell in range(len(c)):
        near, stand, look = similar._lists(x[(wide == cell).any(1)], 0.85, 10)
        pairs += (np.bincount(near[:, :stand].ravel(), minlength=near.max() + 1) * np.bincount(near[:, :look].ravel(), minlength=near.max() + 1)).sum()
    return wide.size, pairs


def test_shipping_and_pairs_grow_with_the_rows(monkeypatch):
    monkeypatch.setattr(similar, "CELL_ROWS", 2048)
    (e1, p1), (e2, p2) = work(10_000, monkeypatch), work(80_000, monkeypatch)
    assert np.log(e2 / e1) / np.log(8) <= 1.1 and np.log(p2 / p1) / np.log(8) <= 1.1


def test_dense_cell_falls_back_to_many_lists():
    rng = np.random.default_rng(8)
    x = similar._unit((rng.normal(size=64) + rng.normal(size=(4000, 64)) * 0.4).astype(np.float32))
    near, stand, look = similar._lists(x, 0.85, 10)
    assert stand == 1 and look > 20


def test_empty(spark):
    assert found(spark, []) == set()


def test_scan_abandons_without_losing(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 64))
    x[:300] = x[300:600] + rng.normal(size=(300, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rot = x.astype(np.float32) @ similar._rotation(64)
    every = np.arange(900)
    q, c, cos = similar._scan(rot, x, every, every, 0.85, 10, every)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.85)) if i != j}
    got = set(zip(q.tolist(), c.tolist()))
    assert len(want) > 300 and len(got & want) >= 0.99 * len(want) and np.all(cos >= 0.85)


def test_scan_holds_only_the_best_of_a_dense_group():
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + rng.normal(size=(5000, 64)) * 0.05
    x[4000:] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every = np.arange(5000)
    q, c, cos = similar._scan(x.astype(np.float32) @ similar._rotation(64), x, every[:50], every, 0.85, 3, every)
    assert len(q) == 150
    sims = np.round(x[:50] @ x.T, 9)
    sims[np.arange(50), np.arange(50)] = -1
    for i in range(50):
        want = sorted(every, key=lambda j: (-sims[i, j], j))[:3]
        assert sorted(c[q == i].tolist()) == sorted(int(j) for j in want)


def test_dense_group_over_many_lists_keeps_recall(spark, monkeypatch):
    """A third of the rows in one dense, not identical group of about 30 lists; the rest in small groups."""
    monkeypatch.setattr(similar, "CELL_ROWS", 128)
    monkeypatch.setattr(similar, "LIST_ROWS", 16)
    rng = np.random.default_rng(6)
    middle = rng.normal(size=64)
    blob = middle / np.linalg.norm(middle) + rng.normal(size=(2000, 64)) * (0.15 / 0.87 / 64) ** 0.5
    centres = rng.normal(size=(400, 64))
    rest = centres[rng.integers(400, size=4000)] + rng.normal(size=(4000, 64)) * 0.3
    x = np.concatenate([blob, rest]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cos, -1)
    best = np.argsort(-cos, axis=1, kind="stable")[:, :10]
    want = {(f"r{i:05}", f"r{j:05}") for i in range(len(x)) for j in best[i] if cos[i, j] >= 0.85}
    df = spark.createDataFrame([(f"r{i:05}", "a", v.tolist(), 0.0) for i, v in enumerate(x)], SCHEMA)
    got = {(r["id"], r["neighbour_id"]) for r in most_similar(df, "id", "store", "v", 64).collect()}
    for part in (lambda i: i < "r02000", lambda i: i >= "r02000"):
        there, right = {p for p in want if part(p[0])}, {p for p in got if part(p[0])}
        assert len(there) > 15_000 and len(there & right) >= 0.99 * len(there) and len(right - there) <= 0.01 * len(there)
