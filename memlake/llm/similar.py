"""The most similar vectors of every vector: cells and lists scanned adaptively by dimension.

Two levels. Cells: k-means centroids fitted on a bounded sample, in number proportional to the rows;
every vector is shipped to the ``probes`` nearest cells of its store, and two vectors meet in each
cell they share. Lists: each task cuts its cell into lists of about LIST_ROWS and looks for a vector in
the lists nearest to it, so that the work of a row does not grow with its cell. How many are probed
is tested, not assumed: of cells with a bounded set of vectors searched exactly among all rows, of
lists with vectors of the cell searched exactly in it; probes are added until few (MISSED_BY_*) of the
true hits get lost, and cells whose pairs the most probes still lose are joined. Within the probed lists
the vectors are rotated by a random orthogonal matrix and laid out in blocks of columns; after each
block a hypothesis test on the partial distance (scaled to all dimensions) abandons the candidates
that can hardly come under the threshold. What survives all blocks is computed exactly from the
original numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import skew

#: Vectors a cell is fitted for, and cells at most: the bound of what is broadcast (with 64 numbers 4 MB).
#: Above CELL_ROWS * MAX_CELLS rows (134 million) cells hold more, and are cut into more lists.
CELL_ROWS = 8192
MAX_CELLS = 16_384
#: Sampled vectors a centroid is fitted on; the sample has at least LEAST_SAMPLE, at most PER_CENTROID * MAX_CELLS.
PER_CENTROID = 16
LEAST_SAMPLE = 16_384
#: Vectors of a list within a cell, and entries of a cell that one task holds (about 0.7 kB each); larger cells become tiles.
LIST_ROWS = 64
TILE = 131_072
BLOCK = 16
#: Vectors searched exactly to test the cells, and within each cell its lists; the shares of true hits that may get lost by either.
TESTED = 1024
TESTED_IN_CELL = 512
MISSED_BY_CELLS = 0.005
MISSED_BY_LISTS = 0.001
LEAST_PROBES, MOST_PROBES = 2, 3
#: Lists of a cell a vector may stand in.
MOST_SHARED = 8
EPSILON = 2.1
DIGITS = 9


@dataclass
class Index:
    """Centroids by level (a level has twice those of the one below), the cell of each centroid, and the level of each store.

    Stores without an entry are one cell. ``tiles``: how many blocks the entries of a large cell are cut into.
    At most 2 * MAX_CELLS centroids and MAX_CELLS stores and tiles, whatever the data.
    """

    books: dict[int, np.ndarray]
    cells: dict[int, np.ndarray]
    levels: dict[str | None, int]
    tiles: dict[tuple[str | None, int], int]
    probes: int

    def enter(self, level: int, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The cells of the nearest centroids of each vector, nearest first, each once, filled up with -1."""
        if not level:
            return np.zeros((len(x), 1), dtype=np.int64)
        return _once(self.cells[level][_nearest(x, self.books[level], probes or self.probes)])

    def entries(self, levels: np.ndarray, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """``enter`` for vectors of several levels."""
        wide = np.full((len(x), probes or self.probes), -1, dtype=np.int64)
        for level in np.unique(levels):
            mine = levels == level
            near = self.enter(int(level), x[mine], probes)
            wide[np.nonzero(mine)[0], : near.shape[1]] = near
        return wide


def usable(vector: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite numbers that are not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def vector_keys(vector: Column, dim: int) -> dict[str, Column]:
    """Columns by which equal vectors are grouped, and whether the vector takes part."""
    v = vector.cast("array<float>")
    return {"k1": F.xxhash64(v), "k2": F.xxhash64(F.lit(1), v), "usable": usable(v, dim)}


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of ``x`` (rows come in no order)."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(x[order], first, axis=0)
        c = _unit(c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest centroids of each vector, nearest first."""
    most = min(most, len(c))
    out = np.empty((len(x), most), dtype=np.int64)
    step = max(64, 2**22 // len(c))
    for i in range(0, len(x), step):
        far = -(x[i : i + step] @ c.T)
        if most == 1:
            out[i : i + step, 0] = far.argmin(1)
            continue
        some = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(c) else np.broadcast_to(np.arange(len(c)), far.shape)
        out[i : i + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1), axis=1)
    return out


def _once(cells: np.ndarray) -> np.ndarray:
    """Each row's cells without repetitions, the first occurrence kept, -1 for the others."""
    cells = cells.copy()
    for j in range(1, cells.shape[1]):
        cells[(cells[:, :j] == cells[:, j : j + 1]).any(1), j] = -1
    return cells


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do the rows of two tables of cells share one?"""
    return ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))


def _share_drawn(rows: DataFrame, share: float) -> DataFrame:
    """About that share of the distinct vectors, by hash of the vector: copies are drawn together."""
    return rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 24)) < int(share * (1 << 24)) + 1)


def fit_index(rows: DataFrame, dim: int, least: float = 0.85, k: int = 10) -> Index:
    """Fits the cells for searches of ``k`` neighbours at least ``least`` alike among ``rows`` (``store, v``).

    Centroids come from a sample of bounded size. A store above CELL_ROWS rows gets the level whose centroids are one
    for at most that many of its rows; the test searches TESTED sampled vectors exactly in all rows.
    """
    sizes = {r["store"]: r["count"] for r in rows.groupBy("store").count().where(F.col("count") > CELL_ROWS).orderBy(F.desc("count"), "store").limit(MAX_CELLS).collect()}
    total = sum(sizes.values())
    if not total:
        return Index({}, {}, {}, {}, 1)
    per = max(CELL_ROWS, total / MAX_CELLS)
    levels = {s: math.ceil(math.log2(n / per)) for s, n in sizes.items() if n > per}
    index = Index({}, {}, levels, {}, MOST_PROBES)
    if not levels:
        return index
    most = min(PER_CENTROID * MAX_CELLS, max(LEAST_SAMPLE, PER_CENTROID * 2 ** max(levels.values())))
    drawn = _share_drawn(rows.where(F.col("store").isin([s for s in levels if s is not None]) | (F.col("store").isNull() if None in levels else F.lit(False))), min(1.0, most / total))
    taken = drawn.select("store", "v").limit(2 * most).toArrow().combine_chunks()
    stores = np.array(taken.column(0).to_pylist(), dtype=object)
    x = _unit(taken.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(stores), dim).astype(np.float32))
    x, first = np.unique(x, axis=0, return_index=True)
    shuffled = np.random.default_rng(3).permutation(len(x))
    x, stores = x[shuffled], stores[first][shuffled]
    for level in sorted(set(levels.values())):
        index.books[level] = _kmeans(x, min(2**level, len(x)))
        index.cells[level] = np.arange(len(index.books[level]))
    _test(rows, index, x[:TESTED], stores[:TESTED], least, k)
    mine = np.array([levels[s] for s in stores])
    wide = index.entries(mine, x)
    r, c = np.nonzero(wide >= 0)
    codes = {s: i for i, s in enumerate(levels)}
    at, seen = np.unique(np.array([codes[s] for s in stores])[r] * np.int64(2 * MAX_CELLS) + wide[r, c], return_counts=True)
    names = list(levels)
    for key, n in zip(at, seen * (total / max(1, len(x)))):
        if n > TILE:
            index.tiles[names[key // (2 * MAX_CELLS)], int(key % (2 * MAX_CELLS))] = math.ceil(n / TILE)
    return index


def _test(rows: DataFrame, index: Index, x: np.ndarray, stores: np.ndarray, least: float, k: int) -> None:
    """Sets the probes of ``index``, and joins cells, by the true hits of ``x`` among all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast((index, x, stores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, q, owner = shared.value
        code = {s: i for i, s in enumerate(dict.fromkeys(owner))}
        mine = np.array([code[s] for s in owner])
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, MOST_PROBES), np.int64))]
        for batch in batches:
            level, theirs = _of_stores(batch.column(0), idx, code)
            v = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float32))
            cos = q @ v.T
            # equal vectors share every cell and tell nothing
            qi, ci = np.nonzero((cos >= least) & (cos < 1 - 1e-6) & (mine[:, None] == theirs[None, :]))
            if not len(qi):
                continue
            kept.append((qi, cos[qi, ci].astype(float), idx.entries(level[ci], v[ci], MOST_PROBES)))
            if sum(len(p[0]) for p in kept) > 50_000:
                kept = [_firsts(*(np.concatenate(p) for p in zip(*kept)), k)]
        qi, cos, near = _firsts(*(np.concatenate(p) for p in zip(*kept)), k)
        yield pa.RecordBatch.from_arrays([pa.array(qi.astype(np.int32)), pa.array(-cos), pa.array(near.tolist(), pa.list_(pa.int64()))], names=["q", "far", "near"])

    hits = rows.select("store", "v").mapInArrow(run, "q int, far double, near array<long>").distinct()
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("far", "near"))).where(F.col("r") <= k).select("q", "near").toArrow()
    q = hits.column("q").to_numpy()
    if not len(q):
        index.probes = LEAST_PROBES + 1
        return
    theirs = np.array(hits.column("near").to_pylist(), dtype=np.int64)
    own = np.array([index.levels[s] for s in stores])
    ours = index.entries(own, x, MOST_PROBES)[q]
    for probes in range(LEAST_PROBES, MOST_PROBES + 1):
        index.probes = probes
        lost = ~_meet(ours[:, :probes], theirs[:, :probes])
        if lost.sum() <= MISSED_BY_CELLS * len(q):
            return
    for level in np.unique(own[q[lost]]):
        at = lost & (own[q] == level)
        index.cells[level] = _joined(len(index.books[level]), ours[at, 0], theirs[at, 0], MISSED_BY_CELLS * (own[q] == level).sum())


def _firsts(q: np.ndarray, cos: np.ndarray, near: np.ndarray, k: int):
    """The ``k`` most similar hits of each query."""
    q, c, cos, _ = _top(q, np.arange(len(q)), cos, np.arange(len(q)), k)
    return q, cos, near[c]


def _joined(n: int, a: np.ndarray, b: np.ndarray, may: float) -> np.ndarray:
    """The cell of each of ``n`` centroids: cells are joined, those with most lost pairs first, until at most ``may`` pairs stay apart."""
    label = np.arange(n)
    (a, b), weight = np.unique(np.sort(np.stack([a, b]), axis=0), axis=1, return_counts=True)
    for i in np.argsort(-weight, kind="stable"):
        if label[a[i]] != label[b[i]]:
            if weight[label[a] != label[b]].sum() <= may:
                break
            label[label == label[b[i]]] = label[a[i]]
    return np.unique(label, return_inverse=True)[1]


def _of_stores(column: pa.Array, index: Index, code: dict) -> tuple[np.ndarray, np.ndarray]:
    """The level of each row's store and its number in ``code`` (-1 if it has none), looked up once per store of the batch."""
    coded = column.dictionary_encode(null_encoding="encode")
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    of = lambda table, none: np.array([table.get(s, none) for s in names], dtype=np.int64)[at]
    return of(index.levels, 0), of(code, -1)


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).normal(size=(dim, dim)))[0].astype(np.float32)


def _top(q: np.ndarray, c: np.ndarray, cos: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best pairs of each query by cosine, then ``tie`` of the candidate, in order, with their ranks."""
    order = np.lexsort((tie[c], -cos, q))
    q, c, cos = q[order], c[order], cos[order]
    at = np.arange(len(q))
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) if len(q) else at
    keep = rank < k
    return q[keep], c[keep], cos[keep], rank[keep]


def _scan(rot: np.ndarray, exact: np.ndarray, queries: np.ndarray, cands: np.ndarray, least: float, k: int, tie: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best pairs (query, candidate, cosine) of each query at least ``least`` alike, by adaptive dimension scan.

    Candidates come in chunks; once a query has ``k`` hits its threshold tightens to the k-th, in ``bound``
    (squared distances, one per vector) too, and no more than ``k`` hits a query are held from one chunk to the next.
    """
    dim = rot.shape[1]
    blocks = [rot[:, i : i + BLOCK] for i in range(0, dim, BLOCK)]
    if bound is None:
        bound = np.full(len(rot), 2 - 2 * least + 1e-5, dtype=np.float32)
    # squared partial distances of the first block less what is allowed, by one matrix product
    head = blocks[0]
    seen = head.shape[1]

    def beside(at: np.ndarray, scale: float, last: float | np.ndarray, norm_first: bool) -> np.ndarray:
        mine = head[at]
        norm = (mine**2).sum(1, keepdims=True)
        one = np.ones_like(norm)
        return np.concatenate([scale * mine, norm if norm_first else one, one if norm_first else norm - last], axis=1)

    first_slack = np.float32((seen / dim) * (1 + EPSILON / math.sqrt(seen)) ** 2)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q0 in range(0, len(queries), 1024):
        q = queries[q0 : q0 + 1024]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for c0 in range(0, len(cands), 4096):
            c = cands[c0 : c0 + 4096]
            seen = head.shape[1]
            limit = bound[q][:, None] * first_slack
            part = beside(q, 1, limit, False) @ beside(c, -2, 0, True).T
            qi, ci = np.divmod(np.flatnonzero(part <= 0), len(c))
            more = blocks[1:]
            if len(qi) * 8 > part.size and more:  # dense: all columns at once cost less than pair by pair
                part = 2 - 2 * (rot[q] @ rot[c].T)
                part[q[:, None] == c[None, :]] = np.inf
                most = np.minimum(bound[q], np.partition(part, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1] + 2e-5)
                (qi, ci), more = np.nonzero(part <= most[:, None]), []
            d, qi, ci = part[qi, ci] + (limit[qi, 0] if more else 0), q[qi], c[ci]
            keep = qi != ci
            d, qi, ci = d[keep], qi[keep], ci[keep]
            for b in more:
                d = d + ((b[qi] - b[ci]) ** 2).sum(1)
                seen += b.shape[1]
                slack = 1.0 if seen == dim else (seen / dim) * (1 + EPSILON / math.sqrt(seen)) ** 2
                keep = d <= bound[qi] * slack + 1e-5
                d, qi, ci = d[keep], qi[keep], ci[keep]
            cos = np.round((exact[qi].astype(np.float64) * exact[ci]).sum(1), DIGITS)
            keep = cos >= least
            if keep.any():
                merged = (np.concatenate(x) for x in zip(best, (qi[keep], ci[keep], cos[keep])))
                *best, rank = _top(*merged, tie, k)
                kth = rank == k - 1
                bound[best[0][kth]] = np.minimum(bound[best[0][kth]], 2 - 2 * best[2][kth] + 1e-5)
        out.append(tuple(best))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, int) for i in range(3))


def _lists(x: np.ndarray, least: float, k: int) -> tuple[np.ndarray, int, int]:
    """The lists nearest to each vector of a cell, how many of them it stands in, and in how many it looks.

    Tested on vectors of the cell that are searched exactly in it: at most MISSED_BY_LISTS of their true hits may get lost.
    Vectors stand and look in equally many lists, or, where that costs less, as in a dense group, stand in one and look in many.
    """
    n = len(x)
    lists = n // LIST_ROWS
    if lists < 3:
        return np.zeros((n, 1), dtype=np.int64), 1, 1
    spaced = np.unique(np.linspace(0, n - 1, min(n, PER_CENTROID * lists)).astype(int))
    c = _kmeans(x[spaced], lists, 4)
    near = _nearest(x, c, min(lists, MOST_SHARED))
    tested = np.unique(np.linspace(0, n - 1, min(n, TESTED_IN_CELL)).astype(int))
    order = np.argsort(-(x[tested] @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(tested), 64):
        t = tested[i : i + 64]
        cos = x[t] @ x.T
        cos[np.arange(len(t)), t] = -2
        for r in np.nonzero((cos >= least).sum(1) > k)[0]:
            cos[r, np.argpartition(-cos[r], k - 1)[k:]] = -2
        r, hit = np.nonzero(cos >= least)
        left.append(i + r), right.append(hit)
    left, right = np.concatenate(left), np.concatenate(right)
    may = int(MISSED_BY_LISTS * len(left))
    needed = np.sort(place[left, near[right, 0]])
    look = 3 if not len(left) else int(needed[len(left) - 1 - may]) + 1
    for p in range(2, near.shape[1] + 1):
        if p * p >= look:
            break
        if (~_meet(near[tested[left], :p], near[right, :p])).sum() <= may:
            return near[:, :p], p, p
    return _nearest(x, c, look), 1, look


def _rows(df: DataFrame, id_col: str, store: str, vector: str, dim: int) -> DataFrame:
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(store).cast("string").alias("store"), F.col(vector).cast("array<float>").alias("v"))
    return rows.where(usable(F.col("v"), dim))


def most_similar(
    df: DataFrame, id_col: str, store: str, vector: str, dim: int, least: float = 0.85, k: int = 10,
    rows_per_task: int = skew.ROWS_PER_TASK, slim: DataFrame | None = None, fit_on: DataFrame | None = None,
) -> DataFrame:
    """Of every row the ``k`` other rows of its store most similar by cosine, at least ``least``: ``id, neighbour_id, similarity``.

    ``df`` has one row per ``id_col`` (rows without an id are left out). Rows whose vector is
    null, of another dimension, all zero or not finite take no part. Similarities are rounded to
    DIGITS; equal ones rank by id. Rows with equal vectors are searched once and keep their k + 1
    smallest ids, all that any answer can contain. A null store is a store of its own.
    ``slim`` may name ``df``'s rows without their vectors but with the columns of ``vector_keys``,
    and ``fit_on`` a table cheaper to read than ``df``, on which the index is fitted.
    """
    rows = _rows(df, id_col, store, vector, dim)
    keyed = rows.withColumns(vector_keys(F.col("v"), dim))
    index = fit_index(rows if fit_on is None else _rows(fit_on, id_col, store, vector, dim), dim, least, k)

    smallest = Window.partitionBy("store", "k1", "k2").orderBy("id")
    groups = keyed.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    groups = groups.groupBy("store", "k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))

    entries = groups.select("store", "ids", "v").mapInArrow(_enter(rows, index), "store string, cell int, a int, b int, block int, cells array<int>, ids array<string>, v array<float>")
    found = entries.groupBy("store", "cell", "a", "b").applyInArrow(_search(dim, least, k), "q string, own boolean, ids array<string>, far double")
    merged = found.groupBy("q").agg(F.max("own").alias("own"), F.collect_list(F.struct("far", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct(n["far"].alias("far"), i.alias("id")))))
    merged = merged.select("q", "own", F.slice(F.sort_array(flat), 1, k + 1).alias("near"))

    if slim is not None:
        slim = slim.where(F.col(id_col).isNotNull() & F.col("usable")).select(F.col(id_col).cast("string").alias("id"), F.col(store).cast("string").alias("store"), "k1", "k2")
    members = keyed.select("id", "store", "k1", "k2") if slim is None else slim
    same = ["store", "k1", "k2"]
    firsts = members.groupBy(*same).agg(F.min("id").alias("q"), F.count("*").alias("n")).where("n > 1")
    hot = firsts.where(F.col("n") > rows_per_task).orderBy(F.desc("n")).limit(skew.MAX_HOT).collect()
    left, right, on = skew.salted(members, firsts.select(*same, "q"), same, ["id"], hot=hot)
    copies = left.join(right, skew.null_safe(left, right, on)).select(left["id"], right["q"])
    left, right, on = skew.salted(copies, merged, ["q"], ["id"], hot=hot)
    met = left.join(right, on, "right").where(F.col("id").isNotNull() | F.col("own").isNull())
    met = met.select(F.coalesce("id", "q").alias("id"), "near")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    return met.select("id", F.explode(others).alias("n")).select("id", F.col("n")["id"].alias("neighbour_id"), (-F.col("n")["far"]).alias("similarity"))


def _enter(df: DataFrame, index: Index):
    """Ships each vector to its cells; cells above TILE entries become tiles of pairs of blocks."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        code = {s: i for i, s in enumerate({s for s, _ in idx.tiles})}
        tiled = {(code[s], c): t for (s, c), t in idx.tiles.items()}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(2)
            x = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float32))
            level, store = _of_stores(batch.column(0), idx, code)
            wide = idx.entries(level, x)
            r, p = np.nonzero(wide >= 0)
            at = wide[r, p]
            tiles = np.ones(len(r), dtype=np.int64)
            if tiled:
                pairs, back = np.unique(np.stack([store[r], at]), axis=1, return_inverse=True)
                tiles = np.array([tiled.get((int(a), int(b)), 1) for a, b in pairs.T])[back.ravel()]
            own = (np.abs((x[r] * 1e6).astype(np.int64).sum(1) * 2654435761) >> 7) % tiles
            # a tile of an entry for each block of its cell, its own included
            sel = np.repeat(np.arange(len(r)), tiles)
            other = np.arange(len(sel)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            mine = own[sel]
            i32 = lambda values: pa.array(values.astype(np.int32))
            take = pa.array(r[sel])
            some = (wide >= 0).sum(1)
            packed = np.sort(np.where(wide < 0, np.iinfo(np.int32).max, wide), axis=1)
            cells = pa.ListArray.from_arrays(i32(np.r_[0, np.cumsum(some)]), i32(packed[np.arange(packed.shape[1])[None, :] < some[:, None]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), i32(at[sel]), i32(np.minimum(other, mine)), i32(np.maximum(other, mine)), i32(mine), cells.take(take), batch.column(1).take(take), v.take(take)],
                names=["store", "cell", "a", "b", "block", "cells", "ids", "v"],
            )

    return run


def _search(dim: int, least: float, k: int):
    """Scans a cell, or two blocks of a large one. A pair is reported in the first cell its vectors share."""
    out = pa.schema([("q", pa.string()), ("own", pa.bool_()), ("ids", pa.list_(pa.string())), ("far", pa.float64())])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        n = tile.num_rows
        v = tile.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        # lengths in double precision, so that cosines are exact to DIGITS
        exact = v.astype(np.float64)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        x = exact.astype(np.float32)
        rot = x @ _rotation(dim)
        ids = tile.column("ids").combine_chunks()
        lead = ids.flatten().take(ids.offsets[:-1]).to_pylist()
        here, a, b = (tile.column(c)[0].as_py() for c in ("cell", "a", "b"))
        block = tile.column("block").to_numpy()
        held = tile.column("cells").combine_chunks()
        size = held.value_lengths().to_numpy(zero_copy_only=False)
        cells = np.full((n, size.max()), -1, dtype=np.int32)
        cells[np.arange(cells.shape[1])[None, :] < size[:, None]] = held.flatten().to_numpy(zero_copy_only=False)
        tie = np.argsort(np.argsort(np.array(lead, dtype=object), kind="stable"), kind="stable")
        bound = np.full(n, 2 - 2 * least + 1e-5, dtype=np.float32)
        near, stand, look = _lists(x, least, k)
        by = lambda lists: (np.argsort(lists.ravel(), kind="stable") // lists.shape[1], np.r_[0, np.cumsum(np.bincount(lists.ravel(), minlength=near.max() + 1))])
        (members, m), (looking, q) = by(near[:, :stand]), by(near[:, :look])
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        parts, waiting = [], 0
        for i in range(len(m) - 1):
            qi, ci, cos = _scan(rot, exact, looking[q[i] : q[i + 1]], members[m[i] : m[i + 1]], least, k, tie, bound)
            if stand > 1:  # once, in the first list the two share
                both = (near[qi][:, :, None] == near[ci][:, None, :]).any(2)
                once = np.where(both, near[qi], near.max() + 1).min(1) == i
                qi, ci, cos = qi[once], ci[once], cos[once]
            parts.append((qi, ci, cos))
            waiting += len(qi)
            if waiting > 500_000 or i == len(m) - 2:
                best = _top(*(np.concatenate(p) for p in zip(best, *parts)), tie, k)[:3]
                parts, waiting = [], 0
        qi, ci, cos = best
        if a != b:
            keep = block[qi] != block[ci]
            qi, ci, cos = qi[keep], ci[keep], cos[keep]
        if len(qi):
            both = (cells[qi][:, :, None] == cells[ci][:, None, :]).any(2) & (cells[qi] >= 0)
            first = np.where(both, cells[qi], np.iinfo(np.int32).max).min(1)
            keep = first == here
            qi, ci, cos = qi[keep], ci[keep], cos[keep]
        several = (ids.value_lengths().to_numpy(zero_copy_only=False) > 1) & (cells[:, 0] == here) & (a == b)
        copies = np.nonzero(several)[0]
        q, c = np.r_[qi, copies].astype(np.int64), np.r_[ci, copies].astype(np.int64)
        flag = pa.array(np.r_[np.zeros(len(qi), bool), np.ones(len(copies), bool)], mask=np.r_[np.ones(len(qi), bool), np.zeros(len(copies), bool)])
        return pa.Table.from_arrays([pa.array(lead, pa.string()).take(pa.array(q)), flag, ids.take(pa.array(c)), pa.array(np.r_[-cos, -np.ones(len(copies))])], schema=out)

    return run
