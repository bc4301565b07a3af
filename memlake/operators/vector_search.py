"""Exact search of a stated set of query vectors against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Query vectors that are broadcast; larger query sets meet the documents block by block, in one plan.
MAX_QUERIES = 8192
#: Documents of a block there.
DOC_BLOCK = 65_536
DIGITS = 12


def search(queries: DataFrame, docs: DataFrame, k: int | None = 5, threshold: float = 0.0, namespace: list[str] | None = None, per: str | None = None) -> DataFrame:
    """Hits ``query_id, doc_id, score``: per query the ``k`` best of ``docs`` with cosine at least ``threshold``.

    ``queries``: ``query_id, vector``; ``docs``: ``doc_id, vector``; both with the ``namespace``
    columns, of which those null in the query match anything. ``k`` None: every hit. With ``per``, a string column of
    ``docs`` that comes out too, the ``k`` best for each of its values. Scores are
    rounded to DIGITS, equal ones rank by doc_id. A null vector, or one of another dimension than the
    query's, gives no hit; an all-zero vector scores 0. Repeated ids are hits of their own.

    Every task scans its share of the documents by matrix products and keeps its best ``k`` for each query, so
    that only these are shuffled. Query sets above MAX_QUERIES are not broadcast, see ``_meet``.
    """
    names = namespace or []
    held = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).cast("string") for c in names])
    extra = [per] if per else []
    seen = docs.select("doc_id", "vector", *[F.col(c).cast("string").alias(f"__n{i}") for i, c in enumerate(names)], *extra)
    schema = queries.select("query_id").schema
    for f in docs.select("doc_id", *extra).schema:
        schema = schema.add(f)
    schema = schema.add("score", "double")
    out = _meet(held, seen, schema, lambda q: _Hits(q, len(names), k, threshold, bool(per), to_arrow_schema(schema)))
    if k is None:
        return out
    best = Window.partitionBy("query_id", *extra).orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def first_matches(queries: DataFrame, docs: DataFrame, threshold: float, namespace: list[str] | None = None) -> DataFrame:
    """Of every document the first later query that is at least ``threshold`` alike: ``doc_id, query_id, seq, score``.

    ``queries``: ``query_id, vector, seq, text``; ``docs``: ``doc_id, vector, seq, text``. ``seq`` is a number; a
    query is later where its ``seq`` is greater, and of equal ``seq`` the smaller query id comes first. Queries
    whose text is the document's do not count (null is a text of its own). Namespaces as in ``search``.
    At most one row a document leaves a task, whatever number of queries it is like.
    """
    names = namespace or []
    held = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).cast("string") for c in names], F.col("seq").cast("long").alias("seq"), F.xxhash64("text").alias("text"))
    seen = docs.select("doc_id", "vector", *[F.col(c).cast("string").alias(f"__n{i}") for i, c in enumerate(names)], F.col("seq").cast("long").alias("seq"), F.xxhash64("text").alias("text"))
    schema = docs.select("doc_id").schema.add(queries.schema["query_id"]).add("seq", "long").add("score", "double")
    out = _meet(held.orderBy("seq", "query_id"), seen, schema, lambda q: _First(q, len(names), threshold, to_arrow_schema(schema)))
    first = out.groupBy("doc_id").agg(F.min_by(F.struct("query_id", "seq", "score"), F.struct("seq", "query_id")).alias("f"))
    return first.select("doc_id", "f.*")


def _meet(queries: DataFrame, docs: DataFrame, schema: StructType, scan: Callable) -> DataFrame:
    """All documents scanned by all queries. ``scan`` makes of a table of queries a function over batches of documents.

    Up to MAX_QUERIES queries are broadcast and the documents stay where they are. Above that both sides are cut into
    blocks by hash, and each pair of blocks meets in one task of one plan: documents are shipped once
    per block of queries.
    """
    n = queries.limit(MAX_QUERIES + 1).count()
    if n <= MAX_QUERIES:
        shared = docs.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from scan(shared.value)(batches)

        return docs.mapInArrow(run, schema)
    across, down = -(-queries.count() // MAX_QUERIES), max(1, -(-docs.count() // DOC_BLOCK))
    block = lambda column, ways: F.pmod(F.xxhash64(column), F.lit(ways)).cast("int")
    every = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    left = queries.select("*", block("query_id", across).alias("__q")).select("*", every(down).alias("__d"))
    right = docs.select("*", block("doc_id", down).alias("__d")).select("*", every(across).alias("__q"))

    def both(q: pa.Table, d: pa.Table) -> pa.Table:
        made = list(scan(q.drop_columns(["__q", "__d"]))(d.drop_columns(["__q", "__d"]).combine_chunks().to_batches())) if q.num_rows else []
        return pa.Table.from_batches(made, schema=to_arrow_schema(schema))

    return left.groupBy("__q", "__d").cogroup(right.groupBy("__q", "__d")).applyInArrow(both, schema)


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of ``rows`` at length 1, all-zero ones unchanged."""
    column = column.take(pa.array(rows))
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


class _Scan:
    """Similarities of a table of queries to batches of documents, by dimension and in blocks of queries."""

    def __init__(self, queries: pa.Table, spaces: int, threshold: float, schema: pa.Schema):
        queries = queries.combine_chunks()
        self.queries, self.threshold, self.schema = queries, threshold, schema
        self.spaces = [np.array(queries.column(2 + j).to_pylist(), dtype=object) for j in range(spaces)]
        vectors = queries.column("vector").combine_chunks() if queries.num_rows else pa.array([], pa.list_(pa.float64()))
        sizes = np.array(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=int)
        self.by = {int(d): (np.nonzero(sizes == d)[0], _matrix(vectors, np.nonzero(sizes == d)[0], int(d))) for d in np.unique(sizes)}

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, documents (as places in their tables), their similarities and which of them are hits."""
        lengths = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        for dim, (qs, q) in self.by.items():
            rows = np.nonzero(lengths == dim)[0]
            if not len(rows):
                continue
            d = _matrix(batch.column(1), rows, dim)
            theirs = [np.array(batch.column(2 + j).take(pa.array(rows)).to_pylist(), dtype=object) for j in range(len(self.spaces))]
            for at in range(0, len(qs), 256):
                mine = qs[at : at + 256]
                sims = np.round(q[at : at + 256] @ d.T, DIGITS)
                ok = sims >= self.threshold
                for own, other in zip(self.spaces, theirs):
                    for value in set(own[mine]) - {None}:
                        ok[own[mine] == value] &= (other == value)[None, :]
                yield mine, rows, sims, ok


class _Hits(_Scan):
    """The ``k`` best documents of each query (and value of the last column, with ``per``)."""

    def __init__(self, queries: pa.Table, spaces: int, k: int | None, threshold: float, per: bool, schema: pa.Schema):
        super().__init__(queries, spaces, threshold, schema)
        self.k, self.per = k, per

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            group = batch.column(batch.num_columns - 1).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if self.per else np.zeros(batch.num_rows, int)
            for mine, rows, sims, ok in self.blocks(batch):
                for g in np.unique(group[rows]):
                    at = np.nonzero(group[rows] == g)[0]
                    good, some = ok[:, at], sims[:, at]
                    if self.k is not None and len(at) > self.k:
                        good = good & (some >= np.partition(np.where(good, some, -np.inf), -self.k, axis=1)[:, -self.k][:, None])
                    qi, di = np.nonzero(good)
                    take = pa.array(rows[at[di]])
                    columns = [pa.array(mine[qi]), batch.column(0).take(take), *([batch.column(batch.num_columns - 1).take(take)] if self.per else []), pa.array(some[qi, di])]
                    kept.append(pa.Table.from_arrays(columns, names=["q", "doc", *(["per"] if self.per else []), "score"]))
            if sum(t.num_rows for t in kept) > 500_000:
                if self.k is None:
                    yield from self._out(kept)
                    kept = []
                else:
                    kept = [self._best(pa.concat_tables(kept))]
        if kept:
            yield from self._out([self._best(pa.concat_tables(kept))] if self.k is not None else kept)

    def _best(self, t: pa.Table) -> pa.Table:
        order = t.sort_by([("q", "ascending"), *([("per", "ascending")] if self.per else []), ("score", "descending"), ("doc", "ascending")])
        key = [order.column("q").to_numpy()] + ([order.column("per").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)] if self.per else [])
        first = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in key])] if len(order) else np.zeros(0, bool)
        at = np.arange(len(order))
        return order.take(np.nonzero(at - np.maximum.accumulate(np.where(first, at, 0)) < self.k)[0]) if len(order) else order

    def _out(self, kept: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(kept).combine_chunks()
        ids = self.queries.column("query_id").take(t.column("q"))
        yield from pa.Table.from_arrays([ids, *t.columns[1:]], names=self.schema.names).cast(self.schema).combine_chunks().to_batches()


class _First(_Scan):
    """Of each document the first later query; queries come in their order."""

    def __init__(self, queries: pa.Table, spaces: int, threshold: float, schema: pa.Schema):
        super().__init__(queries.sort_by([("seq", "ascending"), ("query_id", "ascending")]), spaces, threshold, schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, text = (self.queries.column(c).to_numpy() for c in ("seq", "text"))
        for batch in batches:
            n = batch.num_rows
            first, score = np.full(n, len(seq)), np.zeros(n)
            own = batch.column(batch.num_columns - 2).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            said = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for mine, rows, sims, ok in self.blocks(batch):
                ok &= (seq[mine][:, None] > own[rows][None, :]) & (text[mine][:, None] != said[rows][None, :])
                some = ok.any(0)
                at = ok.argmax(0)
                better = some & (mine[at] < first[rows])
                first[rows[better]] = mine[at[better]]
                score[rows[better]] = sims[at[better], np.nonzero(better)[0]]
            hit = np.nonzero(first < len(seq))[0]
            t = pa.Table.from_arrays([batch.column(0).take(pa.array(hit)), self.queries.column("query_id").take(pa.array(first[hit])), pa.array(seq[first[hit]]), pa.array(score[hit])], names=self.schema.names)
            yield from t.cast(self.schema).combine_chunks().to_batches()


def score_against(pairs: DataFrame, docs: DataFrame, cosine: Callable[[Column, Column], Column]) -> DataFrame:
    """``pairs`` (``vector, doc_id`` and more) with the ``score`` against the document of that id; null where it is unknown. An equi-join."""
    held = docs.select("doc_id", F.col("vector").alias("__v"))
    met = pairs.join(held, "doc_id", "left")
    return met.withColumn("score", F.when(F.col("__v").isNotNull(), cosine(F.col("vector"), F.col("__v")))).drop("__v")
