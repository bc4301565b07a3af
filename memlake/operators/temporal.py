"""Bi-temporal rows: reads at a point in time, superseding, retraction, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.predicates import valid_at, valid_now
from memlake.operators import skew


def edges_where(edges: DataFrame, from_node: str | None = None, to_node: str | None = None, rel: str | None = None, as_of: Column | None = None, include_invalid: bool = False, limit: int | None = None) -> DataFrame:
    """Edges by endpoint, relation and validity: open ones, or those valid at ``as_of``; ``include_invalid`` overrides both. ``limit``: the first so many by id."""
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        return edges_where(edges, from_node, to_node, rel, as_of, include_invalid).orderBy("id").limit(limit)
    for name, value in (("from_node", from_node), ("to_node", to_node), ("rel", rel)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    if include_invalid:
        return edges
    if as_of is not None:
        return edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of))
    return edges.where(valid_now(F.col("valid_to")))


def supersede(log: DataFrame, keys: list[str], seq: str, row_id: str, valid_from: str, supersedes: Column, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Each row's closure by later rows of its key: ``closed_at`` and ``closed_by`` (null: open).

    A row is closed by the first later row, in ``seq`` (a number unique within a key), that
    supersedes, at that row's ``valid_from``. The set form of replaying the log; backdated rows may
    give empty or negative validity, which no point in time meets. Null keys form keys of their own.
    """
    return superseded(log, keys, seq, row_id, valid_from, supersedes, skew.find_hot(log, keys, seq, rows_per_task), seq)


def superseded(log: DataFrame, keys: list[str], seq: str, row_id: str, valid_from: str, supersedes: Column, hot: skew.HotKeys | None, cut_by: str) -> DataFrame:
    """``supersede`` with the hot keys known already, cut by ``cut_by``, which never falls as ``seq`` grows."""
    rows = hot.bucketed(log, cut_by) if hot else log
    closer = F.when(supersedes, F.struct(F.col(valid_from).alias("at"), F.col(row_id).alias("by")))
    rows = skew.next_value(rows, keys, seq, closer, "__close", hot)
    return rows.withColumns({"closed_at": F.col("__close")["at"], "closed_by": F.col("__close")["by"]}).drop("__close", "__bucket")


def first_closure(closures: DataFrame, row_id: str, seq: str) -> DataFrame:
    """Of all closures of a row (superseding or retracting) the first in the log: ``row_id, closed_at, closed_by``."""
    return closures.groupBy(row_id).agg(F.min_by(F.struct("closed_at", "closed_by"), seq).alias("c")).select(row_id, "c.*")


def apply_patches(rows: DataFrame, patches: DataFrame, row_id: str, seq: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns of their patches laid over them, the latest non-null value of each column winning.

    Patches of unknown ids change nothing. Rows are unique by id; the patches of an id are folded by
    a map-side aggregation before they meet it.
    """
    last = patches.groupBy(row_id).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in columns])
    met = rows.join(last, row_id, "left")
    return met.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def resolve_conflicts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closures and pointers of a batch of new facts.

    ``pairs``: ``new_id, new_seq, new_valid_from, old_id, score`` of new facts and the earlier rows
    they contradict. Every old row is closed by the first new fact in ``new_seq``; each new fact points
    to the old row of greatest score among those it closed (equal: smaller id).
    First result: ``old_id, valid_to, superseded_by``; second: ``new_id, supersedes, n_closed``.
    """
    closed = pairs.groupBy("old_id").agg(F.min_by(F.struct("new_valid_from", "new_id", "score"), F.struct("new_seq", "new_id")).alias("c"))
    closed = closed.select("old_id", F.col("c.new_valid_from").alias("valid_to"), F.col("c.new_id").alias("superseded_by"), F.col("c.score").alias("score"))
    back = closed.groupBy(F.col("superseded_by").alias("new_id")).agg(F.min_by("old_id", F.struct(-F.col("score"), "old_id")).alias("supersedes"), F.count("*").alias("n_closed"))
    return closed.drop("score"), back
