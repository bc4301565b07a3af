"""Append-only logs: the current row per id, and first-seen times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NEVER = "TIMESTAMP '0001-01-01 00:00:00'"


def current_rows(
    df: DataFrame, id_col: str, time_col: str, columns: list[str], first_seen: str | None = None, tag: bool = False
) -> DataFrame:
    """One row per ``id_col``: the row with the latest ``time_col``, reduced to ``columns``.

    One shuffle with map-side partial aggregation, so an id repeated in a third of
    all rows collapses before it moves. Fully equal rows count once. Rows without an
    id have no identity and are left out; a row without a time loses against any row
    that has one. ``first_seen`` names a further column with the earliest time of any
    row of the id. Where different rows of an id share the latest time one of them is
    kept (the log format rules this out).
    """
    order = F.coalesce(F.col(time_col), F.expr(_NEVER))
    rest = [c for c in columns if c != id_col]
    aggs = [F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("__row")]
    if first_seen:
        aggs.append(F.min(time_col).alias(first_seen))
    out = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*aggs)
    return out.select(id_col, *[F.col("__row")[c].alias(c) for c in rest], *([first_seen] if first_seen else []))


def current_where(df: DataFrame, id_col: str, time_col: str, keep: Column, columns: list[str]) -> DataFrame:
    """The current rows (see ``current_rows``) for which ``keep`` holds, reduced to ``columns``.

    For wide rows of which few are wanted: only ids and times of all rows are shuffled,
    and the wide columns of rows that satisfy ``keep``.
    """
    order = F.coalesce(F.col(time_col), F.expr(_NEVER))
    latest = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(order).alias("__t"))
    wide = df.where(F.col(id_col).isNotNull() & keep).select(*dict.fromkeys([id_col, *columns]), order.alias("__t"))
    return wide.join(latest, [id_col, "__t"], "left_semi").dropDuplicates([id_col]).drop("__t")
