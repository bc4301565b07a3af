"""Fusing the hits of several sources: union, best per key, boost, cap, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.lexical import blend, bm25, min_max

# Which sources a strategy asks.
STRATEGIES = {
    "atomic": ("atomic",), "vector": ("vector",), "episodic": ("episodic",), "notes": ("notes",), "multi": ("atomic", "vector", "episodic", "notes"),
}
STABLE_BOOST = 0.05
RERANK_LIMIT = 20


def sources_of(strategy: str = "multi", notes: bool = True) -> tuple[str, ...]:
    """The sources a strategy asks; unknown strategies ask as ``multi``, which has notes only where there are some."""
    asked = STRATEGIES.get(strategy, STRATEGIES["multi"])
    return asked if notes or strategy == "notes" else tuple(s for s in asked if s != "notes")


def union_hits(*sources: DataFrame) -> DataFrame:
    """All sources' hits, columns by name; what a source lacks is null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def best_per_key(hits: DataFrame) -> DataFrame:
    """One hit per query and ``coalesce(path, doc_id)``: the best score, equal ones by source and id."""
    key = Window.partitionBy("query_id", F.coalesce("path", "doc_id")).orderBy(F.desc("score"), "source", "doc_id")
    return hits.withColumn("__r", F.row_number().over(key)).where("__r = 1").drop("__r")


def fuse(hits: DataFrame, cap: int) -> DataFrame:
    """Best per key, stable ones boosted, the ``cap`` best per query with their ``rank``."""
    status = F.coalesce(F.col("status") == "stable", F.lit(False))
    boosted = best_per_key(hits).withColumn("score", F.col("score") + F.when(status, F.lit(STABLE_BOOST)).otherwise(F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "doc_id")
    return boosted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def rerank(hits: DataFrame, alpha: float = 0.6, limit: int = RERANK_LIMIT, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first ``limit`` hits of each query reordered by a blend of their score and a second one; the rest stays behind them.

    ``hits``: ``query_id, query, snippet, score, rank`` (rank bounds what a query gathers). ``scorer``
    adds the column ``second`` (default: BM25 on the snippet within ``__set``); its scores are scaled per query. Where it
    leaves one null, the query keeps the order it has. The result has the blended ``score`` and the new ``rank``.
    """
    banded = hits.withColumn("__band", F.when(F.col("rank") <= limit, 0).otherwise(1)).withColumn("__set", F.struct("query_id", "__band"))
    scored = scorer(banded) if scorer else bm25(banded, "__set", "query", "snippet", "second")
    if scorer:
        failed = F.max(F.col("second").isNull() | F.isnan("second")).over(Window.partitionBy("__set"))
        scored = scored.withColumn("__failed", failed)
    else:
        scored = scored.withColumn("__failed", F.lit(False))
    scored = min_max(scored, "__set", "second", "second")
    scored = scored.withColumn("score", F.when((F.col("__band") == 0) & ~F.col("__failed"), blend(F.col("score"), F.col("second"), alpha)).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy("__band", F.when((F.col("__band") == 0) & ~F.col("__failed"), -F.col("score")), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("__band", "__set", "second", "__failed")
