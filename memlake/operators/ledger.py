"""Logs of usage, audits and measurements: totals, percentiles, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import contains_snippet
from memlake.operators import skew


def usage_totals(log: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Calls and sums by ``by`` and, with null keys and ``grand`` true, over everything."""
    out = log.rollup(*by).agg(F.count("*").alias("calls"), *[F.sum(c).alias(n) for n, c in sums.items()], F.grouping_id().alias("__g"))
    return out.where(F.col("__g").isin(0, 2 ** len(by) - 1)).withColumn("grand", F.col("__g") > 0).drop("__g")


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: list[float], rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Exact percentiles by rank, ``sorted[floor(p / 100 * (n - 1))]``: ``by, percent, value``. Null values do not count.

    Equal values are counted before the shuffle; large groups are accumulated bucket by bucket.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    hot = skew.find_hot(counts, by, value, rows_per_task) if dict(counts.dtypes)[value] in ("bigint", "int") else None
    parts = [*by, "__bucket"] if hot else by
    cut = hot.bucketed(counts, value) if hot else counts
    upto = F.sum("__n").over(Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    run = cut.withColumn("__upto", upto)
    if hot:
        base = cut.groupBy(*parts).agg(F.sum("__n").alias("__b")).withColumn("__base", F.coalesce(F.sum("__b").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        run = run.join(base.select(*parts, "__base"), parts).withColumn("__upto", F.col("__upto") + F.col("__base"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("__total"))
    wanted = totals.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("__at", F.floor(F.col("percent") / 100 * (F.col("__total") - 1)))
    met = run.join(wanted, by).where((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__n")))
    return met.select(*by, "percent", F.col(value).alias("value"))


def daily(log: DataFrame, at: str, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Events by UTC day and ``by``."""
    return log.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), *by).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """How often each of ``values`` occurs, those that do not with 0: ``column, n``."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def hit_metrics(results: DataFrame, queries: DataFrame, k: int, by: str) -> DataFrame:
    """Share of queries with a right document first and among the first ``k``, by ``by`` and overall (null).

    ``results``: ``query_id, rank, right`` (boolean); ``queries``: ``query_id, by``, one row each. Queries
    without results count as missed. Shares are percent to two places.
    """
    hits = results.where(F.col("right") & (F.col("rank") <= k)).groupBy("query_id").agg(F.min("rank").alias("best"))
    per = queries.join(hits, "query_id", "left")
    share = lambda c: F.floor(F.count_if(c) / F.count("*") * 10_000 + 0.5) / 100
    return per.groupingSets([[by], []], by).agg(F.count("*").alias("n_queries"), share(F.col("best") == 1).alias("hit_at_1"), share(F.col("best").isNotNull()).alias("hit_at_k"))


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in bins of ``width``: ``bin`` (lower edge), ``n``."""
    return rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * math.copysign(width, 1)).alias("bin")).agg(F.count("*").alias("n"))


def token_savings(retrieved: DataFrame, n_queries: int, corpus: DataFrame, tokens: str) -> DataFrame:
    """Tokens a query brings up against the whole corpus: ``n_queries, corpus_tokens, per_query, savings_pct``, to two places.

    ``retrieved`` and ``corpus`` have the number of tokens in ``tokens``. An empty corpus saves nothing.
    """
    asked = F.coalesce(F.sum(tokens), F.lit(0)) / max(1, n_queries)
    one = retrieved.agg(asked.alias("per_query")).join(F.broadcast(corpus.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("corpus_tokens"))))
    saved = F.when(F.col("corpus_tokens") > 0, F.greatest(F.lit(0.0), 1 - F.col("per_query") / F.col("corpus_tokens")) * 100).otherwise(F.lit(0.0))
    two = lambda c: F.floor(c * 100 + 0.5) / 100
    return one.select(F.lit(n_queries).alias("n_queries"), "corpus_tokens", two(F.col("per_query")).alias("per_query"), two(saved).alias("savings_pct"))


def answer_metrics(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of questions whose answer, or any of whose evidence, is in one of the first ``k`` texts: ``n_queries, evidence_at_1, evidence_at_k, answer_at_k``.

    ``results``: ``query_id, rank, text``; ``queries``: ``query_id, answer, evidence`` (array). Texts hold a snippet as
    ``contains_snippet`` says. Percent to two places; questions without results count as missed.
    """
    met = results.where(F.col("rank") <= k).join(queries, "query_id")
    shown = F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.coalesce(contains_snippet(F.col("text"), e), F.lit(False)))
    answered = F.coalesce(contains_snippet(F.col("text"), F.col("answer")), F.lit(False))
    per = met.groupBy("query_id").agg(F.max(shown & (F.col("rank") == 1)).alias("e1"), F.max(shown).alias("ek"), F.max(answered).alias("ak"))
    share = lambda c: F.floor(F.count_if(c) / F.count("*") * 10_000 + 0.5) / 100
    return queries.select("query_id").join(per, "query_id", "left").agg(F.count("*").alias("n_queries"), share(F.col("e1")).alias("evidence_at_1"), share(F.col("ek")).alias("evidence_at_k"), share(F.col("ak")).alias("answer_at_k"))


def clamp_limit(limit: float | None, default: int = 5, most: int = 10_000) -> int:
    """A limit as callers give it: no number is the default, the rest lies between 1 and ``most``."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")):
        return default
    return int(max(1, min(most, math.floor(limit))))
