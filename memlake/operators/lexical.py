"""Lexical scoring of candidates: BM25 within each query's candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import tokenize

K1, B = 1.5, 0.75


def bm25(candidates: DataFrame, query_id: str, query: str, text: str, out: str = "bm25") -> DataFrame:
    """``candidates`` (rows of query and document) with a BM25 score; statistics are those of the query's own candidates.

    Terms repeated in the query count repeatedly. Queries or texts without words, and null ones, score 0.
    Rows are kept as they are, repeated ones too. The terms that query and text share are folded in an array per
    row, each once with how often either has it; document frequencies are counted by term before they are
    gathered in one map a query, which holds terms of the query only, however many candidates it has.
    """
    terms = F.coalesce(tokenize(F.col(query)), F.array().cast("array<string>"))
    words = F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>"))
    rows = candidates.withColumns({"__q": terms, "__d": words})
    times = lambda words, t: F.size(F.filter(words, lambda w: w == t)).cast("double")
    shared = F.transform(F.array_intersect("__q", "__d"), lambda t: F.struct(t.alias("t"), times("__d", t).alias("f"), times("__q", t).alias("m")))
    rows = rows.withColumns({"__hit": shared, "__len": F.size("__d").cast("double"), "__per": F.struct(F.col(query_id).alias("q"))}).drop("__q", "__d")
    sizes = rows.groupBy("__per").agg(F.count("*").cast("double").alias("__n"), F.avg("__len").alias("__avg"))
    # outer, since for a plain explode Spark infers a filter that would tokenise once per element
    counts = rows.select("__per", F.explode_outer("__hit.t").alias("t")).where("t is not null").groupBy("__per", "t").agg(F.count("*").cast("double").alias("n"))
    counts = counts.groupBy("__per").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("__df"))
    rows = rows.join(sizes.join(counts, "__per", "left"), "__per")
    n = lambda h: F.element_at("__df", h["t"])
    part = lambda h: h["m"] * F.log((F.col("__n") - n(h) + 0.5) / (n(h) + 0.5) + 1) * (h["f"] * (K1 + 1)) / (h["f"] + K1 * (1 - B + B * (F.col("__len") / F.greatest(F.lit(1.0), F.col("__avg")))))
    score = F.aggregate("__hit", F.lit(0.0), lambda s, h: s + part(h))
    return rows.withColumn(out, score).drop("__per", "__hit", "__n", "__avg", "__len", "__df")


def min_max(df: DataFrame, query_id: str, score: str, out: str) -> DataFrame:
    """Scores scaled to [0, 1] per query; 0.5 where all are equal."""
    per = Window.partitionBy(query_id)
    low, high = F.min(score).over(per), F.max(score).over(per)
    return df.withColumn(out, F.when(high == low, F.lit(0.5)).otherwise((F.col(score) - low) / (high - low)))


def blend(first: Column, second: Column, alpha: float = 0.6) -> Column:
    """``(1 - alpha) first + alpha second``."""
    return (1 - alpha) * first + alpha * second
