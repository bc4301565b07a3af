"""Hot keys: finding them under a proven bound, and splitting ordered work over time buckets.

A key counts as hot when it holds more than ``rows_per_task`` rows; of more than
``MAX_HOT`` such keys the largest are taken, the others holding at most n / MAX_HOT rows.
Tables with one row per hot key, or per bucket of one, are therefore bounded whatever
the data, and may be collected and broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.session import cut

MAX_HOT = 4096
#: Cut points of one key, and of all keys together; both reach the driver.
MAX_BUCKETS = 16_384
MAX_TOTAL = 65_536
ROWS_PER_TASK = 100_000
#: Groups a hot key of a join is spread over at most.
MAX_WAYS = 4096


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` on both sides."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


@dataclass
class HotKeys:
    """Hot keys with their cut points: at most MAX_HOT rows of at most MAX_BUCKETS numbers."""

    table: DataFrame
    keys: list[str]

    def bucketed(self, df: DataFrame, order: str, bucket: str = "__bucket") -> DataFrame:
        """``df`` with an ordered bucket number: 0 for ordinary keys, 0.. by ``order`` for hot ones."""
        hot = F.broadcast(self.table.select(*[F.col(k).alias(f"__h_{k}") for k in self.keys], "__cuts"))
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        index = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(0))
        joined = df.join(hot, cond, "left")
        return joined.withColumn(bucket, F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(index)).drop(
            "__cuts", *[f"__h_{k}" for k in self.keys]
        )


def find_hot(df: DataFrame, keys: list[str], order: str, rows_per_task: int = ROWS_PER_TASK) -> HotKeys | None:
    """The hot keys of ``df`` with quantiles of the numeric column ``order``, or None if there are none.

    Two aggregations with map-side combine over the key columns only; the second
    runs over hot keys alone. What reaches the driver is bounded by MAX_HOT keys, and the
    buckets of all keys together by about MAX_TOTAL: beyond that, buckets hold more rows.
    """
    spark = df.sparkSession
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    head = counts.where(F.col("__n") > rows_per_task).orderBy(F.desc("__n")).limit(MAX_HOT).collect()
    if not head:
        return None
    per = max(rows_per_task, math.ceil(sum(r["__n"] for r in head) / MAX_TOTAL))
    size = {tuple(r[k] for k in keys): r["__n"] for r in head}
    steps = min(MAX_BUCKETS, math.ceil(max(size.values()) / per))
    fractions = [i / steps for i in range(1, steps)]
    if not fractions:
        return None
    hot = F.broadcast(spark.createDataFrame(list(size), df.select(*[F.col(k).alias(f"__h_{k}") for k in keys]).schema))
    cuts = df.join(hot, _eq(keys), "left_semi").groupBy(*keys).agg(F.percentile_approx(order, fractions, 10_000).alias("__cuts")).collect()
    rows = []
    for r in cuts:
        key = tuple(r[k] for k in keys)
        stride = max(1, steps // max(1, math.ceil(size[key] / per)))
        rows.append((*key, sorted(set(r["__cuts"][stride - 1 :: stride]))))
    table = spark.createDataFrame(rows, df.select(*keys).schema.add("__cuts", T.ArrayType(T.LongType())))
    return HotKeys(table, keys)


def neighbour(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, hot: HotKeys | None, ahead: bool, bucket: str = "__bucket"
) -> DataFrame:
    """``lead`` (ahead) or ``lag`` of ``value`` per key in ``order``, evaluated per (key, bucket).

    Each bucket is its own window partition; the value that crosses a bucket's edge
    comes from a table with one row per bucket of a hot key, which is bounded.
    ``order`` must be unique within a key.
    """
    step = F.lead if ahead else F.lag
    parts = [*keys, bucket] if hot else keys
    df = df.withColumn("__val", F.struct(value.alias("v")))
    window = Window.partitionBy(*parts).orderBy(order)
    df = df.withColumn("__near", step("__val").over(window))
    if hot:
        pick = F.min_by if ahead else F.max_by
        edge = (
            df.join(F.broadcast(hot.table.select(*[F.col(k).alias(f"__h_{k}") for k in keys])), _eq(keys), "left_semi")
            .groupBy(*keys, bucket)
            .agg(pick("__val", order).alias("__edge"))
        )
        edge = edge.withColumn("__edge", step("__edge").over(Window.partitionBy(*keys).orderBy(bucket)))
        edge = edge.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col(bucket).alias("__hb"), "__edge")
        df = df.join(F.broadcast(edge), _eq(keys) & (F.col(bucket) == F.col("__hb")), "left")
        df = df.withColumn("__near", F.coalesce("__near", "__edge")).drop("__hb", "__edge", *[f"__h_{k}" for k in keys])
    return df.withColumn(out, F.col("__near")["v"]).drop("__val", "__near")


def next_value(df: DataFrame, keys: list[str], order: str, value: Column, out: str, hot: HotKeys | None, bucket: str = "__bucket") -> DataFrame:
    """The first non-null ``value`` of a later row of the key, in ``order`` (unique within a key)."""
    parts = [*keys, bucket] if hot else keys
    df = df.withColumn("__val", value)
    later = Window.partitionBy(*parts).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.last("__val", ignorenulls=True).over(later))
    if hot:
        own = df.where("__val is not null").join(F.broadcast(hot.table.select(*[F.col(k).alias(f"__h_{k}") for k in keys])), _eq(keys), "left_semi")
        first = own.groupBy(*keys, bucket).agg(F.min_by("__val", order).alias("__first"))
        every = df.select(*keys, bucket).distinct().join(F.broadcast(hot.table.select(*[F.col(k).alias(f"__h_{k}") for k in keys])), _eq(keys), "left_semi")
        edge = every.alias("l").join(first.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col(bucket).alias("__hb"), "__first"), _eq(keys) & (F.col(bucket) == F.col("__hb")), "left")
        after = Window.partitionBy(*keys).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select(*keys, bucket, F.last("__first", ignorenulls=True).over(after).alias("__edge"))
        edge = edge.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col(bucket).alias("__hb"), "__edge")
        df = df.join(F.broadcast(edge), _eq(keys) & (F.col(bucket) == F.col("__hb")), "left")
        df = df.withColumn(out, F.coalesce(out, "__edge")).drop("__hb", "__edge", *[f"__h_{k}" for k in keys])
    return df.drop("__val")


def positions(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` with the 0-based position of each row within its key, by numeric ``order`` and then ``ties``.

    A hot key is ranked bucket by bucket; the rows in earlier buckets come from a table of counts.
    """
    return ranked(df, keys, order, ties, out, find_hot(df, keys, order, rows_per_task))


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, hot: HotKeys | None) -> DataFrame:
    """``positions`` with the hot keys, cut by ``order``, known already."""
    if hot is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)) - 1)
    cut = hot.bucketed(df, order)
    parts = [*keys, "__bucket"]
    counts = cut.groupBy(*parts).agg(F.count("*").alias("__n"))
    counts = counts.join(F.broadcast(hot.table.select(*[F.col(k).alias(f"__h_{k}") for k in keys])), _eq(keys), "left_semi")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__bucket").alias("__hb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = cut.withColumn(out, F.row_number().over(Window.partitionBy(*parts).orderBy(order, *ties)) - 1)
    met = inside.join(F.broadcast(counts), _eq(keys) & (F.col("__bucket") == F.col("__hb")), "left")
    return met.withColumn(out, F.col(out) + F.coalesce("__base", F.lit(0))).drop("__bucket", "__hb", "__base", *[f"__h_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the 1-based position of each row within its key by ``order``, columns of any orderable type, unique within a key.

    A global range sort cuts large keys over several partitions; what a key has in partitions before is
    added from a table with one row per key and partition, of which only keys that cross a border have more than one.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    inside = placed.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order)))
    counts = placed.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"__base": F.sum("__n").over(whole.orderBy("__p")) - F.col("__n"), "__parts": F.count("*").over(whole)}).where("__parts > 1 and __base > 0")
    # at most one key crosses each border
    base = counts.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__p").alias("__hp"), "__base")
    met = inside.join(F.broadcast(base), _eq(keys) & (F.col("__p") == F.col("__hp")), "left")
    return met.withColumn(out, F.col(out) + F.coalesce("__base", F.lit(0))).drop("__p", "__hp", "__base", *[f"__h_{k}" for k in keys])


def _eq(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    return cond


def hot_keys(rows: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> list:
    """The at most MAX_HOT keys above ``rows_per_task`` rows."""
    return rows.groupBy(*keys).count().where(F.col("count") > rows_per_task).orderBy(F.desc("count")).limit(MAX_HOT).collect()


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], rows_per_task: int = ROWS_PER_TASK, ways: int | None = None, hot: list | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join with a salt for the keys hot on the left, and the keys to join on.

    A hot key's left rows spread over ``ways`` groups (default: one for each ``rows_per_task`` of the largest
    key, at least 64, at most MAX_WAYS) by a hash of ``spread``; the right
    rows of hot keys repeat once per group. ``right`` should hold few rows per key.
    Without hot keys both sides come back as they are. ``hot`` gives rows with the hot
    keys (at most MAX_HOT) where they are known already.
    """
    top = hot if hot is not None else hot_keys(left, keys, rows_per_task)
    if not top:
        return left, right, keys
    if ways is None:
        largest = max((r["count"] for r in top if "count" in (r if isinstance(r, dict) else r.asDict())), default=0)
        ways = min(MAX_WAYS, max(64, -(-largest // max(1, rows_per_task))))
    hot = left.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in top], left.select(*keys).schema)
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))
    hidden = [f"__h_{k}" for k in keys]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(ways)).cast("int")).otherwise(0)
    spread_left = left.join(hot, _eq(keys), "left").withColumn("__salt", salt).drop("__hot", *hidden)
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    spread_right = right.join(hot, _eq(keys), "left").withColumn("__salt", F.explode(copies)).drop("__hot", *hidden)
    return spread_left, spread_right, [*keys, "__salt"]
