"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import skew

OPEN = 2**63 - 1


class IntervalMap:
    """Disjoint half-open intervals in order, each with the number of intervals merged into it, and the gaps between them.

    ``insert`` finds the intervals that overlap or touch the new one by binary search,
    replaces them by their union and updates the gaps beside it. Into ``log``, if given, go the rows
    ``kind, start, end, n, change`` that came (1) and went (-1).
    """

    __slots__ = ("starts", "ends", "counts", "open")

    def __init__(self, starts=(), ends=(), counts=()):
        self.starts, self.ends, self.counts = list(starts), list(ends), list(counts)
        self.open = list(zip(self.ends[:-1], self.starts[1:]))

    def insert(self, start: int, end: int, n: int = 1, log: list[tuple] | None = None) -> None:
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
            n += sum(self.counts[lo:hi])
        beside = [(self.ends[lo - 1], start)] if lo else []
        if hi < len(self.starts):
            beside.append((end, self.starts[hi]))
        first = max(lo - 1, 0)
        if log is not None:
            log += [("period", *row, -1) for row in zip(self.starts[lo:hi], self.ends[lo:hi], self.counts[lo:hi])]
            log += [("gap", *row, 0, -1) for row in self.open[first:hi]]
            log += [("period", start, end, n, 1), *[("gap", *row, 0, 1) for row in beside]]
        self.open[first:hi] = beside
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]
        self.counts[lo:hi] = [n]

    def periods(self) -> Iterator[tuple[int, int, int]]:
        return zip(self.starts, self.ends, self.counts)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return iter(self.open)


def merge_intervals(
    df: DataFrame, keys: list[str], start: str, end: str, rows_per_task: int = skew.ROWS_PER_TASK, probe: DataFrame | None = None, count: str | None = None
) -> DataFrame:
    """Continuous periods and gaps per entity.

    ``df`` holds half-open intervals ``[start, end)`` as timestamps. Result columns:
    ``keys``, ``kind`` (``period`` or ``gap``), ``start_us``, ``end_us`` (microseconds;
    null: open) and ``n``, the intervals in the period (0 for a gap).

    Intervals that overlap or touch form one period. A null ``end`` is open; rows with
    a null ``start`` or an ``end`` not after ``start`` cover nothing and are left out.
    Null keys form an entity of their own. Repeated rows count as often as they occur, or as ``count`` says.

    Rows are hash-partitioned by entity and each task keeps the ordered disjoint
    interval map of the entity it is reading; state is one entity at a time. Entities
    above ``rows_per_task`` are cut into time buckets of about that size, intervals
    that start together are pre-aggregated before the shuffle, each bucket has its own
    map, and the maps are joined at the edges by tables with one row per bucket. ``probe`` may
    name a table with ``keys`` and ``start`` that is cheaper to count than ``df`` and holds at
    least its rows; large entities are then found in it.
    """
    rows = df.select(
        *keys, F.unix_micros(start).alias("__s"), F.coalesce(F.unix_micros(end), F.lit(OPEN)).alias("__e"), (F.col(count) if count else F.lit(1)).cast("long").alias("__n")
    ).where("__e > __s")
    hot = skew.find_hot(rows if probe is None else probe.select(*keys, F.unix_micros(start).alias("__s")), keys, "__s", rows_per_task)
    if hot is None:
        return _maps(rows, keys, gaps=True).select(
            *keys, "kind", "start_us", F.when(F.col("end_us") < OPEN, F.col("end_us")).alias("end_us"), "n"
        )
    right = F.broadcast(hot.table.select(*[F.col(k).alias(f"__h_{k}") for k in keys]))
    cold = _maps(rows.join(right, skew._eq(keys), "left_anti"), keys, gaps=True)
    warm = rows.join(right, skew._eq(keys), "left_semi").groupBy(*keys, "__s").agg(F.max("__e").alias("__e"), F.sum("__n").alias("__n"))
    parts = _maps(hot.bucketed(warm, "__s"), [*keys, "__bucket"], gaps=False)
    return cold.unionByName(_stitch(parts, keys)).select(
        *keys, "kind", "start_us", F.when(F.col("end_us") < OPEN, F.col("end_us")).alias("end_us"), "n"
    )


def _maps(rows: DataFrame, keys: list[str], gaps: bool) -> DataFrame:
    """One interval map per entity over rows (keys, __s, __e, __n)."""
    schema = rows.select(*keys).schema.add("kind", "string").add("start_us", "long").add("end_us", "long").add("n", "long")
    width = len(keys)

    def emit(key, held, out):
        for s, e, n in held.periods():
            out.append((*key, "period", s, e, n))
        if gaps:
            for s, e in held.gaps():
                out.append((*key, "gap", s, e, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, arrow = None, None, [], None
        for batch in batches:
            if arrow is None:
                fields = [batch.schema.field(i) for i in range(width)]
                arrow = pa.schema([*fields, pa.field("kind", pa.string()), *[pa.field(c, pa.int64()) for c in ("start_us", "end_us", "n")]])
            columns = [batch.column(i).to_pylist() for i in range(width + 3)]
            for now, s, e, n in zip(zip(*columns[:width]), *columns[width:]):
                if now != key:
                    if held is not None:
                        emit(key, held, out)
                    key, held = now, IntervalMap()
                held.insert(s, e, n)
                if len(out) > 20_000:
                    yield _batch(out, arrow)
                    out = []
        if held is not None:
            emit(key, held, out)
            yield _batch(out, arrow)

    local = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).select(*keys, "__s", "__e", "__n")
    return local.mapInArrow(run, schema)


def _batch(out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _stitch(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the maps of one entity's consecutive time buckets.

    The furthest end reached in earlier buckets swallows the periods of a bucket that
    start no later. What is swallowed belongs to the last period that began before.
    All tables with one row per bucket are bounded by the number of hot buckets.
    """
    at = [*keys, "__bucket"]
    ordered = Window.partitionBy(*keys).orderBy("__bucket")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reach = parts.groupBy(*at).agg(F.max("end_us").alias("__max")).withColumn("__carry", F.max("__max").over(before))
    reach = reach.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__bucket").alias("__hb"), "__carry")
    met = parts.join(F.broadcast(reach), skew._eq(keys) & (F.col("__bucket") == F.col("__hb")), "left").drop("__hb", *[f"__h_{k}" for k in keys])
    met = met.withColumn("__in", F.coalesce(F.col("start_us") <= F.col("__carry"), F.lit(False)))
    edges = met.groupBy(*at).agg(
        F.min(F.when(~F.col("__in"), F.col("start_us"))).alias("first"),
        F.max(F.when(~F.col("__in"), F.col("start_us"))).alias("last"),
        F.sum(F.when(F.col("__in"), F.col("n"))).alias("more"),
        F.max(F.when(F.col("__in"), F.col("end_us"))).alias("upto"),
    )
    edges = edges.withColumn("owner", F.last("last", ignorenulls=True).over(before)).withColumn(
        "follows", F.first("first", ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    )
    added = edges.where("more is not null").groupBy(*keys, "owner").agg(F.sum("more").alias("more"), F.max("upto").alias("upto"))
    hidden = [F.col(k).alias(f"__h_{k}") for k in keys]
    heads = met.where(~F.col("__in"))
    heads = heads.join(F.broadcast(added.select(*hidden, F.col("owner").alias("__o"), "more", "upto")), skew._eq(keys) & (F.col("start_us") == F.col("__o")), "left")
    heads = heads.drop(*[f"__h_{k}" for k in keys], "__o")
    heads = heads.withColumn("end_us", F.greatest("end_us", "upto")).withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    heads = heads.join(F.broadcast(edges.select(*hidden, F.col("__bucket").alias("__hb"), "follows")), skew._eq(keys) & (F.col("__bucket") == F.col("__hb")), "left")
    heads = heads.withColumn("__next", F.coalesce(F.lead("start_us").over(Window.partitionBy(*at).orderBy("start_us")), F.col("follows")))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_us"), F.col("end_us"), F.col("n")),
        F.struct(F.lit("gap").alias("kind"), F.col("end_us").alias("start_us"), F.col("__next").alias("end_us"), F.lit(0).cast("long").alias("n")),
    )
    return heads.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("end_us is not null")
