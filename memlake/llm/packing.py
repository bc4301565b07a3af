"""Filling containers of a few permitted lengths: variable-capacity best fit over the histogram of sizes.

Sizes are whole tokens up to the largest capacity, so the corpus is summed up by a
histogram of at most that many rows. Best fit with decreasing sizes is carried out on the
histogram exactly as item by item, all containers of equal content being one *pattern* with a
multiplicity; the patterns are then dealt to the items by their rank within their size.
What reaches the driver depends on the capacity, not on the number of items.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.tokens import n_tokens
from memlake.session import cut

CAPACITIES = (256, 512, 1024, 2048)
#: Cost of a container besides its capacity, in tokens.
OVERHEAD = 8


@dataclass
class Pattern:
    capacity: int
    content: dict[int, int]
    times: int

    @property
    def used(self) -> int:
        return sum(s * k for s, k in self.content.items())


def best_fit(histogram: dict[int, int], open_size) -> list[Pattern]:
    """Best fit, largest sizes first, opening containers of ``open_size(size, left)`` (``left``: items not yet placed, by size).

    Identical to placing the items one by one: an item goes to the open container with the
    least room that holds it; a container of room r takes floor(r / size) of them before the
    next. Each step ends a size or uses up a whole pattern, and splits at most one pattern.
    """
    room: dict[int, list[Pattern]] = {}
    order: list[int] = []

    def put(left: int, p: Pattern) -> None:
        if p.times:
            if left not in room:
                room[left] = []
                insort(order, left)
            room[left].append(p)

    for size in sorted(histogram, reverse=True):
        count = histogram[size]
        while count:
            at = bisect_left(order, size)
            if at < len(order):
                left = order[at]
                p = room[left].pop()
                if not room[left]:
                    del room[left]
                    order.pop(at)
                k = left // size
            else:
                capacity = open_size(size, {s: n for s, n in histogram.items() if s < size} | {size: count})
                k, left = capacity // size, capacity
                p = Pattern(capacity, {}, -(-count // k))
            full = min(p.times, count // k)
            put(left - k * size, Pattern(p.capacity, p.content | {size: k}, full))
            count -= full * k
            rest = p.times - full
            if rest and 0 < count < k:
                put(left - count * size, Pattern(p.capacity, p.content | {size: count}, 1))
                count, rest = 0, rest - 1
            put(left, Pattern(p.capacity, p.content, rest))
    return [p for held in room.values() for p in held]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[Pattern]:
    """The cheapest packing over the permitted lengths jointly.

    A container is opened in the permitted length of least cost a token, filled as far as the items still
    to be placed allow; other candidates open the smallest length with at least a given room to
    spare, or one fixed length. Of every candidate packing each container is downsized to the
    smallest length that holds its content, and costs its capacity plus ``overhead``. The least cost wins.
    """
    sizes = sorted(capacities)

    def opener(spare: float, least: int):
        return lambda size, left: next((c for c in sizes if c >= least and c >= size * (1 + spare)), sizes[-1])

    def least_cost(size: int, left: dict[int, int]) -> int:
        def per_token(c: int) -> tuple[float, int]:
            room = c
            for s in sorted((s for s in left if s <= size), reverse=True):
                room -= min(left[s], room // s) * s
            return (c + overhead) / (c - room), c

        return min(per_token(c) for c in sizes if c >= size)[1]

    best: tuple[float, list[Pattern]] | None = None
    for rule in [least_cost, *(opener(spare, least) for least in sizes for spare in (0.0, 0.25, 1.0))]:
        made = best_fit(histogram, rule)
        for p in made:
            p.capacity = next(c for c in sizes if c >= p.used)
        cost = sum((p.capacity + overhead) * p.times for p in made)
        if best is None or cost < best[0]:
            best = cost, made
    return sorted(best[1], key=lambda p: (-p.capacity, sorted(p.content.items(), reverse=True)))


def fill_containers(items: DataFrame, key: str, size: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, rows_per_task: int = 100_000) -> DataFrame:
    """Places every item: ``key, piece_no, start, n_tokens, container_id, capacity, offset``.

    ``size`` is a whole number of tokens. An item above the largest capacity is divided into full
    containers and a rest (``piece_no``, and ``start``, its first token); no other item is divided.
    Items of size 0 or null fill nothing and come out with a null container. Repeated keys are
    items of their own. Container ids count from 0; ``offset`` is the item's place within it.
    """
    spark, most = items.sparkSession, max(capacities)
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    pieces = F.when(n > most, F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(n / most) - 1), lambda i: F.struct(i.cast("int").alias("piece_no"), (i * most).alias("start"), F.least(F.lit(most), n - i * most).cast("int").alias("n_tokens"))))
    pieces = F.coalesce(pieces, F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start"), n.cast("int").alias("n_tokens"))))
    rows = cut(items.select(key, F.explode(pieces).alias("p")).select(key, "p.*"))
    counts = {r["n_tokens"]: r["count"] for r in rows.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    patterns = plan(counts, capacities, overhead)

    # rank within each size: frequent sizes are counted in hash buckets of about rows_per_task rows
    per = max(rows_per_task, sum(counts.values()) // 50_000)
    ways = [(s, math.ceil(c / per)) for s, c in counts.items()]
    known = F.broadcast(spark.createDataFrame(ways, "n_tokens int, ways int"))
    dealt = rows.where("n_tokens > 0").join(known, "n_tokens").withColumn("bucket", F.pmod(F.xxhash64(key, "piece_no"), F.col("ways")).cast("int"))
    sums = dealt.groupBy("n_tokens", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("count"))
    inside = Window.partitionBy("n_tokens", "bucket").orderBy(key, "piece_no")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(sums.select("n_tokens", "bucket", "before"), ["n_tokens", "bucket"])
    ranked = ranked.select(key, "piece_no", "start", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    schema = rows.schema.add("container_id", "long").add("capacity", "integer").add("offset", "integer")
    placed = ranked.mapInArrow(_deal(spark, patterns, schema.names), schema)
    none = rows.where("n_tokens <= 0").select("*", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("offset"))
    return placed.unionByName(none)


def _deal(spark, patterns: list[Pattern], names: list[str]):
    """Slots of each size, in the order of patterns, found from an item's rank by binary search."""
    slots: dict[int, list[tuple[int, ...]]] = {}
    first, taken = 0, {}
    for p in patterns:
        at = 0
        for s, k in sorted(p.content.items(), reverse=True):
            lo = taken.get(s, 0)
            slots.setdefault(s, []).append((s * 2**40 + lo, lo, k, first, p.capacity, at))
            taken[s] = lo + k * p.times
            at += s * k
        first += p.times
    flat = np.array([x for s in sorted(slots) for x in slots[s]], dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            _, lo, k, base, capacity, at = table[np.searchsorted(table[:, 0], size * 2**40 + rank, side="right") - 1].T if len(size) else np.zeros((6, 0), np.int64)
            container, place = base + (rank - lo) // np.maximum(k, 1), at + (rank - lo) % np.maximum(k, 1) * size
            arrays = [batch.column(i) for i in range(4)] + [pa.array(container), pa.array(capacity.astype(np.int32)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack_documents(docs: DataFrame, key: str, text: str, tokenizer: str | None = None, **options) -> DataFrame:
    """``fill_containers`` over texts measured in tokens."""
    return fill_containers(docs.select(key, n_tokens(F.col(text), tokenizer).alias("n_tokens")), key, "n_tokens", **options)


def packing_report(placed: DataFrame) -> DataFrame:
    """Containers, tokens and unused space per capacity."""
    bins = placed.where("container_id is not null").groupBy("container_id", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return bins.groupBy("capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("n_tokens"), F.sum(F.col("capacity") - F.col("used")).alias("n_unused")
    )
