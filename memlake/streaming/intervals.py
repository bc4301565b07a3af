"""Interval merging over a stream: the ordered interval map of each entity as keyed state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.intervals import OPEN, IntervalMap, merge_intervals

STATE = "starts array<bigint>, ends array<bigint>, counts array<bigint>"
CHANGES = "kind string, start_us bigint, end_us bigint, n bigint, change int"


def merge_intervals_stream(stream: DataFrame, key: str, start: str, end: str, bucket: str = "100 years") -> DataFrame:
    """What each micro-batch changes in the periods and gaps of its entities: ``key, bucket, kind, start_us, end_us, n, change``.

    ``change`` is 1 for a row that came and -1 for one that went; rows that stay are not repeated. State is one
    disjoint interval map for each entity and ``bucket`` of start times, which holds merged periods, not rows; arrival
    order does not matter. With buckets short enough an entity of any size is spread over many tasks; its whole
    periods and gaps are those of ``current``. Rows with a null start or an end not after it change nothing.
    ``end_us`` is -1 while open. Use output mode ``update`` and keep every batch.
    """
    width = pd.Timedelta(bucket).value // 1000 if not bucket.endswith("years") else int(bucket.split()[0]) * 366 * 86_400_000_000
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(start).alias("s"), F.coalesce(F.unix_micros(end), F.lit(OPEN)).alias("e")).where("e > s")
    rows = rows.withColumn("bucket", F.floor(F.col("s") / width).cast("long"))

    def fold(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(*state.get) if state.exists else IntervalMap()
        log: list[tuple] = []
        for part in parts:
            for s, e in zip(part["s"].tolist(), part["e"].tolist()):
                held.insert(s, e, log=log)
        state.update((held.starts, held.ends, held.counts))
        net: Counter = Counter()
        for *row, change in log:
            net[tuple(row)] += change
        out = [(*keys, kind, s, -1 if e == OPEN else e, n, change) for (kind, s, e, n), change in net.items() if change]
        yield pd.DataFrame(out, columns=["key", "bucket", "kind", "start_us", "end_us", "n", "change"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key", "bucket").applyInPandasWithState(fold, f"key {kind}, bucket bigint, {CHANGES}", STATE, "update", GroupStateTimeout.NoTimeout)


def current(changes: DataFrame) -> DataFrame:
    """The periods and gaps per entity after all ``changes`` a stream wrote: ``key, kind, start_us, end_us`` (null: open), ``n``."""
    now = changes.where("kind = 'period'").groupBy("key", "bucket", "start_us", "end_us", "n").agg(F.sum("change").alias("there")).where("there > 0")
    at = lambda c: F.timestamp_micros(c)
    pieces = now.select("key", at(F.col("start_us")).alias("s"), F.when(F.col("end_us") >= 0, at(F.col("end_us"))).alias("e"), "n")
    return merge_intervals(pieces, ["key"], "s", "e", count="n")
