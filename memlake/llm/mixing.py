"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.tokens import n_tokens
from memlake.session import cut

#: A target table may list at most this many sources; it is collected and broadcast.
MAX_SOURCES = 10_000
#: What the queue leaves of a source's part, to be closed by the documents that fit it best together.
HELD = 8192
#: The times compared around each time at which a source runs dry, as parts of it.
AROUND = [k / 200 for k in range(180, 221)]


def given(caps: dict[str, float], weights: dict[str, float], now: float) -> dict[str, float]:
    """What each source has given at a virtual time."""
    return {s: min(weights[s] * now, caps[s]) for s in caps}


def virtual_end(caps: dict[str, float], weights: dict[str, float], mean: dict[str, float], total: float | None, missed: dict[float, float] | None = None) -> float:
    """The virtual time at which the queues are cut.

    With ``total``: when the sources together have given it, those that ran dry giving all
    they may. Without: of the times at which a source runs dry, the one with the least
    expected deviation from the shares (to four digits; of equal ones the latest), which is what dry sources
    lack plus a quarter of a mean document (``mean``) for every source; on a large corpus, where documents are
    small beside the total, this is when the first source runs dry. ``missed`` gives the times to compare, each
    with the size that the documents of all sources together miss the parts of that time by.
    """
    dry = sorted((caps[s] / weights[s], s) for s in caps)
    if not dry:
        return 0.0
    if total is None:
        whole = sum(mean[s] for s in caps) / 4

        def off(now: float) -> float:
            have = given(caps, weights, now)
            return (sum(abs(have[s] / sum(have.values()) - weights[s]) for s in have) + (whole if missed is None else missed[now]) / sum(have.values()))

        return min((round(off(at), 4), -at, at) for at in (missed or [at for at, _ in dry]))[2]
    sofar, rate, now = 0.0, sum(weights[s] for s in caps), 0.0
    for at, s in dry:
        if sofar + rate * (at - now) >= total:
            return now + (total - sofar) / rate
        sofar, now, rate = sofar + rate * (at - now), at, rate - weights[s]
    return now


def sums_reached(sizes: dict[int, int], width: int) -> np.ndarray:
    """Which sums below ``width`` so many pieces of each size can have."""
    there = np.zeros(width, dtype=bool)
    there[0] = True
    for size, n in sorted(sizes.items()):
        n, lot = min(n, (width - 1) // size), 1
        while n > 0:
            step = size * min(lot, n)
            there[step:] |= there[:-step].copy()
            n, lot = n - lot, 2 * lot
    return there


def closing(sizes: list[int], gap: float) -> list[int]:
    """The positions whose sizes together come closest to ``gap``, the first positions that do; of equally close sums the smaller."""
    width = int(2 * gap) + 1
    by = np.full(width, -1)
    there = np.zeros(width, dtype=bool)
    there[0] = True
    goal = int(gap + 0.5)
    for i, size in enumerate(sizes):
        if there[goal]:
            break
        if size < width:
            fresh = np.flatnonzero(there[: width - size] & ~there[size:]) + size
            by[fresh], there[fresh] = i, True
    sums = np.flatnonzero(there)
    at, out = int(sums[np.abs(sums - gap).argmin()]), []
    while at:  # a sum was first reached from one that was reached before
        out.append(int(by[at]))
        at -= sizes[out[-1]]
    return out[::-1]


def _missed(rows: DataFrame, caps: dict[str, float], weights: dict[str, float], most: dict[str, int]) -> dict[float, float]:
    """By how much the documents miss the sources' parts, for the times around each at which a source runs dry."""
    spark = rows.sparkSession
    times = sorted({f * caps[s] / weights[s] for s in caps for f in AROUND})
    plan = spark.sparkContext.broadcast((np.array(times), caps, weights, most))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        times, caps, weights, most = plan.value
        s = part["source"].iloc[0]
        goals = np.minimum(weights[s] * times, caps[s])
        small = part[part["size"] < 2 * HELD]
        sums = np.flatnonzero(sums_reached({int(a): int(n) * most[s] for a, n in zip(small["size"], small["n"])}, 2 * HELD))
        after = np.searchsorted(sums, goals).clip(1, max(1, len(sums) - 1))
        near = np.minimum(np.abs(goals - sums[after - 1]), np.abs(goals - sums[np.minimum(after, len(sums) - 1)]))
        # larger parts end in documents that close what is held back, as far as the smallest one lets them
        miss = np.where(goals < HELD, near, np.where(goals >= caps[s], 0, np.minimum((part["size"].min() - 1) / 2, goals)))
        return pd.DataFrame({"at": np.arange(len(times)), "miss": miss})

    sizes = rows.where(F.col("source").isin(list(caps))) if len(caps) <= 100 else rows.join(F.broadcast(spark.createDataFrame([(s,) for s in caps], "source string")), "source", "left_semi")
    sizes = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    found = sizes.groupBy("source").applyInPandas(run, "at long, miss double").groupBy("at").agg(F.sum("miss").alias("miss")).collect()
    return {times[r["at"]]: r["miss"] for r in found}


def mix_sources(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 17, rows_per_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Selected documents in mixed order, and the shares reached.

    ``targets``: ``source, target_share, max_repeat``. Sources not listed, sizes of 0 or null
    and shares not above 0 give nothing; listed sources without documents are reported with
    share 0, and the shares of the others keep their proportions. A source listed twice adds
    its shares and keeps the larger ``max_repeat``; sources compare as written.

    Each source is a queue of its shuffled documents, round after round up to ``max_repeat``;
    a document's finish time is the cumulative size of its queue over the source's weight. At the
    virtual time of the budget each source has a part; all documents up to HELD before its end are taken, in
    order of finish time, and then the first waiting ones that together come closest to what is still missing
    (of each size as many wait as may be used). Cumulative sizes come from sums per hash bucket of about ``rows_per_task`` documents, so that no source is
    gathered in one task. Selection: ``key, source, size, copy_no, finish``.
    Report: ``source, target_share, max_repeat, n_taken, n_docs, size_taken, actual_share``.
    """
    goal = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    asked = goal.limit(MAX_SOURCES + 1).collect()
    if len(asked) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = docs.sparkSession
    goal = spark.createDataFrame([tuple(r) for r in asked], "source string, target_share double, max_repeat int")
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    # sizes may be costly: they are written before anything filters by them, which would evaluate them again
    rows = cut(rows.join(F.broadcast(goal.select("source")), "source", "left_semi").select("key", "source", "size")).where("size > 0")
    supply = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    whole = sum(r["target_share"] for r in asked if r["source"] in supply) or 1.0
    weights = {r["source"]: r["target_share"] / whole for r in asked if r["source"] in supply}
    caps = {r["source"]: supply[r["source"]]["size"] * max(0, r["max_repeat"] or 0) for r in asked if r["source"] in supply and (r["max_repeat"] or 0) > 0}
    missed = _missed(rows, caps, weights, {s: caps[s] // supply[s]["size"] for s in caps}) if caps and total is None else None
    end = virtual_end(caps, weights, {s: supply[s]["size"] / supply[s]["n"] for s in caps}, total, missed)
    goals = given(caps, weights, end)

    def rounds(s: str) -> int:
        # small parts may need a document again before the others came
        return min(caps[s] // supply[s]["size"], int(weights[s] * end // supply[s]["size"]) + 1 + (goals[s] <= HELD))

    queue = spark.createDataFrame([(s, weights[s], rounds(s), supply[s]["size"], -(-supply[s]["n"] // rows_per_task)) for s in caps], "source string, weight double, rounds int, whole long, ways int")
    copies = rows.join(F.broadcast(queue), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    copies = copies.withColumn("draw", F.xxhash64(F.lit(seed), "copy_no", "key"))
    copies = copies.withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.col("ways")).cast("int"))
    at = ["source", "copy_no", "bucket"]
    sums = copies.groupBy(*at).agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source", "copy_no").orderBy("bucket")) - F.col("in_bucket")).select(*at, "before")
    inside = Window.partitionBy(*at).orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, 0)
    queued = copies.withColumn("run", F.sum("size").over(inside)).join(sums, at)
    queued = queued.withColumn("finish", (F.col("copy_no") * F.col("whole") + F.col("before") + F.col("run")) / F.col("weight"))
    queued = queued.withColumn("slot", F.row_number().over(Window.partitionBy(*at, "size").orderBy("draw", "key")))
    held = spark.createDataFrame([(s, (goals[s] - HELD) * (1 + 1e-12) / weights[s]) for s in caps], "source string, until double")
    queued = cut(queued.join(F.broadcast(held), "source").select("key", "source", "size", "copy_no", "finish", "slot", "until"))
    within = F.col("finish") <= F.col("until")
    columns = ["key", "source", "size", "copy_no", "finish"]
    taken = queued.where(within).select(*columns)
    # what is left of a source's part is closed by the waiting documents that fit it best; of a size no more than fit are of use
    have = {r["source"]: r["size"] for r in taken.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    left = {s: float(goals[s] - have.get(s, 0)) for s in caps}
    gaps = spark.createDataFrame(list(left.items()), "source string, gap double")
    waiting = queued.where(~within).join(F.broadcast(gaps), "source").where(F.col("size") < 2 * F.col("gap"))
    use = 2 * F.col("gap") / F.col("size")
    waiting = waiting.where(F.col("slot") <= use).withColumn("slot", F.row_number().over(Window.partitionBy("source", "size").orderBy("finish", "copy_no", "key"))).where(F.col("slot") <= use)

    def close(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["finish", "copy_no", "key"])
        return part.iloc[closing(part["size"].tolist(), left[part["source"].iloc[0]])][columns]

    waiting = waiting.select(*columns)
    taken = cut(taken.unionByName(waiting.groupBy("source").applyInPandas(close, waiting.schema)))
    counts = taken.groupBy("source").agg(F.count("*").alias("n_taken"), F.countDistinct("key").alias("n_docs"), F.sum("size").alias("size_taken"))
    report = goal.join(counts, "source", "left").na.fill(0, ["n_taken", "n_docs", "size_taken"])
    everything = F.sum("size_taken").over(Window.partitionBy())  # one row per listed source, at most MAX_SOURCES
    report = report.withColumn("actual_share", F.coalesce(F.try_divide("size_taken", everything), F.lit(0.0)))
    return taken.withColumnRenamed("key", key).orderBy("finish", "source", key, "copy_no"), report


def mix_documents(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, tokenizer: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """``mix_sources`` over texts measured in tokens."""
    listed = docs.join(targets.select(F.col("source").alias(source)).distinct(), source, "left_semi")
    return mix_sources(listed.select(key, source, n_tokens(F.col(text), tokenizer).alias("n_tokens")), key, source, "n_tokens", targets, **options)
