"""References whose target does not exist, is gone, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import skew
from memlake.operators.bloom import BloomFilter


def find_orphans(
    refs: DataFrame, parents: DataFrame, expected: int, rows_per_task: int = skew.ROWS_PER_TASK,
    parent_keys: DataFrame | None = None, probe: DataFrame | None = None,
) -> DataFrame:
    """Broken references, one row each: ``src_table, src_field, src_id, target, kind, period``.

    ``refs``: ``src_table, src_field, target_table, src_id, target, at``; null or empty
    targets are no references. ``parents``: one row per ``target_table, target`` with
    ``first_seen`` and ``deleted``. ``expected``: about how many parents, sizes the filter.
    ``kind`` is the first that holds of ``missing``, ``deleted``, ``late`` (``first_seen``
    after ``at``; never where either is null); ``period`` is the month of ``at`` (null if null).

    A Bloom filter of the parent keys proves most missing targets, which come out at once; only the
    references that pass it are shuffled and joined, with targets that are hot among them salted. ``parent_keys``
    (``target_table, target``, repeated ones do no harm) and ``probe`` (references, at least all
    of them) may name tables that are cheaper to read than ``parents`` and ``refs``.
    """
    refs = refs.where(F.col("target").isNotNull() & (F.col("target") != "")).select("src_table", "src_field", "target_table", "src_id", "target", "at")
    key = F.xxhash64("target_table", "target")
    bloom = BloomFilter.build((parent_keys if parent_keys is not None else parents).select(key.alias("h")), "h", expected)
    counted = (probe if probe is not None else refs).where("target is not null and target <> ''")
    hot = [r.asDict() for r in skew.hot_keys(counted, ["target_table", "target"], rows_per_task)]
    hot = [{"in_table": r["target_table"], "in_key": r["target"], "count": r["count"]} for r in hot]
    marked = refs.withColumn("__maybe", bloom.column(refs, key))
    proven = marked.where("not __maybe").select(*refs.columns, F.lit("missing").alias("kind"))
    open_ = marked.where("__maybe").drop("__maybe").withColumnsRenamed({"target_table": "in_table", "target": "in_key"})
    there = parents.select(F.col("target_table").alias("in_table"), F.col("target").alias("in_key"), "first_seen", "deleted", F.lit(True).alias("__there"))
    left, right, keys = skew.salted(open_, there, ["in_table", "in_key"], ["src_id"], hot=hot)
    kind = F.when(F.col("__there").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first_seen") > F.col("at"), "late")
    met = left.join(right, keys, "left").withColumn("kind", kind).where("kind is not null").withColumnsRenamed({"in_table": "target_table", "in_key": "target"})
    found = met.select(*proven.columns).unionByName(proven)
    return found.select("src_table", "src_field", "src_id", "target", "kind", F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Broken references per table, field, kind and month."""
    return orphans.groupBy("src_table", "src_field", "kind", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("target").alias("n_targets"))
