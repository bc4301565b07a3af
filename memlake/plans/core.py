"""Queries of the general data-processing problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.current import current_rows
from memlake.operators.history import history
from memlake.operators.intervals import merge_intervals
from memlake.operators.orphans import find_orphans, orphan_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(column: str) -> Column:
    return F.floor(F.col(column) / 1000).cast("long")


def _edges(spark: SparkSession, sf_dir: str, cardinality: str, columns: list[str]) -> DataFrame:
    """Current ``pg`` rows of the relations with that cardinality."""
    rels = table(spark, sf_dir, "rel_catalog").where(F.col("cardinality") == cardinality).select("rel").distinct()
    rows = current_rows(table(spark, sf_dir, "pg"), "id", "recorded_at", ["from_node", "rel", "valid_from", "valid_to", *columns])
    return rows.join(rels, "rel", "left_semi")


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All continuous periods and gaps per entity and relation."""
    rows = merge_intervals(_edges(spark, sf_dir, "many", []), ["from_node", "rel"], "valid_from", "valid_to", probe=table(spark, sf_dir, "pg"))
    return rows.select("from_node", "rel", "kind", _ms("start_us").alias("start_ms"), F.coalesce(_ms("end_us"), F.lit(-1).cast("long")).alias("end_ms"), "n")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_periods(spark, sf_dir).where((F.col("kind") == "gap") | (F.col("n") >= 2)).drop("n")


def _history(spark: SparkSession, sf_dir: str):
    rows = _edges(spark, sf_dir, "one", ["to_node", "recorded_at"])
    return history(rows, "from_node", "rel", "to_node", "valid_from", "valid_to", "recorded_at", "id", probe=table(spark, sf_dir, "pg"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).view().select(
        "from_node", "rel", F.col("value").alias("to_node"), _ms("from_us").alias("from_ms"), F.coalesce(_ms("to_us"), F.lit(-1).cast("long")).alias("to_ms")
    )


def p4_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and versions per satellite and attribute."""
    rows = _history(spark, sf_dir).table()
    return rows.groupBy("satellite", "rel").agg(F.count("*").alias("n_rows"), F.count("hash_diff").alias("n_versions"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, DataFrame, DataFrame]:
    pg, node, atom = (table(spark, sf_dir, t) for t in ("pg", "pg_node", "atomic_index"))
    edges = current_rows(pg, "id", "recorded_at", ["to_node", "superseded_by", "recorded_at"])
    item = lambda field, to, target: F.struct(F.lit(field).alias("src_field"), F.lit(to).alias("target_table"), target.alias("target"))
    from_edges = edges.select(
        F.lit("pg").alias("src_table"), F.col("id").alias("src_id"), F.col("recorded_at").alias("at"),
        F.explode(F.filter(F.array(item("to_node", "node", F.col("to_node")), item("superseded_by", "edge", F.col("superseded_by"))), lambda x: x["target"].isNotNull())).alias("r"),
    ).select("src_table", "src_id", "at", "r.*")
    current = current_rows(atom, "id", "indexed_at", ["crosslinks", "indexed_at"])
    linked = lambda f: F.transform(F.array_distinct(F.col("crosslinks")[f]), lambda t: item(f"crosslinks.{f}", "atom", t))
    fields = F.array(linked("references"), linked("partially_superseded_by"))
    fields = F.flatten(F.filter(fields, lambda x: x.isNotNull()))
    from_atoms = current.select(F.lit("atomic_index").alias("src_table"), F.col("id").alias("src_id"), F.col("indexed_at").alias("at"), F.explode(fields).alias("r"))
    from_atoms = from_atoms.select("src_table", "src_id", "at", "r.*")
    # one aggregation over all parents; the row of greatest order says whether it is deleted
    listed = lambda rows, name, at, gone, order: rows.where("id is not null").select(F.lit(name).alias("target_table"), F.col("id").alias("target"), F.col(at).alias("at"), gone.alias("gone"), order.cast("long").alias("order"))
    never = F.lit(False)
    every = (
        listed(node, "node", "created_at", F.col("deleted_at").isNotNull(), F.when(F.col("deleted_at").isNotNull(), 1).otherwise(0))
        .unionByName(listed(pg, "edge", "recorded_at", never, F.lit(0)))
        .unionByName(listed(atom, "atom", "indexed_at", F.col("valid_to").isNotNull(), F.coalesce(F.unix_micros("indexed_at"), F.lit(-(2**62)))))
    )
    parents = every.groupBy("target_table", "target").agg(F.min("at").alias("first_seen"), F.max_by("gone", "order").alias("deleted"))
    probe = pg.select(F.lit("node").alias("target_table"), F.col("to_node").alias("target")).unionByName(pg.select(F.lit("edge").alias("target_table"), F.col("superseded_by").alias("target")))
    probe = probe.unionByName(atom.select(F.explode(fields).alias("r")).select("r.target_table", "r.target"))
    return from_edges.unionByName(from_atoms), parents, pg.count() + node.count() + atom.count(), every, probe


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents, expected, keys, probe = _references(spark, sf_dir)
    return find_orphans(refs, parents, expected, parent_keys=keys, probe=probe)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p4_found": p4_found, "p4_satellites": p4_satellites, "p5_found": p5_found, "p5_report": p5_report}
