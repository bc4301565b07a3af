"""Queries of the training-data operators over the driver's tables, with SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.chunking import split_items
from memlake.llm.mixing import mix_documents
from memlake.llm.packing import pack_documents, packing_report
from memlake.llm.similar import most_similar, vector_keys
from memlake.llm.subjects import SHARE, subject_shares
from memlake.operators.current import current_rows, current_where


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of each current row's store, with their similarity."""
    log = table(spark, sf_dir, "pgvector")
    rows = current_rows(log, "id", "created_at", ["store", "vector"])
    slim = current_rows(log.withColumns(vector_keys(F.col("vector"), 64)), "id", "created_at", ["store", "k1", "k2", "usable"])
    return most_similar(rows, "id", "store", "vector", dim=64, slim=slim, fit_on=log)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_similar(spark, sf_dir).select("id", "neighbour_id")


_VECTORS = """
WITH once AS (SELECT DISTINCT id, store, vector, created_at FROM pgvector WHERE id IS NOT NULL),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM once) WHERE rn = 1),
v AS (SELECT id, store, vector::DOUBLE[] AS v FROM cur WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0),
sim AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.store IS NOT DISTINCT FROM b.store AND a.id <> b.id),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour_id) AS r FROM sim WHERE s >= 0.85)
"""

P1_FOUND = _VECTORS + "SELECT id, neighbour_id FROM top WHERE r <= 10"

LIMIT, OVERLAP = 2000, 200
MAX_SUBJECTS = 64


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every current text above the limit."""
    rows = current_where(table(spark, sf_dir, "pgvector"), "id", "created_at", F.length("text") > LIMIT, ["chunk_id", "text"])
    return split_items(rows, ["id", "chunk_id"], "text", LIMIT, OVERLAP)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level at which each text was cut, of texts whose pieces keep the limit and join up to the whole."""
    pieces = p3_pieces(spark, sf_dir).select("id", "cut_level", "n_chars", "n_new", "n_overlap", F.length("piece").alias("size"))
    sound = (F.max("size") <= LIMIT) & (F.max("n_overlap") <= OVERLAP) & (F.sum("n_new") == F.max("n_chars"))
    return pieces.groupBy("id", "cut_level").agg(sound.alias("sound")).where("sound").select("id", "cut_level")


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from the new parts of their pieces: ``id``, characters, MD5, pieces above the limit or the overlap."""
    pieces = p3_pieces(spark, sf_dir).withColumn("own", F.expr("substring(piece, n_overlap + 1)"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "own"))), lambda p: p["own"])
    broken = F.count_if((F.length("piece") > LIMIT) | (F.col("n_overlap") > OVERLAP) | (F.length("own") != F.col("n_new")))
    out = pieces.groupBy("id").agg(F.array_join(parts, "").alias("text"), broken.alias("n_broken"))
    return out.select("id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "n_broken")


P3_FOUND = r"""
WITH once AS (SELECT DISTINCT id, text, created_at FROM pgvector WHERE id IS NOT NULL),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM once) WHERE rn = 1 AND length(text) > 2000),
longest AS (SELECT id, list_max(list_transform(regexp_split_to_array(text, '\n([ \t\r]*\n)+'), lambda x: length(x))) AS p,
            list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS l,
            list_max(list_transform(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: length(x))) AS w FROM cur)
SELECT id, CASE WHEN p <= 2000 THEN 'paragraph' WHEN l <= 2000 THEN 'line' WHEN w <= 2000 THEN 'word' ELSE 'none' END AS cut_level FROM longest
"""


P3_REJOINED = """
WITH once AS (SELECT DISTINCT id, text, created_at FROM pgvector WHERE id IS NOT NULL),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM once) WHERE rn = 1 AND length(text) > 2000)
SELECT id, length(text) AS n_chars, md5(text) AS digest, CAST(0 AS BIGINT) AS n_broken FROM cur
"""


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a container of at most 2,048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p6_containers(spark, sf_dir))


def p6_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers, each with the number of cases against it, and the documents placed."""
    placed = p6_containers(spark, sf_dir)
    docs = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("piece_no").alias("last"), F.count_if(F.col("container_id").isNull() & (F.col("n_tokens") > 0)).alias("left"))
    docs = docs.agg(
        F.count("*").alias("documents"), F.count_if(F.col("left") > 0).alias("left_out"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= 2048)).alias("divided_within_capacity"), F.count_if(F.col("n") != F.col("last") + 1).alias("pieces_missing")
    )
    bins = placed.where("container_id is not null").groupBy("container_id").agg(
        F.sum("n_tokens").alias("used"), F.max("capacity").alias("size"), F.max(F.col("offset") + F.col("n_tokens")).alias("top"), F.countDistinct("offset").alias("places"), F.count("*").alias("n")
    )
    bins = bins.agg(F.count_if((F.col("used") > F.col("size")) | ~F.col("size").isin(256, 512, 1024, 2048)).alias("over_capacity"), F.count_if((F.col("top") != F.col("used")) | (F.col("places") != F.col("n"))).alias("overlapping"), (F.sum(F.col("size") - F.col("used")) > 0.02 * F.sum("size")).cast("int").cast("long").alias("wasteful"))
    return docs.join(F.broadcast(bins))


P6_SOUND = "SELECT count(DISTINCT doc_id) AS documents, " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("left_out", "divided_within_capacity", "pieces_missing", "over_capacity", "overlapping", "wasteful")) + " FROM documents"


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_documents(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_target"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents, in the order of their finish times."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per source."""
    return _mix(spark, sf_dir)[1]


def p7_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: its target, whether it has documents, and what must hold of its part of the mix.

    ``off_target``: the share differs by more than 0.002 from its part of the shares of sources that have documents;
    ``too_often``: documents taken more often than ``max_repeat``; ``copy_taken_twice``: one copy of a document twice.
    """
    mix, shares = _mix(spark, sf_dir)
    often = mix.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("last")).groupBy("source").agg(F.max("n").alias("most"), F.count_if(F.col("n") > F.col("last") + 1).alias("twice"))
    there = table(spark, sf_dir, "documents").where("length(text) > 0").groupBy("source").agg(F.lit(True).alias("there"))
    rows = shares.join(often, "source", "left").join(there, "source", "left").withColumn("has_documents", F.coalesce("there", F.lit(False)))
    within = F.sum(F.when(F.col("has_documents"), F.col("target_share"))).over(Window.partitionBy())  # one row per listed source
    off = F.when(F.col("has_documents"), F.abs(F.col("actual_share") - F.col("target_share") / within) > 0.002).otherwise(F.col("n_taken") > 0)
    return rows.select("source", F.round("target_share", 9).alias("target_share"), "has_documents", off.alias("off_target"), (F.coalesce("most", F.lit(0)) > F.col("max_repeat")).alias("too_often"), (F.coalesce("twice", F.lit(0)) > 0).alias("copy_taken_twice"))


P7_SOUND = """
WITH t AS (SELECT source, round(sum(target_share), 9) AS target_share FROM mix_target WHERE source IS NOT NULL AND target_share > 0 GROUP BY source)
SELECT source, target_share, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AS has_documents, false AS off_target, false AS too_often, false AS copy_taken_twice FROM t
"""


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document's sentences per subject."""
    subjects = [r["subject"] for r in table(spark, sf_dir, "subject_area").where("subject is not null").select("subject").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return subject_shares(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "subject_label"), subjects)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where(F.col("share") >= SHARE).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that treat it, and sentences."""
    rows = p8_shares(spark, sf_dir)
    return rows.groupBy("subject").agg(F.count_if(F.col("share") >= SHARE).alias("n_docs"), F.sum(F.round(F.col("share") * F.col("n_sentences"))).cast("long").alias("n_sentences"))


QUERIES = {
    "p1_found": p1_found, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined, "p6_containers": p6_containers, "p6_report": p6_report, "p6_sound": p6_sound,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_sound": p7_sound, "p8_found": p8_found, "p8_composition": p8_composition,
}
ORACLES = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_rejoined": P3_REJOINED, "p6_sound": P6_SOUND, "p7_sound": P7_SOUND}
