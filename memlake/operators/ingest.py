"""Incremental ingestion: front matter to index rows, content hashes, what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import body, front_fields, is_atomic_id
from memlake.operators.markdown import chunk_markdown


def index_rows(notes: DataFrame, path: str, text: str) -> DataFrame:
    """Index rows from the front matter of notes, or why there is none: ``path, id, phase, type, status, skip``.

    ``skip``: ``no front matter``, ``no id``, ``bad id`` or ``bad phase`` (not a whole number from 0 to 5), else null.
    A missing phase is 0.
    """
    f = front_fields(F.col(text))
    get = lambda k: F.nullif(f[k], F.lit(""))
    phase = F.coalesce(get("phase"), F.lit("0")).try_cast("int")
    skip = F.when(F.size(f) == 0, "no front matter").when(get("id").isNull(), "no id").when(~is_atomic_id(get("id")), "bad id").when(phase.isNull() | ~phase.between(0, 5), "bad phase")
    return notes.select(F.col(path).alias("path"), get("id").alias("id"), phase.alias("phase"), get("type").alias("type"), get("status").alias("status"), skip.alias("skip"))


def reindex(notes: DataFrame, path: str, text: str) -> DataFrame:
    """The index: rows that are not skipped, of equal ids the one with the least path."""
    rows = index_rows(notes, path, text).where("skip is null")
    first = rows.groupBy("id").agg(F.min_by(F.struct("path", "phase", "type", "status"), "path").alias("x"))
    return first.select("x.path", "id", "x.phase", "x.type", "x.status")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text, null as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hash_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both manifests (``key, hash``) side by side: ``key, change`` of ``added``, ``changed``, ``unchanged``, ``deleted``."""
    a, b = old.select(key, F.col("hash").alias("__old")), new.select(key, F.col("hash").alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def states_at(log: DataFrame, key: str, text: str, at: str, moment: Column) -> DataFrame:
    """The manifest (``key, hash``) of a log as of a moment: of each key the latest row not after it."""
    seen = log.where(F.col(key).isNotNull() & (F.col(at) <= moment))
    return seen.groupBy(key).agg(F.max_by(content_hash(F.col(text)), at).alias("hash"))


def embed_changed(chunks: DataFrame, notes: DataFrame, stored: DataFrame, key: str, text: str, embed: Callable[[Column], Column], **options) -> tuple[DataFrame, DataFrame]:
    """Incremental re-embedding: the chunk table with vectors after a change of notes, and the new manifest of file hashes.

    ``chunks``: the table so far, with the columns of ``chunk_markdown`` and ``vector``; ``stored``: the manifest it was made from
    (``key, hash``). Only chunks of added and changed notes are made and embedded; those of changed and deleted ones go.
    """
    now = notes.select(key, content_hash(F.col(text)).alias("hash"))
    diff = hash_diff(stored, now, key)
    kept = refresh_chunks(chunks.drop("vector"), notes, diff, key, text, **options)
    held = chunks.select(key, "chunk_no", "vector")
    fresh = diff.where(F.col("change").isin("added", "changed")).select(key)
    made = kept.join(fresh, key, "left_semi").withColumn("vector", embed(F.col("chunk")))
    old = kept.join(fresh, key, "left_anti").join(held, [key, "chunk_no"], "left")
    return old.unionByName(made), now


def refresh_chunks(chunks: DataFrame, notes: DataFrame, diff: DataFrame, key: str, text: str, **options) -> DataFrame:
    """The chunk table after a change: chunks of changed and deleted notes dropped, those of added and changed ones made anew.

    ``chunks`` has the columns of ``chunk_markdown``. Chunk ids follow from key, number and content, so that
    a repeated refresh changes nothing.
    """
    stale = diff.where(F.col("change").isin("changed", "deleted")).select(key)
    fresh = diff.where(F.col("change").isin("added", "changed")).select(key)
    made = chunk_markdown(notes.join(fresh, key, "left_semi"), [key], text, **options)
    return chunks.join(stale, key, "left_anti").unionByName(made)


def chunk_id(key: Column, no: Column, chunk: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of key, number and content hash."""
    return F.substring(F.sha2(F.concat_ws("::", key.cast("string"), no.cast("string"), F.sha2(chunk, 256)), 256), 1, 32)


def bodies(notes: DataFrame, path: str, text: str) -> DataFrame:
    """Note bodies without front matter: ``path, body``. Paths that climb out of the tree are left out."""
    safe = ~F.col(path).cast("string").rlike(r"(^|/)\.\.(/|$)")
    return notes.where(safe).select(F.col(path).alias("path"), body(F.col(text)).alias("body"))
