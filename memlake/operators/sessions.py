"""Sessions from traces: counts, triggers, topics, proposal scores, summaries, folding of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import atomic_id, clamp01, one_line_turn, slugify, truncate
from memlake.operators import skew

# Words that are no topic.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "from", "have", "been",
    "will", "what", "when", "where", "which", "about", "there", "their",
)
# A word boundary between ASCII word characters and anything else.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
KINDS = ("user", "agent", "tool", "brain", "memory", "system")


def trace_steps(docs: DataFrame, session: str, at: str, order: str, text: str) -> DataFrame:
    """Steps of transcripts, one row for each ``kind: content`` line: ``session_id, at, doc, line, kind, content``.

    Lines of no known kind are no steps; null sessions form a session of their own.
    """
    lines = docs.select(F.col(session).alias("session_id"), F.col(at).alias("at"), F.col(order).alias("doc"), F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw"))
    pattern = rf"^({'|'.join(KINDS)}): (.*)$"
    return lines.where(F.col("raw").rlike(pattern)).select("session_id", "at", "doc", "line", F.regexp_extract("raw", pattern, 1).alias("kind"), F.regexp_extract("raw", pattern, 2).alias("content"))


def _order() -> Column:
    return F.struct("at", "doc", "line")


def session_stats(steps: DataFrame, min_messages: int = 30, min_minutes: float = 60) -> DataFrame:
    """Turns by kind, first and last step, minutes to one place, and whether the session is due for consolidation (both limits reached)."""
    minutes = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 60_000_000
    out = steps.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "user").alias("n_user"), F.count_if(F.col("kind") == "agent").alias("n_agent"), F.count_if(F.col("kind") == "tool").alias("n_tool"),
        minutes.alias("__m"),
    )
    out = out.withColumns({"minutes": F.floor(F.col("__m") * 10 + 0.5) / 10, "due": (F.col("n_user") + F.col("n_agent") >= min_messages) & (F.col("__m") >= min_minutes)})
    return out.drop("__m")


def topics(steps: DataFrame, most: int = 6) -> DataFrame:
    """The commonest terms of each session's user and agent turns: ``session_id, term, n, rank``.

    Terms are ASCII words of four letters or more as written, stop words whatever their case left out;
    equal counts rank by first occurrence, then by the term. Counts are combined before the shuffle.
    """
    words = F.regexp_extract_all("content", F.lit(rf"{_EDGE}([A-Za-z][A-Za-z\-]{{3,}}){_EDGE}"), F.lit(1))
    said = steps.where(F.col("kind").isin("user", "agent")).select("session_id", "at", "doc", "line", F.posexplode(words).alias("pos", "term"))
    said = said.where(~F.lower("term").isin(*STOP_WORDS))
    counted = said.groupBy("session_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("at", "doc", "line", "pos")).alias("first"))
    order = Window.partitionBy("session_id").orderBy(F.desc("n"), "first", "term")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("first")


def proposals(steps: DataFrame, keep: float = 0.45, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Proposed atoms of each session with a three-part score: ``session_id, proposed_id, title, n, score``.

    Candidates are the first five capitalised topics named twice or more. Relevance grows with the
    mentions; frequency is the share of steps that contain the id or title, full at five; recency is the
    place of the last such step. ``weights`` weigh them in this order; scores below ``keep`` drop out.
    """
    top = topics(steps).where((F.col("n") >= 2) & F.col("term").rlike("^[A-Z]"))
    first = Window.partitionBy("session_id").orderBy("rank")
    top = top.withColumn("__r", F.row_number().over(first)).where("__r <= 5").drop("__r").withColumn("proposed_id", atomic_id("INSIGHT", F.col("term")))
    # structs compare null as equal to null, so that the null session is joined like any other
    by = F.struct("session_id").alias("__sid")
    placed = skew.positions(steps.withColumn("__o", F.coalesce(F.unix_micros("at"), F.lit(0))), ["session_id"], "__o", ["doc", "line"], "__i", rows_per_task)
    left, right, on = skew.salted(placed.select(by, "doc", "line", "content", "__i"), top.select(by, "term", "proposed_id"), ["__sid"], ["doc", "line"], rows_per_task)
    named = left.join(right, on).where(F.contains("content", F.col("proposed_id")) | F.contains("content", F.col("term")))
    refs = named.groupBy("__sid", "term").agg(F.count("*").alias("refs"), F.max("__i").alias("last"))
    sizes = steps.groupBy("session_id").agg(F.count("*").alias("size")).select(by, "size")
    met = top.select("*", by).join(refs, ["__sid", "term"], "left").join(sizes, "__sid")
    relevance = clamp01(0.3 + F.col("n") * 0.1)
    frequency = clamp01(F.coalesce("refs", F.lit(0)) / 5)
    recency = F.when(F.col("last").isNull(), F.lit(0.0)).otherwise(clamp01((F.col("last") + 1) / F.greatest(F.lit(1), F.col("size"))))
    score = weights[0] * relevance + weights[1] * frequency + weights[2] * recency
    return met.select("session_id", "proposed_id", F.col("term").alias("title"), "n", score.alias("score")).where(F.col("score") >= keep)


def summaries(steps: DataFrame) -> DataFrame:
    """A plain summary of each session from its counts, first request and last answer, with its leading topics as tags."""
    ends = steps.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "user").alias("u"), F.count_if(F.col("kind") == "agent").alias("a"), F.count_if(F.col("kind") == "tool").alias("t"),
        F.min_by("content", F.when(F.col("kind") == "user", _order())).alias("first"), F.max_by("content", F.when(F.col("kind") == "agent", _order())).alias("last"),
    )
    text = F.format_string(
        'Session %s: %d user turns, %d agent turns, %d tool calls. Asked first: "%s". Answered last: "%s".',
        F.coalesce("session_id", F.lit("")), "u", "a", "t", truncate(F.coalesce("first", F.lit("")), 140), truncate(F.coalesce("last", F.lit("")), 200),
    )
    tags = topics(steps).where("rank <= 5").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", slugify(F.col("term")).alias("tag")))).alias("x"))
    tags = tags.select(F.col("session_id").alias("__s"), F.array_join(F.transform("x", lambda r: r["tag"]), ",").alias("tags"))
    met = ends.join(tags, ends["session_id"].eqNullSafe(tags["__s"]), "left")
    return met.select("session_id", text.alias("summary"), F.coalesce("tags", F.lit("")).alias("tags"))


def recent_steps(steps: DataFrame, most: int = 200) -> DataFrame:
    """The last ``most`` steps of each session, in their order: ``session_id, n`` (from 1) and the columns of ``steps``.

    No more than ``most`` rows a session leave the partial ranking, so a long session is no burden.
    """
    back = Window.partitionBy("session_id").orderBy(F.desc_nulls_last("at"), F.desc("doc"), F.desc("line"))
    last = steps.withColumn("__b", F.row_number().over(back)).where(F.col("__b") <= most)
    return last.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("__b")))).drop("__b")


def prompts(steps: DataFrame, most: int = 200) -> DataFrame:
    """One text per session of its last ``most`` steps, a labelled line each: ``session_id, prompt``; at most ``most`` lines are gathered."""
    lines = recent_steps(steps, most).select("session_id", F.struct("n", one_line_turn(F.col("kind"), F.col("content")).alias("text")).alias("line"))
    held = lines.groupBy("session_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return held.select("session_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("prompt"))


def cascade(rows: DataFrame, keys: list[str], order: str, ties: list[str], every: int, sums: list[str]) -> DataFrame:
    """Every ``every`` consecutive rows of a key folded into one: ``keys, fold, n_rows``, the sums, and the range of ``order``."""
    placed = skew.positions(rows, keys, order, ties, "__i")
    folded = placed.withColumn("fold", F.floor(F.col("__i") / every).cast("long"))
    return folded.groupBy(*keys, "fold").agg(F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in sums], F.min(order).alias("first"), F.max(order).alias("last"))


def keep_strongest(rows: DataFrame, key: str, strength: str, seq: Column, columns: list[str]) -> DataFrame:
    """Of each concept the row of greatest ``strength``; equal ones: the one that came first, then the least ``columns``."""
    best = F.min_by(F.struct(*columns, strength), F.struct(-F.col(strength), seq, *columns))
    return rows.where(F.col(key).isNotNull() & F.col(strength).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, "b.*")
