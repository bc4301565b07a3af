"""The three calls of a memory, over whole tables of facts and queries: retain, recall, reflect.

Tables in, tables out: nothing is written. What a call would write comes back as tables to append.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import models
from memlake.functions.predicates import NAMESPACE, invalid, valid_at
from memlake.functions.text import SPACE, derive_title, proposed_id, truncate
from memlake.operators import fusion, sessions, temporal
from memlake.operators.vector_search import first_matches, search
from memlake.session import cut

#: How alike a fact must be to one it contradicts.
CONFLICT = 0.92
#: The least score of a hit in a store.
LEAST = 0.35


def stamped(rows: DataFrame, namespace: dict[str, str | None]) -> DataFrame:
    """``rows`` with the keys that ``namespace`` sets laid over their own; keys it leaves open stay as they are, missing ones come as null."""
    have = set(rows.columns)
    new = {k: F.lit(namespace[k]) if namespace.get(k) is not None else F.col(k) if k in have else F.lit(None).cast("string") for k in NAMESPACE}
    return rows.withColumns(new)


@dataclass
class Retained:
    """What retaining a batch of facts gives.

    ``facts``: the new rows, with ``supersedes``; ``closures``: ``doc_id, valid_to, superseded_by`` of rows closed, stored or
    of the same batch; ``proposals``: ``id, proposed_id, title, body`` of facts that ask for one.
    """

    facts: DataFrame
    closures: DataFrame
    proposals: DataFrame

    def table(self, stored: DataFrame) -> DataFrame:
        """Stored and new rows with the closures applied."""
        every = stored.unionByName(self.facts.select([c for c in self.facts.columns if c in stored.columns]), allowMissingColumns=True)
        return applied(every, self.closures)


def retain(stored: DataFrame, facts: DataFrame, threshold: float = CONFLICT, namespace: list[str] | None = None, embed: Callable[[Column], Column] | None = None) -> Retained:
    """Retains ``facts`` in the order of ``seq``: each closes the earlier valid rows of its namespace that it contradicts.

    Both tables: ``id, seq, text, vector``, the ``namespace`` columns (of which those null in a fact match anything),
    ``status, valid_from, valid_to, superseded_by``; ``facts`` also ``policy`` (``coexist`` closes nothing, anything else, null
    too, supersedes) and ``inbound_type``, null without a proposal. A row is contradicted by a later fact of similarity
    ``threshold`` or more with another trimmed text; rows that are invalid already are not, and of several facts the first
    closes it, at the fact's ``valid_from``. Equal texts are no conflict and stay twice. ``seq`` must be greater than that of every stored row.
    Facts without a vector are embedded by ``embed`` if given, and else retained without a search.
    """
    names = namespace or []
    if embed is not None:
        facts = facts.withColumn("vector", F.coalesce("vector", embed(F.col("text")).cast(facts.schema["vector"].dataType)))
    text = collapse_ends(F.col("text"))
    closing = facts.where(~F.coalesce(F.col("policy") == "coexist", F.lit(False)))
    new = closing.select(F.col("id").alias("query_id"), "vector", "seq", text.alias("text"), *names)
    rows = lambda t: t.where(~invalid(F.col("status"), F.col("valid_to"))).select(F.col("id").alias("doc_id"), "vector", "seq", text.alias("text"), *names)
    hits = first_matches(new, rows(stored).unionByName(rows(facts)), threshold, names)
    starts = facts.select(F.col("id").alias("query_id"), F.col("valid_from").alias("new_valid_from"))
    pairs = hits.join(starts, "query_id").select(F.col("query_id").alias("new_id"), F.col("seq").alias("new_seq"), "new_valid_from", F.col("doc_id").alias("old_id"), "score")
    closed, back = temporal.resolve_conflicts(pairs)
    facts = facts.drop("supersedes").join(back.select(F.col("new_id").alias("id"), "supersedes"), "id", "left")
    asked = facts.where("inbound_type is not null").select("id", proposed_id(F.col("inbound_type"), F.col("text")).alias("proposed_id"), derive_title(F.col("text")).alias("title"), F.col("text").alias("body"))
    return Retained(facts, closed.withColumnRenamed("old_id", "doc_id"), asked)


def collapse_ends(x: Column) -> Column:
    """White space of any kind at both ends removed."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def applied(rows: DataFrame, closures: DataFrame) -> DataFrame:
    """``rows`` with the closures laid over those still open."""
    new = closures.select(F.col("doc_id").alias("id"), F.col("valid_to").alias("__to"), F.col("superseded_by").alias("__by"))
    met = rows.join(new, "id", "left")
    open_ = F.col("valid_to").isNull() & F.col("__to").isNotNull()
    return met.withColumns({"superseded_by": F.when(open_, F.col("__by")).otherwise(F.col("superseded_by")), "valid_to": F.when(open_, F.col("__to")).otherwise(F.col("valid_to"))}).drop("__to", "__by")


def valid_rows(rows: DataFrame, as_of: Column | None = None, include_superseded: bool = True) -> DataFrame:
    """Rows a recall sees: all of them, those valid at ``as_of``, or with ``include_superseded`` false the ones open and not invalid."""
    if as_of is not None:
        return rows.where(F.coalesce(valid_at(F.col("valid_from"), F.col("valid_to"), as_of), F.lit(False)))
    return rows if include_superseded else rows.where(~invalid(F.col("status"), F.col("valid_to")))


def vector_hits(queries: DataFrame, docs: DataFrame, k: int = 5, threshold: float = LEAST, namespace: list[str] | None = None) -> DataFrame:
    """Hits of stores: ``query_id, doc_id, source, path, status, snippet, score``, the ``k`` best of each store.

    ``queries``: ``query_id, vector``; ``docs``: ``id, store, vector, text, source, status``; both with the namespace columns. Text and
    metadata are joined to the hits, not shipped through the search.
    """
    names = namespace or []
    found = search(queries.select("query_id", "vector", *names), docs.select(F.col("id").alias("doc_id"), "vector", "store", *names), k, threshold, names, per="store").drop("rank")
    more = docs.select(F.col("id").alias("doc_id"), F.col("source").alias("path"), "status", truncate(F.col("text"), 240).alias("snippet"))
    return found.withColumnRenamed("store", "source").withColumn("score", F.round("score", 9)).join(more, "doc_id")


def atom_hits(queries: DataFrame, atoms: DataFrame) -> DataFrame:
    """Hits of queries that are an atom's id as written: score 1, the title as snippet."""
    held = atoms.select(F.col("id").alias("doc_id"), "path", "status", F.coalesce("title", "id").alias("snippet"))
    return queries.select("query_id", F.col("query").alias("doc_id")).join(held, "doc_id").withColumns({"source": F.lit("atomic"), "score": F.lit(1.0)})


def note_hits(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Hits of a notes search, as ``sources.files.normalise_hits`` gives them."""
    return found.join(queries.select("query_id"), "query_id", "left_semi").select("query_id", F.col("path").alias("doc_id"), "path", F.lit("notes").alias("source"), F.lit(None).cast("string").alias("status"), "snippet", "score")


def recall(
    queries: DataFrame, docs: DataFrame, atoms: DataFrame | None = None, notes: DataFrame | None = None, strategy: str = "multi", k: int = 5, cap: int = 10, threshold: float = LEAST,
    namespace: list[str] | None = None, as_of: Column | None = None, include_superseded: bool = True, rerank: bool = False, window: int = fusion.RERANK_LIMIT,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The best hits of every query over all sources of ``strategy``: ``query_id, doc_id, source, path, status, snippet, score, rank``.

    ``queries``: ``query_id, query, vector`` and the ``namespace`` columns. ``docs``: vector rows of any stores; rows of store
    ``episodic`` belong to the episodic source, all others to ``vector``. ``atoms``: the index, asked where a query is an id.
    ``notes``: results of a notes search. Of hits of one path the best counts, stable ones get a boost, ``cap`` come out;
    with ``rerank`` the first ``window`` are reordered by a second score (default: BM25 of the whole query on the snippets).
    ``as_of`` and ``include_superseded``: see ``valid_rows``; atoms and notes are not filtered by either, nor by namespace.
    """
    asked = fusion.sources_of(strategy, notes is not None)
    seen = valid_rows(docs, as_of, include_superseded)
    if not {"vector", "episodic"} <= set(asked):
        episodic = F.coalesce(F.col("store") == "episodic", F.lit(False))
        seen = seen.where(episodic if "episodic" in asked else ~episodic if "vector" in asked else F.lit(False))
    parts = []
    if "vector" in asked or "episodic" in asked:
        parts.append(vector_hits(queries, seen, k, threshold, namespace))
    if "atomic" in asked and atoms is not None:
        parts.append(atom_hits(queries, atoms))
    if "notes" in asked and notes is not None:
        parts.append(note_hits(queries, notes))
    if not parts:
        parts = [vector_hits(queries, docs.limit(0), k, threshold, namespace)]
    fused = fusion.fuse(fusion.union_hits(*parts), max(cap, window) if rerank else cap)
    if rerank:
        # at most max(cap, window) rows a query, read several times by the second score
        fused = fusion.rerank(cut(fused.join(queries.select("query_id", "query"), "query_id")), limit=window, scorer=scorer).where(F.col("rank") <= cap)
    return fused.select("query_id", "doc_id", "source", "path", "status", "snippet", "score", "rank")


def reflect(steps: DataFrame, keep: float = 0.45, force: bool = False, complete: Callable[[list[str]], list[str]] | None = None, min_messages: int = 30, min_minutes: float = 60) -> tuple[DataFrame, DataFrame]:
    """Episodes and proposals of the sessions that are due (or all, with ``force``).

    ``steps``: see ``sessions.trace_steps``. First result: ``session_id, n_user, n_agent, n_tool, minutes, summary, tags``; with
    ``complete``, a model over prompts of the last steps, its summary where its answer is usable, and ``answer``. Second: the
    proposals of ``sessions.proposals``. A session that is written twice is the caller's to refuse, see ``sources.files.write_new``.
    """
    stats = sessions.session_stats(steps, min_messages, min_minutes)
    due = stats if force else stats.where("due")
    key = lambda t: t.select("*", F.struct("session_id").alias("__sid")).drop("session_id")
    mine = key(due.select("session_id"))
    chosen = steps.select("*", F.struct("session_id").alias("__sid")).join(mine, "__sid", "left_semi").drop("__sid")
    episodes = due.select("*", F.struct("session_id").alias("__sid")).join(key(sessions.summaries(chosen)), "__sid")
    if complete is not None:
        episodes = episodes.withColumnRenamed("summary", "plain").join(key(sessions.prompts(chosen)), "__sid", "left")
        episodes = models.summarised(episodes, "prompt", "plain", complete).drop("prompt", "plain")
    return episodes.drop("__sid", "due"), sessions.proposals(chosen, keep)
