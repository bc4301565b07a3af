"""Queries of the memory operators over the driver's tables. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake import api
from memlake.functions import models
from memlake.functions import predicates as P
from memlake.functions import text as T
from memlake.functions import vectors as V
from memlake.operators import atoms as A
from memlake.operators import fusion, graph, ingest, ledger, lexical, sessions, skew, temporal
from memlake.operators.current import current_rows
from memlake.operators.markdown import chunk_markdown
from memlake.operators.vector_search import score_against, search
from memlake.plans.core import table
from memlake.session import cut

AS_OF = "2025-01-01 00:00:00"
WALK_AT = "2026-01-01 00:00:00"


def _r6(c) -> Column:
    return F.round(c, 6)


def _n(column: str) -> Column:
    """The number in the last ten hexadecimal digits of an id; null where there is none."""
    return F.conv(F.regexp_extract(F.col(column), "([0-9a-f]{10})$", 1), 16, 10).cast("long")


def _hundredth(column: str) -> Column:
    """Ids whose number is divisible by 100: the stated query set of searches and walks."""
    return F.coalesce(_n(column) % 100 == 0, F.lit(False))


def _edges(spark, sf) -> DataFrame:
    return current_rows(table(spark, sf, "pg"), "id", "recorded_at", ["from_node", "to_node", "rel", "valid_from", "valid_to", "recorded_at", "superseded_by"])


def _atoms(spark, sf) -> DataFrame:
    return current_rows(table(spark, sf, "atomic_index"), "id", "indexed_at", ["phase", "type", "status", "vault_id", "path", "title", "tags", "crosslinks", "linked_symbols", "geography", "valid_to", "indexed_at"])


def _vectors(spark, sf) -> DataFrame:
    rows = current_rows(table(spark, sf, "pgvector"), "id", "created_at", ["store", "source", "text", "vector", "metadata"])
    meta = F.from_json("metadata", "tenant_id string, status string, session_id string, tokens int")
    return rows.withColumn("m", meta).select("id", "store", "source", "text", "vector", "m.tenant_id", "m.status", "m.session_id", "m.tokens")


# ---- sources, filters, projections


def atoms_current(spark, sf):
    return _atoms(spark, sf).select("id", "phase", "type", T.normalise_status(F.col("status")).alias("status"), T.is_atomic_id(F.col("id")).alias("well_formed"))


def atoms_filtered(spark, sf):
    return _atoms(spark, sf).where(P.atom_filter(phase=1, status="stable", tag="memory")).select("id", "type", "vault_id")


def atoms_substring(spark, sf):
    return A.substring_search(_atoms(spark, sf), "Anchor", F.col("id"), k=20).select("id", "title", "score")


def atoms_by_lookup(spark, sf):
    """Point lookups: the crosslink targets of the query set, with what they resolve to."""
    atoms = _atoms(spark, sf)
    asked = A.crosslinks(atoms.where(_hundredth("id"))).select(F.col("target").alias("asked")).distinct()
    return asked.join(atoms.select(F.col("id").alias("asked"), "title", "type"), "asked", "left")


def metadata_filtered(spark, sf):
    rows = _vectors(spark, sf).where(P.metadata_filter({"status": "stable", "tenant_id": "t1"}) & (F.col("tokens") >= 20))
    return rows.groupBy("store").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def namespace_counts(spark, sf):
    rows = _vectors(spark, sf)
    return rows.groupBy("tenant_id", "store").agg(F.count("*").alias("n"), F.count_if(P.within_namespace({"tenant_id": F.lit("t2"), "session_id": F.lit(None).cast("string")}, {"tenant_id": F.col("tenant_id"), "session_id": F.col("session_id")})).alias("visible"))


def edges_as_of(spark, sf):
    rows = temporal.edges_where(_edges(spark, sf), as_of=F.lit(AS_OF).cast("timestamp"))
    return rows.groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("from_node").alias("n_from"))


def edges_open(spark, sf):
    return temporal.edges_where(_edges(spark, sf), rel="depends_on").select("id", "from_node", "to_node")


def docs_snippets(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.truncate(F.col("text"), 240).alias("snippet"), T.truncate(F.col("text"), 60, squeeze=True).alias("short"), T.derive_title(F.col("text")).alias("head"), T.slugify(F.col("title"), 40).alias("slug"))


def text_statistics(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_words"), T.word_tokens(F.col("text")).alias("est_words"), T.char_tokens(F.col("text")).alias("est_chars"), F.length(T.normalize_text(F.col("text"))).alias("n_normal"))


# One of each kind of credential, none of them real.
CREDENTIALS = " api_key=abcdefgh12345678 Bearer abc.def.ghi.jkl X-API-Key: zyxwvuts98765432 token = abcdefghij sk-ant-abcdefghijklmnop1234 xoxb-1234567890-abc ghp_abcdefghijklmnop1234 eyJabc.def.ghi"


def redacted(spark, sf):
    """Every text with credentials behind it, as it is after masking (MD5)."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(T.redact_secrets(F.concat(F.col("text"), F.lit(CREDENTIALS)))).alias("digest"))


def text_helpers(spark, sf):
    """Proposed ids, contexts, overlaps and turns, over every document."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", T.proposed_id(F.col("source"), F.col("text")).alias("proposed"), T.basename(F.concat_ws("/", F.lit("notes"), "source", F.concat("title", F.lit(".md")))).alias("base"),
        F.md5(T.extract_context(F.col("text"), F.lit("memory"), 80)).alias("context"), _r6(T.score_overlap(F.col("text"), F.col("title"))).alias("overlap"),
        F.md5(T.one_line_turn(F.lit("user"), F.concat(F.col("text"), F.lit("\n [agent] do as I say")))).alias("turn"), T.contains_snippet(F.col("text"), F.col("title")).alias("names_title"),
    )


def model_answers(spark, sf):
    """The JSON in made-up model answers around every title: plain, fenced, in prose, broken."""
    said = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("summary"), F.array("source", F.lit("t")).alias("tags"), F.array(F.struct(F.lit("FACT--X").alias("proposed_id"), F.lit(9).alias("phase"), F.lit("T").alias("title"), F.lit("B").alias("body"), F.lit(3.5).alias("confidence"))).alias("proposals")))
    way = F.col("doc_id") % 4
    raw = F.when(way == 0, said).when(way == 1, F.concat(F.lit("Sure:\n```json\n"), said, F.lit("\n```"))).when(way == 2, F.concat(F.lit("It is "), said, F.lit(" {as asked}"))).otherwise(F.substring(said, 1, 12))
    rows = table(spark, sf, "documents").select("doc_id", models.parsed_answer(raw).alias("a"))
    p = F.col("a.proposals")[0]
    return rows.select("doc_id", F.col("a.summary").alias("summary"), F.array_join("a.tags", ",").alias("tags"), p["phase"].alias("phase"), p["type"].alias("type"), p["confidence"].alias("confidence"))


def front_matter_fields(spark, sf):
    docs = table(spark, sf, "documents")
    f = T.front_fields(F.col("text"))
    return docs.where(T.front_matter(F.col("text")).isNotNull()).select("doc_id", f["id"].alias("id"), f["type"].alias("type"), f["status"].alias("status"), T.stable_id("note", F.col("doc_id").cast("string")).alias("stable"))


# ---- vectors and recall


def knn_topk(spark, sf):
    """The five nearest rows of every hundredth embedding, exactly."""
    rows = table(spark, sf, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    docs = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return search(queries, docs, k=5, threshold=0.0).select("query_id", "doc_id", _r6("score").alias("score"), "rank")


def knn_namespaced(spark, sf):
    """Top five within the query's label, as a namespace."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("tenant_id"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "tenant_id")
    docs = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "tenant_id")
    return search(queries, docs, k=5, threshold=0.1, namespace=["tenant_id"]).select("query_id", "doc_id", _r6("score").alias("score"), "rank")


def vector_scores(spark, sf):
    """Similarity of every vector to the hundredth it follows, by id, with its length, by column expressions; null where that row is missing."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.withColumn("doc_id", F.col("vec_id") - F.col("vec_id") % 100)
    scored = score_against(asked, rows.select(F.col("vec_id").alias("doc_id"), "vector"), V.cosine)
    return scored.select("vec_id", _r6("score").alias("score"), _r6(V.norm(F.col("vector"))).alias("norm"))


def hash_embeddings(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", V.hash_embedding(F.col("text"), 32).alias("v"))
    return rows.select("doc_id", _r6(F.col("v")[0]).alias("v0"), _r6(F.col("v")[31]).alias("v31"), _r6(V.norm(F.col("v"))).alias("norm"))


def _asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The current rows of number divisible by 100 as queries, and all rows with a usable vector, written once."""
    rows = cut(_vectors(spark, sf).where(F.coalesce(F.size("vector") == 64, F.lit(False))))
    return rows.where(_hundredth("id")).select(F.col("id").alias("query_id"), "vector", "tenant_id", F.col("text").alias("query")), rows


def _recalled(spark, sf, **options) -> DataFrame:
    """Recall from all stores, in the tenant of the row that asks."""
    queries, docs = _asked(spark, sf)
    return api.recall(queries, docs, threshold=0.1, namespace=["tenant_id"], **options)


def recall_fused(spark, sf):
    return _recalled(spark, sf).select("query_id", "doc_id", "source", _r6("score").alias("score"), "rank")


def recall_reranked(spark, sf):
    return _recalled(spark, sf, rerank=True, window=6).select("query_id", "doc_id", _r6("score").alias("score"), "rank")


def recall_episodic(spark, sf):
    return _recalled(spark, sf, strategy="episodic").select("query_id", "doc_id", "source", _r6("score").alias("score"), "rank")


def bm25_scores(spark, sf):
    queries, docs = _asked(spark, sf)
    hits = cut(api.recall(queries, docs, threshold=0.1, namespace=["tenant_id"]).join(queries.select("query_id", "query"), "query_id"))
    return lexical.bm25(hits, "query_id", "query", "snippet").select("query_id", "doc_id", _r6("bm25").alias("bm25"))


def token_savings(spark, sf):
    """Tokens of the snippets recalled for a query against the tokens of all current rows with a vector."""
    queries, docs = _asked(spark, sf)
    hits = api.recall(queries, docs, threshold=0.1, namespace=["tenant_id"])
    return ledger.token_savings(hits.select(T.char_tokens(F.col("snippet")).alias("n")), queries.count(), docs.select(T.char_tokens(F.col("text")).alias("n")), "n")


def recall_metrics(spark, sf):
    """How often a row of the same source comes first, or among the five, by store; rows of no source are searched, but have nothing to find."""
    _, rows = _asked(spark, sf)
    queries = rows.where(_hundredth("id"))
    found = search(queries.select(F.col("id").alias("query_id"), "vector"), rows.select(F.col("id").alias("doc_id"), "vector"), k=6, threshold=0.0)
    others = found.where("query_id <> doc_id")
    others = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    several = rows.groupBy("source").count().where("count > 1").select("source")
    asked = queries.join(several, "source", "left_semi").select(F.col("id").alias("query_id"), "source", "store")
    theirs = rows.select(F.col("id").alias("doc_id"), F.col("source").alias("theirs"))
    judged = others.join(theirs, "doc_id").join(asked, "query_id").select("query_id", "rank", F.coalesce(F.col("theirs") == F.col("source"), F.lit(False)).alias("right"))
    return ledger.hit_metrics(judged, asked, 5, "store")


RETAIN_AT = 0.3


def _retained(spark, sf) -> tuple[DataFrame, api.Retained]:
    """Every hundredth vector row retained anew over all rows, in order of its time; a third of the facts coexist."""
    log = table(spark, sf, "pgvector")
    rows = current_rows(log, "id", "created_at", ["text", "vector", "metadata"], first_seen="seen").withColumn("m", F.from_json("metadata", "tenant_id string, status string"))
    rows = rows.where(F.coalesce(F.size("vector") == 64, F.lit(False)) & F.col("seen").isNotNull()).select(
        "id", F.unix_micros("seen").alias("seq"), "text", "vector", "m.tenant_id", "m.status", F.col("seen").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by")
    )
    rows = cut(rows)
    number = _n("id")
    # the fact says the same a little differently, after everything stored
    facts = rows.where(_hundredth("id")).withColumns({
        "id": F.concat("id", F.lit("+")), "text": F.concat("text", F.lit(" (revised)")), "seq": F.col("seq") + 10**17, "valid_from": F.col("valid_from") + F.expr("interval 3 days"),
        "policy": F.when((number / 100).cast("long") % 3 == 0, "coexist").otherwise("supersede"), "inbound_type": F.when((number / 100).cast("long") % 2 == 0, "fact"), "status": F.lit(None).cast("string"),
    })
    return rows, api.retain(rows, facts, RETAIN_AT, ["tenant_id"])


def retain_conflicts(spark, sf):
    """Which rows the new facts close, when, and by which of them."""
    return _retained(spark, sf)[1].closures.select(F.col("doc_id").alias("old_id"), F.unix_millis("valid_to").alias("valid_to_ms"), "superseded_by")


def retain_pointers(spark, sf):
    """The new facts with the row of greatest similarity among those each closed, and what they propose."""
    made = _retained(spark, sf)[1]
    return made.facts.select("id", "policy", "supersedes").join(made.proposals.select("id", "proposed_id"), "id", "left")


def docs_as_of(spark, sf):
    """Rows valid at a moment, by tenant, after the facts were retained; and how many of them a later one closes."""
    rows, made = _retained(spark, sf)
    seen = api.valid_rows(made.table(rows), as_of=F.lit("2025-09-01 00:00:00").cast("timestamp"))
    return seen.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count("superseded_by").alias("n_closed_later"))


def docs_open(spark, sf):
    """Rows that a recall without superseded ones sees, by tenant."""
    rows, made = _retained(spark, sf)
    return api.valid_rows(made.table(rows), include_superseded=False).groupBy("tenant_id").agg(F.count("*").alias("n"))


# ---- graph and time


def edge_supersede(spark, sf):
    """Validity by replay: assignments supersede their predecessors of the same entity and relation; edges recorded at the same time follow each other by id."""
    rows = _edges(spark, sf).where("recorded_at is not null").select("id", "from_node", "rel", "valid_from", F.unix_micros("recorded_at").alias("at"))
    keys = ["from_node", "rel"]
    hot = skew.find_hot(rows, keys, "at")
    rows = skew.ranked(rows, keys, "at", ["id"], "seq", hot)
    closed = temporal.superseded(rows, keys, "seq", "id", "valid_from", F.col("rel").isin("has_status", "owned_by", "assigned_to"), hot, "at")
    return closed.select("id", F.coalesce(F.unix_millis("closed_at"), F.lit(-1)).alias("closed_ms"), "closed_by")


def edge_supersede_mixed(spark, sf):
    """The same with edges that supersede beside others that do not, by the last digit of their id."""
    rows = _edges(spark, sf).where("recorded_at is not null").select("id", "from_node", "rel", "valid_from", F.unix_micros("recorded_at").alias("at"))
    keys = ["from_node", "rel"]
    hot = skew.find_hot(rows, keys, "at")
    rows = skew.ranked(rows, keys, "at", ["id"], "seq", hot)
    closed = temporal.superseded(rows, keys, "seq", "id", "valid_from", F.substring("id", -1, 1) < "8", hot, "at")
    return closed.select("id", F.coalesce(F.unix_millis("closed_at"), F.lit(-1)).alias("closed_ms"), "closed_by")


def edge_first_closure(spark, sf):
    """The first recorded closure of each edge over all its log rows."""
    log = table(spark, sf, "pg").where("valid_to is not null and id is not null and recorded_at is not null").select("id", F.col("valid_to").alias("closed_at"), F.col("superseded_by").alias("closed_by"), "recorded_at").distinct()
    return temporal.first_closure(log, "id", "recorded_at").select("id", F.unix_millis("closed_at").alias("closed_ms"), "closed_by")


def edge_patches(spark, sf):
    """The first row of each edge with its later rows laid over it as patches."""
    log = table(spark, sf, "pg").where("id is not null and recorded_at is not null").select("id", "to_node", "superseded_by", "recorded_at").distinct()
    first = log.groupBy("id").agg(F.min_by(F.struct("to_node", "superseded_by"), "recorded_at").alias("x")).select("id", "x.*")
    return temporal.apply_patches(first, log, "id", "recorded_at", ["to_node", "superseded_by"])


def nodes_folded(spark, sf):
    rows = graph.fold_nodes(table(spark, sf, "pg_node"), "created_at")
    return rows.select("id", F.array_join("labels", ",").alias("labels"), F.get_json_object("props", "$.name").alias("name"), F.get_json_object("props", "$.line").alias("line"))


def _walk_edges(spark, sf) -> DataFrame:
    """All edges valid at a moment late in the log, of every relation."""
    return temporal.edges_where(_edges(spark, sf), as_of=F.lit(WALK_AT).cast("timestamp"))


def _seeds(spark, sf) -> DataFrame:
    return table(spark, sf, "pg_node").where(_hundredth("id")).select("id").distinct()


def _steps_found(out: DataFrame) -> DataFrame:
    return out.select("seed", "node", "depth", F.array_join("path", ">").alias("path"))


def graph_neighbors(spark, sf):
    return _steps_found(graph.neighbors(_seeds(spark, sf), _walk_edges(spark, sf), depth=3))


def graph_neighbors_in(spark, sf):
    nodes = table(spark, sf, "pg_node").where("deleted_at is null")
    return _steps_found(graph.neighbors(_seeds(spark, sf), _walk_edges(spark, sf), nodes=nodes, depth=3, direction="in"))


def graph_neighbors_both(spark, sf):
    return _steps_found(graph.neighbors(_seeds(spark, sf), _walk_edges(spark, sf), depth=3, direction="both"))


def graph_paths(spark, sf):
    return _steps_found(graph.paths(_seeds(spark, sf), _walk_edges(spark, sf), depth=2))


def edges_without_nodes(spark, sf):
    return graph.missing_endpoints(_edges(spark, sf), table(spark, sf, "pg_node"))


def atoms_citing(spark, sf):
    """Atoms that cite the symbols of the query set's atoms."""
    atoms = _atoms(spark, sf)
    cited = A.citations(atoms.where(_hundredth("id"))).select(F.concat_ws(":", "file", F.coalesce("fn", F.when(F.col("line").isNotNull(), F.lit(""))), F.col("line").cast("string")).alias("symbol"))
    return A.citing_atoms(cited, atoms)


def atoms_drift(spark, sf):
    """What a change to the files that the query set's atoms cite touches, and how grave it is."""
    atoms = _atoms(spark, sf)
    changed = A.citations(atoms.where(_hundredth("id"))).select(F.col("file").alias("symbol")).unionByName(spark.createDataFrame([("no/such/file.ts",)], "symbol string"))
    return A.drift(changed, atoms)


def atoms_drift_summary(spark, sf):
    return A.drift_summary(atoms_drift(spark, sf))


def atoms_tagged(spark, sf):
    return A.tagged(_atoms(spark, sf)).select("tag", "id", _r6("score").alias("score"))


def atoms_broken_links(spark, sf):
    return A.broken_links(_atoms(spark, sf))


def atoms_backlinks(spark, sf):
    return A.backlinks(_atoms(spark, sf)).select("target", "id", _r6("score").alias("score"))


def atoms_resolved(spark, sf):
    atoms = _atoms(spark, sf)
    texts = A.crosslinks(atoms).select(F.col("target").alias("link")).unionByName(atoms.where(_hundredth("id")).select(F.upper("title").alias("link"))).where("link is not null")
    return A.resolve_links(texts, atoms)


def atoms_chains(spark, sf):
    atoms = cut(_atoms(spark, sf).select("id", "status", "crosslinks"))
    return A.verify_chains(atoms.where(_hundredth("id")).select("id"), atoms)


# ---- text structure and ingestion


def markdown_sections(spark, sf):
    """Sections per document and heading depth."""
    rows = chunk_markdown(table(spark, sf, "documents"), ["doc_id"], "text", most=1_000_000, overlap=0, front=False)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max(F.size(F.filter(F.split("heading_path", " > "), lambda h: h != ""))).alias("deepest"))


def markdown_chunks(spark, sf):
    rows = chunk_markdown(table(spark, sf, "documents"), ["doc_id"], "text", most=128, overlap=32)
    return rows.select("doc_id", "chunk_no", "heading_path", "n_tokens", ingest.chunk_id(F.col("doc_id"), F.col("chunk_no"), F.col("chunk")).alias("chunk_id"))


def index_skips(spark, sf):
    rows = ingest.index_rows(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("path", "id", "skip")


def index_rebuilt(spark, sf):
    return ingest.reindex(table(spark, sf, "documents"), "doc_id", "text").select("id", "path", "phase", "type")


def manifest_diff(spark, sf):
    """What changed in the vector rows between two moments, of every row there is at either, by change."""
    log = table(spark, sf, "pgvector")
    state = lambda at: ingest.states_at(log, "id", "text", "created_at", F.lit(at).cast("timestamp"))
    return ingest.hash_diff(state("2025-01-01 00:00:00"), state("2026-12-31 00:00:00"), "id").groupBy("change").agg(F.count("*").alias("n"))


def chunks_refreshed(spark, sf):
    """The chunks of all documents with vectors after a change: every seventh document changed, every eleventh gone, every thirteenth new."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = docs.where("doc_id % 13 <> 0")
    after = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n\nOne line more."))).otherwise(F.col("text")))
    old = chunk_markdown(before, ["doc_id"], "text").withColumn("vector", V.hash_embedding(F.col("chunk"), 16))
    stored = before.select("doc_id", ingest.content_hash(F.col("text")).alias("hash"))
    made, _ = ingest.embed_changed(old, after, stored, "doc_id", "text", models.embedder(dim=16))
    return made.select("doc_id", "chunk_no", F.md5("chunk").alias("digest"), _r6(F.col("vector")[0]).alias("v0"))


# ---- sessions and ledgers


def _steps(spark, sf) -> DataFrame:
    return sessions.trace_steps(table(spark, sf, "documents"), "session_id", "created_at", "doc_id", "text")


def session_stats(spark, sf):
    return sessions.session_stats(_steps(spark, sf))


def session_topics(spark, sf):
    return sessions.topics(_steps(spark, sf))


def session_proposals(spark, sf):
    return sessions.proposals(_steps(spark, sf), keep=0.2).withColumn("score", _r6("score"))


def session_summaries(spark, sf):
    return sessions.summaries(_steps(spark, sf)).select("session_id", F.md5("summary").alias("digest"), "tags")


def session_last_steps(spark, sf):
    """The last ten steps of each session, each as one line."""
    rows = sessions.recent_steps(_steps(spark, sf), 10)
    return rows.select("session_id", "n", "doc", "line", F.md5(T.one_line_turn(F.col("kind"), F.col("content"))).alias("digest"))


def sessions_reflected(spark, sf):
    """The sessions due for consolidation, at lower limits, with a digest of their summaries."""
    episodes, _ = api.reflect(_steps(spark, sf), min_messages=4, min_minutes=1)
    return episodes.select("session_id", "n_user", "n_agent", "n_tool", "minutes", F.md5("summary").alias("digest"))


def session_cascade(spark, sf):
    docs = table(spark, sf, "documents").withColumn("at", F.coalesce(F.unix_micros("created_at"), F.lit(0).cast("long"))).withColumn("size", F.length("text"))
    return sessions.cascade(docs, ["session_id"], "at", ["doc_id"], 5, ["size"])


def strongest_titles(spark, sf):
    atoms = _atoms(spark, sf).withColumn("key", F.lower("title"))
    return sessions.keep_strongest(atoms.where("indexed_at is not null"), "key", "phase", F.unix_micros("indexed_at"), ["id"])


def usage_by_type(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = ledger.usage_totals(events, ["event_type"], {"k": F.col("k"), "value": F.round("value", 2).cast("decimal(18,2)")})
    return rows.select(F.coalesce("event_type", F.lit("")).alias("event_type"), "grand", "calls", "k", F.col("value").cast("double").alias("value"))


def value_percentiles(spark, sf):
    events = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return ledger.nearest_rank(events, ["event_type"], "cents", [50, 90, 95, 99])


def events_daily(spark, sf):
    return ledger.daily(table(spark, sf, "events"), "ts", ["event_type"], {"cents": F.round(F.col("value") * 100).cast("long")})


def status_zero_filled(spark, sf):
    rows = _atoms(spark, sf).select(T.normalise_status(F.col("status")).alias("status"))
    return ledger.zero_filled(rows, "status", ["raw", "draft", "stable", "deprecated", "invalid"])


def value_histogram(spark, sf):
    return ledger.histogram(table(spark, sf, "events"), "value", 5.0)


QUERIES = {
    f.__name__: f
    for f in (
        atoms_current, atoms_filtered, atoms_substring, atoms_by_lookup, metadata_filtered, namespace_counts, edges_as_of, edges_open,
        docs_snippets, text_statistics, redacted, text_helpers, model_answers, front_matter_fields, knn_topk, knn_namespaced, vector_scores, hash_embeddings,
        recall_fused, recall_reranked, recall_episodic, bm25_scores, token_savings, recall_metrics, retain_conflicts, retain_pointers, docs_as_of, docs_open,
        edge_supersede, edge_supersede_mixed, edge_first_closure,
        edge_patches, nodes_folded, graph_neighbors, graph_neighbors_in, graph_neighbors_both, graph_paths, edges_without_nodes, atoms_citing, atoms_drift, atoms_drift_summary,
        atoms_tagged, atoms_broken_links, atoms_backlinks, atoms_resolved, atoms_chains, markdown_sections, markdown_chunks, index_skips, index_rebuilt, manifest_diff, chunks_refreshed,
        session_stats, session_topics, session_proposals, session_summaries, session_last_steps, sessions_reflected, session_cascade, strongest_titles, usage_by_type,
        value_percentiles, events_daily, status_zero_filled, value_histogram,
    )
}
