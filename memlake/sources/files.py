"""Scans and sinks over files: JSON lines, documents, markdown trees, traces, event logs, manifests.

Parsing failures of strict readers surface when the data is read. Missing paths are empty tables
wherever a docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.functions.text import basename, body, front_fields, truncate
from memlake.operators.atoms import keep_first
from memlake.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at the path (or glob) in whatever file system it names?"""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, a malformed one fails the read."""
    if missing_ok and not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, safe: bool = False) -> DataFrame:
    """A JSON document per file. ``safe``: a missing or malformed one gives no row."""
    if safe and not exists(spark, path):
        return empty(spark, schema)
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED" if safe else "FAILFAST")
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = True, by: list[str] | None = None) -> None:
    """Rows as JSON lines, appended or in place of what was there, in folders by ``by``."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_markdown(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None, skip_folder: str = "00_index") -> DataFrame:
    """All ``*.md`` under a folder, without ``skip_folder``: ``path`` (below the root), ``text``, ``modified``.

    ``include`` and ``exclude`` are patterns on the path. Whole files are read, one row each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = F.regexp_replace(F.col("path"), "^file:/+", "/")
    prefix = "/" + root.replace("file:", "").strip("/") + "/"
    rows = files.select(base.alias("full"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    rows = rows.withColumn("path", F.when(F.col("full").startswith(prefix), F.expr(f"substring(full, {len(prefix) + 1})")).otherwise(F.col("full"))).drop("full")
    rows = rows.where(~F.col("path").rlike(rf"(^|/){skip_folder}/"))
    if include:
        rows = rows.where(F.col("path").rlike(include))
    return rows.where(~F.col("path").rlike(exclude)) if exclude else rows


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files with their front matter as a map and the text behind it: ``path, fields, body``."""
    rows = read_markdown(spark, root)
    return rows.select("path", front_fields(F.col("text")).alias("fields"), body(F.col("text")).alias("body"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The atom index: rows without id dropped, of equal ids the first in file and line order; a missing file is an empty index."""
    if not exists(spark, path):
        return empty(spark, schemas.ATOM)
    rows = read_jsonl(spark, path, schemas.ATOM).select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__o"))
    # file, block and, within a block, the order in which one task reads it: the order of lines
    return keep_first(rows, "id", F.col("__f"), F.col("__b"), F.col("__o")).drop("__f", "__b", "__o")


def read_traces(spark: SparkSession, root: str, session_id: str | None = None) -> DataFrame:
    """Trace steps from a folder of JSON lines; a missing folder or session has none."""
    rows = read_jsonl(spark, root, schemas.TRACE, missing_ok=True)
    return rows.where(F.col("session_id") == session_id) if session_id else rows


def replay_edges(log: DataFrame) -> DataFrame:
    """Current edges of an event log: the last event of each id counts; a retraction only sets the end of one still open."""
    put = log.where("kind = 'edge'").groupBy("id").agg(F.max_by(F.struct("from_node", "to_node", "rel", "props", "valid_from", "valid_to", "recorded_at", "superseded_by"), "seq").alias("e"), F.max("seq").alias("at"))
    put = put.select("id", "at", "e.*")
    gone = log.where("kind = 'edge_retract'").select("id", F.col("seq").alias("s"), F.col("valid_to").alias("end"))
    first = gone.join(put.select("id", "at"), "id").where("s > at").groupBy("id").agg(F.min_by("end", "s").alias("end"))
    return put.join(first, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "end")).drop("end", "at")


def import_call_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an exported call graph, stamped with its time and revision."""
    export = read_json(spark, path, schemas.CALL_GRAPH)
    stamp = ["synced_at", "codebase_sha"]
    nodes = export.select(*stamp, F.explode("nodes").alias("n")).select("n.*", *stamp)
    edges = export.select(*stamp, F.explode("edges").alias("e")).select(F.col("e.from").alias("from_node"), F.col("e.to").alias("to_node"), F.col("e.rel").alias("rel"), *stamp)
    return nodes, edges


def new_vectors(rows: DataFrame, existing: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Vector rows ready to append: id, source, chunk id and time filled in; ids that exist already left out, repeated ones once."""
    stamp = now if now is not None else F.current_timestamp()
    out = rows.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumn("source", F.coalesce("source", "path", F.lit("inline")))
    out = out.withColumns({"chunk_id": F.coalesce("chunk_id", "id"), "created_at": F.coalesce("created_at", stamp)}).dropDuplicates(["id"])
    return out if existing is None else out.join(existing.select("id"), "id", "left_anti")


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit events for an append partitioned by UTC day: queries cut to 200 characters."""
    return events.withColumn("query", truncate(F.col("query"), 200)).withColumn("day", F.date_format("t", "yyyy-MM-dd"))


def manifest(docs: DataFrame, model: str, dimension: int, version: str = "1.0.0") -> DataFrame:
    """One manifest row per store, derived from its rows."""
    counts = docs.groupBy("store").agg(F.count("*").alias("doc_count"), F.max("created_at").alias("last_updated"))
    return counts.select("store", F.lit(model).alias("embedder_model"), F.lit(dimension).alias("dimension"), "doc_count", "last_updated", F.lit(version).alias("schema_version"))


def compatibility(stored: Column, current: str) -> Column:
    """How a stored version relates to the running one: ``missing``, ``invalid``, ``same``, ``older``, ``newer`` or ``major``."""
    form = r"^(\d+)\.(\d+)\.(\d+)$"
    part = lambda i: F.regexp_extract(stored, form, i).try_cast("int")
    major, minor, patch = map(int, current.split("."))
    now, then = F.struct(F.lit(minor).alias("a"), F.lit(patch).alias("b")), F.struct(part(2).alias("a"), part(3).alias("b"))
    return (
        F.when(stored.isNull(), "missing").when(~stored.rlike(form), "invalid").when(part(1) != major, "major")
        .when(then == now, "same").when(then < now, "older").otherwise("newer")
    )


# Keys of search results, the first present counts.
HIT_LISTS = ("results", "hits", "items", "matches", "notes")
HIT_PATHS = ("path", "filename", "file")
HIT_TITLES = ("title", "name")
HIT_SNIPPETS = ("snippet", "context", "preview")
HIT_SCORES = ("score", "relevance")


def normalise_hits(results: DataFrame, payload: str, limit: int = 2**31 - 1) -> DataFrame:
    """Search results in any of the usual shapes as ``query_id, rank, path, title, snippet, score``, the first ``limit`` entries of each.

    ``payload`` is JSON: a list, or an object with the list under one of HIT_LISTS; items are strings (paths) or objects.
    A missing title is the path's last part, a missing score 1 / rank, a missing snippet empty; entries without a path
    are dropped. Anything else gives no rows.
    """
    listed = lambda x: F.when(F.ltrim(x).startswith("["), x)
    lists = F.coalesce(listed(F.col(payload)), *[listed(F.get_json_object(payload, f"$.{n}")) for n in HIT_LISTS])
    rows = results.select("query_id", F.posexplode(F.from_json(lists, "array<string>")).alias("pos", "item")).where(F.col("pos") < limit)
    plain = ~F.ltrim("item").startswith("{")
    get = lambda *keys: F.when(~plain, F.coalesce(*[F.get_json_object("item", f"$.{k}") for k in keys]))
    path = F.when(plain, F.col("item")).otherwise(get(*HIT_PATHS))
    return rows.where("item is not null").select(
        "query_id", (F.col("pos") + 1).alias("rank"), path.alias("path"), F.coalesce(get(*HIT_TITLES), basename(path)).alias("title"), F.coalesce(get(*HIT_SNIPPETS), F.lit("")).alias("snippet"),
        F.coalesce(*[get(k).try_cast("double") for k in HIT_SCORES], 1.0 / (F.col("pos") + 1)).alias("score"),
    ).where("path is not null and path <> ''")


def read_vectors(spark: SparkSession, path: str, manifest_rows: DataFrame | None = None, model: str | None = None, dimension: int | None = None, version: str = "1.0.0") -> DataFrame:
    """A vector store's rows. With its manifest, stores of another ``model``, ``dimension`` or major version are an error.

    A missing path is an empty store. The check reads the manifest only, one row per store.
    """
    if manifest_rows is not None:
        wrong = manifest_rows.where(
            (F.col("embedder_model") != model if model else F.lit(False)) | (F.col("dimension") != dimension if dimension else F.lit(False))
            | compatibility(F.col("schema_version"), version).isin("major", "newer", "invalid")
        )
        first = wrong.select("store", "embedder_model", "dimension", "schema_version").limit(1).collect()
        if first:
            raise ValueError(f"incompatible store: {first[0].asDict()}")
    return read_jsonl(spark, path, schemas.VECTOR_DOC, missing_ok=True)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, limit: int | None = None, **options: str) -> DataFrame:
    """A database table by JDBC, cut over ``parts`` readers by the numeric column ``key`` between ``low`` and ``high``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in options.items():
        reader = reader.option(name, value)
    if key is not None:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    rows = reader.load()
    return rows if limit is None else rows.limit(limit)


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episode notes: ``path, id, session_id, started_at, ended_at, tags, body`` from front matter; those without an id take the file's name."""
    f = F.col("fields")
    listed = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(f["tags"], F.lit("")), r"[\[\]\"']", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    return read_notes(spark, root).select(
        "path", F.coalesce(f["id"], basename(F.col("path"))).alias("id"), f["session_id"].alias("session_id"), f["started_at"].try_cast("timestamp").alias("started_at"),
        f["ended_at"].try_cast("timestamp").alias("ended_at"), listed.alias("tags"), "body",
    )


def write_new(df: DataFrame, path: str, key: str, existing: DataFrame | None = None) -> None:
    """Appends rows of keys that do not exist; a key that does is an error, and nothing is written."""
    if existing is not None:
        taken = df.join(existing.select(key), key, "left_semi").select(key).limit(1).collect()
        if taken:
            raise FileExistsError(f"{key} {taken[0][0]!r} exists")
    df.write.mode("append").json(path)


def replace_table(df: DataFrame, root: str, name: str) -> str:
    """A whole new version of a table beside the old one; readers follow the pointer file once it is complete. Returns the folder.

    An empty ``df`` clears the table. Use ``current_table`` to read.
    """
    spark = df.sparkSession
    folder = f"{root}/{name}-{spark.sql('select uuid()').first()[0]}"
    df.write.parquet(folder)
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("overwrite").json(f"{root}/{name}.current")
    return folder


def current_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version of a table that the pointer file names."""
    return spark.read.parquet(spark.read.schema("folder string").json(f"{root}/{name}.current").first()[0])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A retrieval corpus as ``id, text``: JSON lines with the usual keys, or plain text cut at blank lines."""
    if path.endswith(".txt"):
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.posexplode(F.split("value", r"\n{2,}")).alias("n", "text")).select(F.concat(F.lit("doc-"), F.col("n").cast("string")).alias("id"), F.trim("text").alias("text")).where("text <> ''")
    rows = spark.read.schema("id string, doc_id string, _id string, text string, content string, body string, contents string").json(path)
    text = F.coalesce("text", "content", "body", "contents")
    return rows.select(F.coalesce("id", "doc_id", "_id", F.concat(F.lit("doc-"), F.sha2(text, 256))).alias("id"), text.alias("text")).where("text is not null")


def read_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark conversations: messages ``conv_id, session_id, n, speaker, text`` and questions ``conv_id, n, question, answer, evidence``."""
    schema = (
        "conversations array<struct<id:string,sessions:array<struct<session_id:string,messages:array<struct<speaker:string,role:string,text:string,content:string>>>>,"
        "qa:array<struct<question:string,answer:string,evidence:array<string>>>>>"
    )
    talks = read_json(spark, path, schema).select(F.explode("conversations").alias("c"))
    said = talks.select(F.col("c.id").alias("conv_id"), F.explode("c.sessions").alias("s")).select("conv_id", "s.session_id", F.posexplode("s.messages").alias("n", "m"))
    said = said.select("conv_id", "session_id", "n", F.coalesce("m.speaker", "m.role").alias("speaker"), F.coalesce("m.text", "m.content").alias("text"))
    asked = talks.select(F.col("c.id").alias("conv_id"), F.posexplode("c.qa").alias("n", "q")).select("conv_id", "n", "q.question", "q.answer", "q.evidence")
    return said, asked
