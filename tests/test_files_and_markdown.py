import json

import pytest
from pyspark.sql import functions as F

from memlake.operators import ingest
from memlake.operators.current import current_rows, current_where
from memlake.operators.markdown import chunk_markdown, estimate, sections
from memlake.sources import files, schemas


def test_sections():
    text = "intro\n# A\ntext a\n### C ##\n\ntext c\n## B\ntext b\n#hash\n# D\n"
    got = list(sections(text))
    assert [(p, c) for p, c, *_ in got] == [([], "intro"), (["A"], "text a"), (["A", "C"], "text c"), (["A", "B"], "text b\n#hash")]
    assert [text[s:e] for _, _, s, e in got][1] == "# A\ntext a\n"


def test_chunks(spark):
    long = "# T\n\n" + "\n\n".join("word " * 20 for _ in range(10))
    rows = [("a", "---\nid: x\n---\n" + long, 1), ("b", "", 1), ("c", None, 1), (None, "plain", 1), ("d", "x " * 2000, 1)]
    out = chunk_markdown(spark.createDataFrame(rows, "k string, t string, chunk_no int"), ["k"], "t", most=80, overlap=30).collect()
    a = [r for r in out if r["k"] == "a"]
    assert len(a) > 3 and all(r["chunk"].startswith("# T\n\n") and r["n_tokens"] <= 80 for r in a) and {r["k"] for r in out} == {"a", None, "d"}
    assert len([r for r in out if r["k"] == "d"]) == 1 and estimate("a b c") == 4
    assert chunk_markdown(spark.createDataFrame([], "k string, t string"), ["k"], "t").count() == 0


def test_refresh_is_idempotent(spark):
    notes = spark.createDataFrame([("a", "new text"), ("b", "same"), ("c", "fresh")], "k string, t string")
    old = spark.createDataFrame([("a", "old text"), ("b", "same"), ("z", "gone")], "k string, t string")
    hashed = lambda d: d.select("k", ingest.content_hash(F.col("t")).alias("hash"))
    diff = ingest.hash_diff(hashed(old), hashed(notes), "k")
    assert {tuple(r) for r in diff.collect()} == {("a", "changed"), ("b", "unchanged"), ("c", "added"), ("z", "deleted")}
    chunks = ingest.refresh_chunks(chunk_markdown(old, ["k"], "t"), notes, diff, "k", "t")
    assert sorted((r["k"], r["chunk"]) for r in chunks.collect()) == [("a", "new text"), ("b", "same"), ("c", "fresh")]


def test_index(spark):
    rows = [("p2", "---\nid: ADR--X\nphase: 2\n---\n"), ("p1", "---\nid: ADR--X\nphase: 3\n---\n"), ("p3", "---\nphase: 1\n---\n"), ("p4", "---\nid: bad\n---\n"), ("p5", "none"), ("p6", "---\nid: ADR--Y\nphase: 9\n---\n"), ("p7", None)]
    df = spark.createDataFrame(rows, "p string, t string")
    assert {r["path"]: r["skip"] for r in ingest.index_rows(df, "p", "t").collect()} == {"p1": None, "p2": None, "p3": "no id", "p4": "bad id", "p5": "no front matter", "p6": "bad phase", "p7": "no front matter"}
    assert [(r["id"], r["path"], r["phase"]) for r in ingest.reindex(df, "p", "t").collect()] == [("ADR--X", "p1", 3)]
    assert ingest.bodies(spark.createDataFrame([("../x", "a"), ("y", "b")], "p string, t string"), "p", "t").count() == 1


def test_jsonl_round_trip_and_failures(spark, tmp_path):
    df = spark.createDataFrame([("s", "user", "hi")], "session_id string, kind string, content string")
    files.write_jsonl(df, str(tmp_path / "t"))
    files.write_jsonl(df, str(tmp_path / "t"))
    assert files.read_traces(spark, str(tmp_path / "t"), "s").count() == 2 and files.read_traces(spark, str(tmp_path / "none")).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"session_id": "a"}\n\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), schemas.TRACE).collect()
    assert files.read_json(spark, str(tmp_path / "no.json"), schemas.NOTE, safe=True).count() == 0


def test_index_file_keeps_first(spark, tmp_path):
    path = tmp_path / "index.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in ({"id": "A", "title": "one"}, {"id": "A", "title": "two"}, {"title": "none"}, {"id": "B", "crosslinks": {"references": ["A"]}})))
    assert {(r["id"], r["title"]) for r in files.read_index(spark, str(path)).collect()} == {("A", "one"), ("B", None)}
    assert files.read_index(spark, str(tmp_path / "missing")).count() == 0


def test_markdown_tree(spark, tmp_path):
    for name, text in (("a.md", "---\nid: X--1\n---\nbody"), ("sub/b.md", "plain"), ("00_index/c.md", "no"), ("d.txt", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r["path"], r["text"][:3]) for r in files.read_markdown(spark, str(tmp_path)).collect()} == {("a.md", "---"), ("sub/b.md", "pla")}
    assert files.read_markdown(spark, str(tmp_path), include="^sub/", exclude="z").count() == 1
    assert {r["path"]: r["fields"] for r in files.read_notes(spark, str(tmp_path)).collect()} == {"a.md": {"id": "X--1"}, "sub/b.md": {}}


def test_graph_log_and_import(spark, tmp_path):
    cols = "seq long, kind string, id string, from_node string, to_node string, rel string, props string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, superseded_by string"
    from datetime import datetime

    at = lambda d: datetime(2024, 1, d)
    log = [(1, "edge", "e", "a", "b", "r", None, at(1), None, at(1), None), (2, "edge_retract", "e", None, None, None, None, None, at(5), None, None), (3, "edge_retract", "e", None, None, None, None, None, at(9), None, None), (4, "edge", "f", "a", "c", "r", None, at(1), at(2), at(1), None)]
    assert {(r["id"], r["valid_to"]) for r in files.replay_edges(spark.createDataFrame(log, cols)).collect()} == {("e", at(5)), ("f", at(2))}
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"synced_at": "2024-01-01T00:00:00Z", "codebase_sha": "abc", "nodes": [{"id": "n", "labels": ["fn"]}], "edges": [{"from": "n", "to": "m", "rel": "calls"}]}, indent=1))
    nodes, edges = files.import_call_graph(spark, str(path))
    assert nodes.first()["codebase_sha"] == "abc" and edges.first()["to_node"] == "m"


def test_vectors_manifest_versions(spark):
    rows = spark.createDataFrame([("a", None, "p", None, None), (None, None, None, None, None), ("b", "s", None, "c", None)], "id string, source string, path string, chunk_id string, created_at timestamp")
    out = {r["id"]: r for r in files.new_vectors(rows, spark.createDataFrame([("b",)], "id string")).collect()}
    assert out["a"]["source"] == "p" and out["a"]["chunk_id"] == "a" and len(out) == 2 and "b" not in out
    assert files.manifest(out and rows.withColumn("store", F.lit("s")), "m", 4).first()["doc_count"] == 3
    got = spark.createDataFrame([(v,) for v in (None, "x", "1.2.3", "1.1.9", "1.3.0", "2.0.0")], "v string").select(files.compatibility(F.col("v"), "1.2.3").alias("c")).collect()
    assert [r["c"] for r in got] == ["missing", "invalid", "same", "older", "newer", "major"]
    audit = files.audit_rows(spark.createDataFrame([("x" * 300, None)], "query string, t timestamp")).first()
    assert len(audit["query"]) == 200 and audit["day"] is None


def test_normalise_hits(spark):
    rows = [
        ("a", '["x/p1.md", "p2"]'), ("b", '{"hits": [{"file": "f", "filename": "first", "title": "t", "score": 0.4, "context": "c"}, {"path": "d/g.MD", "relevance": 2}]}'),
        ("c", "{}"), ("d", None), ("e", '[{"x": 1}]'), ("f", "[]"), ("g", '{"results": 3, "items": ["i"]}'), ("h", '["1", "2", "3"]'),
    ]
    frame = spark.createDataFrame(rows, "query_id string, payload string")
    out = files.normalise_hits(frame, "payload", 2).collect()
    assert {tuple(r) for r in out} == {
        ("a", 1, "x/p1.md", "p1", "", 1.0), ("a", 2, "p2", "p2", "", 0.5), ("b", 1, "first", "t", "c", 0.4), ("b", 2, "d/g.MD", "g", "", 2.0),
        ("g", 1, "i", "i", "", 1.0), ("h", 1, "1", "1", "", 1.0), ("h", 2, "2", "2", "", 0.5),
    }


def test_current_rows(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("a", None, "n"), (None, 3, "z"), ("b", None, "only")]
    df = spark.createDataFrame(rows, "id string, t int, v string").withColumn("t", F.timestamp_seconds("t"))
    assert {(r["id"], r["v"]) for r in current_rows(df, "id", "t", ["v"]).collect()} == {("a", "y"), ("b", "only")}
    assert {(r["id"], r["v"]) for r in current_where(df, "id", "t", F.col("v") != "only", ["v"]).collect()} == {("a", "y")}
    assert current_where(df, "id", "t", F.col("v") == "x", ["v"]).count() == 0 and current_rows(df.limit(0), "id", "t", ["v"]).count() == 0
