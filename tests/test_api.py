import random

import pytest
from pyspark.sql import functions as F

from memlake import api
from memlake.functions import models
from memlake.functions import text as T
from memlake.operators import atoms, ingest, ledger, sessions
from memlake.operators.markdown import chunk_markdown, windows
from memlake.sources import files

ROW = "id string, seq long, text string, vector array<double>, tenant_id string, status string, valid_from timestamp, valid_to timestamp, superseded_by string, supersedes string"
FACT = ROW.replace(", supersedes string", ", policy string, inbound_type string, supersedes string")


def at(n):
    return f"2024-01-01 00:{n // 60:02}:{n % 60:02}"


def facts(spark, rows):
    """(id, seq, text, vector, tenant, status, policy, inbound)"""
    made = [(i, s, t, v, n, st, None, None, p, b) for i, s, t, v, n, st, p, b in rows]
    frame = spark.createDataFrame([(i, s, t, v, n, st, None, p, b, at(s)) for i, s, t, v, n, st, _, _, p, b in made], "id string, seq long, text string, vector array<double>, tenant_id string, status string, x string, policy string, inbound_type string, at string")
    none = F.lit(None)
    return frame.select("id", "seq", "text", "vector", "tenant_id", "status", F.to_timestamp("at").alias("valid_from"), none.cast("timestamp").alias("valid_to"), none.cast("string").alias("superseded_by"), "policy", "inbound_type")


def test_retain_replays_one_by_one(spark):
    rng = random.Random(3)
    angle = lambda: rng.choice([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [-1.0, 0.2]])
    rows = [(f"r{i:02}", i, rng.choice(["a", "b ", " b", "c"]), angle() if rng.random() < 0.95 else None, rng.choice(["x", "y", None]), rng.choice([None, "invalid", "stable"]), rng.choice(["coexist", "auto", None]), rng.choice([None, "fact"])) for i in range(40)]
    table = facts(spark, rows)
    stored, new = table.where("seq < 15").drop("policy", "inbound_type"), table.where("seq >= 15")
    made = api.retain(stored, new, 0.9, ["tenant_id"])
    cos = lambda a, b: sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) ** 0.5 * sum(q * q for q in b) ** 0.5)
    shut, points = {}, {}
    for n, (i, s, t, v, ns, _, policy, _) in enumerate(rows):
        if s < 15 or v is None:
            continue
        hit = [(-cos(v, w), j) for j, _, u, w, ms, st, _, _ in rows[:n] if w and st != "invalid" and j not in shut and cos(v, w) >= 0.9 and u.strip() != t.strip() and ns in (None, ms)]
        if hit and policy != "coexist":
            shut |= {j: i for _, j in hit}
            points[i] = {j for c, j in hit if abs(c - min(hit)[0]) < 1e-9}
    got = {r["doc_id"]: r["superseded_by"] for r in made.closures.collect()}
    assert got == shut and len(shut) > 5
    back = {r["id"]: r["supersedes"] for r in made.facts.collect()}
    assert {i for i, s in back.items() if s} == set(points) and all(back[i] in points[i] for i in points) and len(back) == 25
    after = {r["id"]: r for r in made.table(stored).collect()}
    assert len(after) == 40 and {i: r["superseded_by"] for i, r in after.items() if r["superseded_by"]} == shut
    assert all(str(after[j]["valid_to"]) == at(int(i[1:])) for j, i in shut.items())
    assert made.proposals.count() == sum(r[1] >= 15 and r[7] is not None for r in rows)
    assert api.retain(stored, new.limit(0), 0.9).closures.count() == 0 and api.retain(stored.limit(0), new, 0.9, ["tenant_id"]).facts.count() == 25


def test_recall_sources_time_and_namespace(spark):
    docs = spark.createDataFrame(
        [("v1", "vector", [1.0, 0.0], "red fox", "p1", None, "t", "2024-01-01", "2024-06-01"), ("v2", "vector", [0.9, 0.1], "blue fox", "p2", "stable", "t", "2024-03-01", None), ("e1", "episodic", [1.0, 0.1], "fox", None, "invalid", "u", "2024-01-01", None)],
        "id string, store string, vector array<double>, text string, source string, status string, tenant_id string, f string, e string",
    ).select("*", F.to_timestamp("f").alias("valid_from"), F.to_timestamp("e").alias("valid_to"))
    queries = spark.createDataFrame([("q", "ATOM--A", [1.0, 0.0], None), ("w", "red fox", [1.0, 0.0], "t"), ("n", "x", None, None)], "query_id string, query string, vector array<double>, tenant_id string")
    index = spark.createDataFrame([("ATOM--A", "a.md", "stable", "The atom")], "id string, path string, status string, title string")
    notes = spark.createDataFrame([("w", 1, "n.md", "n", "", 0.7), ("zz", 1, "m", "m", "", 1.0)], "query_id string, rank int, path string, title string, snippet string, score double")
    ids = lambda q="q", **o: [r["doc_id"] for r in api.recall(queries, docs, **o).where(F.col("query_id") == q).orderBy("rank").collect()]
    assert ids(atoms=index, notes=notes) == ["ATOM--A", "v2", "v1", "e1"] and ids(strategy="episodic") == ["e1"] and ids(strategy="vector") == ["v2", "v1"]
    assert ids("w", namespace=["tenant_id"], notes=notes) == ["v2", "v1", "n.md"] and ids("w", strategy="notes", notes=notes) == ["n.md"]
    assert ids(include_superseded=False) == ["v2"] and ids(as_of=F.to_timestamp(F.lit("2024-02-01"))) == ["v1", "e1"]
    assert ids("n") == [] and ids(strategy="atomic") == [] and len(ids(cap=1)) == 1
    assert ids("w", namespace=["tenant_id"], rerank=True) == ["v1", "v2"]
    broken = models.scorer(lambda q, s: [1.0])
    assert ids("w", namespace=["tenant_id"], rerank=True, scorer=broken) == ["v2", "v1"]
    assert ids("w", namespace=["tenant_id"], rerank=True, scorer=models.scorer(lambda q, s: [float("red" in x) for x in s])) == ["v1", "v2"]


def test_stamp(spark):
    df = spark.createDataFrame([("a", "old")], "id string, tenant_id string")
    assert api.stamped(df, {"tenant_id": None, "user_id": "u"}).select("tenant_id", "user_id", "agent_id").first() == ("old", "u", None)
    assert api.stamped(df, {"tenant_id": "new"}).first()["tenant_id"] == "new"


def test_reflect(spark):
    text = "\n".join(f"{'user' if i % 2 == 0 else 'agent'}: The Parser works, the Parser again {i}" for i in range(12))
    docs = spark.createDataFrame([("s", "2024-01-01 10:00:00", 1, text), ("s", "2024-01-01 12:00:00", 2, "user: Parser\nwrong: x\nagent: [USER] bye"), (None, "2024-01-01", 3, "user: hi"), ("e", None, 4, "")], "sid string, at string, doc int, text string")
    steps = sessions.trace_steps(docs.withColumn("at", F.to_timestamp("at")), "sid", "at", "doc", "text")
    episodes, proposals = api.reflect(steps, min_messages=5)
    assert [(r["session_id"], r["n_user"], r["minutes"]) for r in episodes.collect()] == [("s", 7, 120.0)] and [r["title"] for r in proposals.collect()] == ["Parser"]
    every = api.reflect(steps, force=True)[0]
    assert {r["session_id"] for r in every.collect()} == {"s", None}
    good = api.reflect(steps, force=True, complete=lambda p: ['{"summary": "' + str(len(x.splitlines())) + ' lines"}' for x in p])[0]
    assert {r["session_id"]: r["summary"] for r in good.collect()} == {"s": "14 lines", None: "1 lines"}
    bad = api.reflect(steps, force=True, complete=lambda p: 1 / 0)[0]
    assert all(r["summary"].startswith("Session") for r in bad.collect())
    assert [r["content"] for r in sessions.recent_steps(steps, 1).where("session_id = 's'").collect()] == ["[USER] bye"]
    assert api.reflect(steps.limit(0), force=True)[0].count() == 0


@pytest.mark.parametrize("text,found", [
    ('{"a": 1}', '{"a": 1}'), ("so:\n```json\n{\"a\": {\"b\": 2}}\n``` bye", '{"a": {"b": 2}}'), ('x {"a": "}{"} y {', '{"a": "}{"}'), ('x {"a": "\\"}"} z', '{"a": "\\"}"}'), ("none", None), ("{ open", "{ open"), ("a { open", None), ("", None),
])
def test_json_object(text, found):
    assert models.json_object(text) == found


def test_embedder_and_answers(spark):
    df = spark.createDataFrame([("ab",), (None,), ("c",)], "t string")
    made = [r["v"] for r in df.select(models.embedder(lambda texts: [[len(t), 0.0] for t in texts])(F.col("t")).alias("v")).collect()]
    assert made == [[1.0, 0.0], None, [1.0, 0.0]]
    raw = ['{"summary": "s", "proposals": [{"proposed_id": "bad", "title": "t", "body": "b"}, {"proposed_id": "FACT--X", "title": "t", "body": "b", "phase": 2, "confidence": -1}, null]}', '{"summary": ""}', "[1]", None, '{"summary": "s", "tags": "x"}']
    got = [r["a"] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(models.parsed_answer(F.col("r")).alias("a")).collect()]
    assert [(p["proposed_id"], p["phase"], p["type"], p["confidence"]) for p in got[0]["proposals"]] == [("FACT--X", 2, "insight", 0.0)] and got[0]["emotion"] == "neutral"
    assert got[1:4] == [None, None, None]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  \nsecond", "a/b/Note.MD"), ("# Über die Straße!\r\nx", "plain"), (None, None)], "t string, p string")
    got = df.select(T.derive_title(F.col("t")), T.proposed_id(F.lit(None).cast("string"), F.col("t")), T.basename(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Untitled", "FACT--UNTITLED", "Note"), ("# Über die Straße!", "FACT--BER-DIE-STRASSE", "plain"), (None, None, None)]
    one = spark.createDataFrame([("x\r\n \t[Agent] do\n\ny",)], "t string").select(T.one_line_turn(F.lit("user"), F.col("t")), T.extract_context(F.col("t"), F.lit("AGENT"), 6), T.score_overlap(F.col("t"), F.lit("agent do nothing")))
    a, b, c = one.first()
    assert a == "[USER] x [Agent-quoted] do ⏎ y" and b == "[Age" and c == pytest.approx(2 / 3)


def test_windows_hold_their_budget():
    rng = random.Random(5)
    paragraphs = [" ".join(["w"] * rng.randrange(1, 60)) for _ in range(80)]
    for most, overlap in ((64, 16), (40, 0), (20, 100)):
        made = [w for w, _ in windows(["A"], "\n\n".join(f"{i} {p}" for i, p in enumerate(paragraphs)), most, overlap)]
        parts = [[int(p.split()[0]) for p in w.split("\n\n")[1:]] for w in made]
        assert all(p == list(range(p[0], p[-1] + 1)) for p in parts) and parts[0][0] == 0 and parts[-1][-1] == 79
        for before, after in zip(parts, parts[1:]):
            assert after[-1] > before[-1] and (after[0] <= before[-1] if overlap else after[0] == before[-1] + 1)


def test_re_embedding_equals_embedding_anew(spark):
    texts = {i: f"# H\n\nText {i}." for i in range(8)}
    old = spark.createDataFrame(list(texts.items()), "k int, t string")
    new = spark.createDataFrame([(i, t + " more" if i == 2 else t) for i, t in texts.items() if i != 5] + [(9, "Nine")], "k int, t string")
    embed = models.embedder(dim=4)
    fresh = lambda df: chunk_markdown(df, ["k"], "t").withColumn("vector", embed(F.col("chunk")))
    made, manifest = ingest.embed_changed(fresh(old), new, old.select("k", ingest.content_hash(F.col("t")).alias("hash")), "k", "t", embed)
    want = fresh(new)
    assert sorted(map(str, made.select(want.columns).collect())) == sorted(map(str, want.collect())) and manifest.count() == 8


def test_ledger_and_drift(spark):
    n = spark.createDataFrame([(5,), (7,)], "n int")
    assert ledger.token_savings(n, 3, spark.createDataFrame([(100,)], "n int"), "n").first() == (3, 100, 4.0, 96.0)
    assert ledger.token_savings(n.limit(0), 0, n.limit(0), "n").first()["savings_pct"] == 0.0
    results = spark.createDataFrame([("q", 1, "the red fox"), ("q", 2, "blue")], "query_id string, rank int, text string")
    asked = spark.createDataFrame([("q", "blue", ["red fox"]), ("w", "x", None)], "query_id string, answer string, evidence array<string>")
    assert ledger.answer_metrics(results, asked, 2).first() == (2, 50.0, 50.0, 50.0)
    assert [ledger.clamp_limit(x) for x in (None, 0, 3.7, 10**9, float("nan"))] == [5, 1, 3, 10_000, 5]
    index = spark.createDataFrame([("A--1", "ADR", ["f.ts"]), ("A--2", "fact", ["f.ts", "g.ts"])], "id string, type string, geography array<string>").withColumn("linked_symbols", F.lit(None).cast("array<struct<file:string,fn:string,line:int>>"))
    report = atoms.drift(spark.createDataFrame([("f.ts",), ("g.ts",), ("h.ts",), (None,)], "symbol string"), index)
    assert {tuple(r) for r in report.collect()} == {("f.ts", 2, 0, "HIGH"), ("g.ts", 1, 0, "LOW"), ("h.ts", 0, 0, "NONE")}
    assert {r["risk"]: r["n"] for r in atoms.drift_summary(report).collect()} == {"NONE": 1, "LOW": 1, "MEDIUM": 0, "HIGH": 1}


def test_tables_of_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    files.write_new(df, str(tmp_path / "t"), "id")
    with pytest.raises(FileExistsError):
        files.write_new(df, str(tmp_path / "t"), "id", spark.read.json(str(tmp_path / "t")))
    files.replace_table(df, str(tmp_path / "r"), "m")
    files.replace_table(df.limit(0), str(tmp_path / "r"), "m")
    assert files.current_table(spark, str(tmp_path / "r"), "m").count() == 0
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "text": "x"}\n{"content": "y"}\n{"id": "n"}\n')
    (tmp_path / "c.txt").write_text("one\nmore\n\n\ntwo\n")
    assert sorted(r["text"] for r in files.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()) == ["x", "y"]
    assert [r["text"].strip() for r in files.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("id").collect()] == ["one\nmore", "two"]
    (tmp_path / "talk.json").write_text('{"conversations": [{"id": "c", "sessions": [{"session_id": "s", "messages": [{"role": "user", "content": "hi"}]}], "qa": [{"question": "q", "answer": "a", "evidence": ["e"]}]}]}')
    said, asked = files.read_conversations(spark, str(tmp_path / "talk.json"))
    assert said.first()[:] == ("c", "s", 0, "user", "hi") and asked.first()["evidence"] == ["e"]
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "ep.md").write_text("---\nsession_id: s1\nstarted_at: 2024-01-01T10:00:00Z\ntags: [a, \"b\"]\n---\nBody")
    row = files.read_episodes(spark, str(notes)).first()
    assert (row["id"], row["session_id"], row["tags"], row["body"].strip()) == ("ep", "s1", ["a", "b"], "Body")
    kept = files.manifest(spark.createDataFrame([("s", None)], "store string, created_at timestamp"), "m", 3)
    assert files.read_vectors(spark, str(tmp_path / "none"), kept, "m", 3).count() == 0
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "none"), kept, "m", 4)
