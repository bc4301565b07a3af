import math

import pytest

from memlake.operators.fusion import fuse, rerank, union_hits
from memlake.operators.lexical import bm25, min_max
from memlake.plans import memory

HITS = "query_id string, query string, doc_id string, path string, source string, status string, snippet string, score double"


def test_bm25(spark):
    texts = {"d1": "apple banana apple", "d2": "banana cherry", "d3": "durian", "d4": "", "d5": None}
    df = spark.createDataFrame([("q", "apple apple cherry", d, t) for d, t in texts.items()] + [("e", "", "d1", "apple"), ("n", None, "d1", "apple")], "q string, query string, doc string, text string")
    got = {(r["q"], r["doc"]): r["s"] for r in bm25(df, "q", "query", "text", "s").collect()}
    docs = {d: (t or "").split() for d, t in texts.items()}
    avg = sum(map(len, docs.values())) / 5

    def score(words):
        s = 0
        for t in ("apple", "apple", "cherry"):
            f, n = words.count(t), sum(t in w for w in docs.values())
            if f:
                s += math.log((5 - n + 0.5) / (n + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(words) / avg))
        return s

    for d, words in docs.items():
        assert got["q", d] == pytest.approx(score(words))
    assert got["e", "d1"] == 0 and got["n", "d1"] == 0
    assert bm25(df.limit(0), "q", "query", "text").count() == 0


def test_min_max(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "q string, s double")
    assert sorted((r["q"], r["m"]) for r in min_max(df, "q", "s", "m").collect()) == [("a", 0.0), ("a", 1.0), ("b", 0.5), ("b", 0.5)]


def hits(spark):
    rows = [
        ("q", "red fox", "c1", "p", "vector", None, "green tree", 0.9), ("q", "red fox", "c2", "p", "vector", None, "red fox", 0.8),
        ("q", "red fox", "e1", None, "episodic", "stable", "the red fox ran", 0.86), ("q", "red fox", "e2", "r", "episodic", "draft", "fox", 0.5),
        ("q", "red fox", "e3", "s", "episodic", None, "fox fox fox red", 0.4), ("x", "tie", "a", None, "vector", None, None, 0.5), ("x", "tie", "b", None, "vector", None, "", 0.5),
    ]
    return spark.createDataFrame(rows, HITS)


def test_fuse_and_rerank(spark):
    fused = fuse(hits(spark), cap=3)
    assert [(r["doc_id"], round(r["score"], 2)) for r in fused.where("query_id = 'q'").orderBy("rank").collect()] == [("e1", 0.91), ("c1", 0.9), ("e2", 0.5)]
    assert [r["doc_id"] for r in fused.where("query_id = 'x'").orderBy("rank").collect()] == ["a", "b"]
    ranked = rerank(fused, limit=2).where("query_id = 'q'").orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 3)) for r in ranked] == [("e1", 0.964), ("c1", 0.36), ("e2", 0.5)]
    assert rerank(fused, limit=2).count() == 5 and rerank(fused.limit(0)).count() == 0


def test_union_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "query_id int, path string")
    assert union_hits(a, a.drop("path")).where("path is null").count() == 1


def test_whole_query_text_is_scored(spark, monkeypatch):
    """Words behind the first 240 characters of the query count; the snippet alone is cut there."""
    near = lambda x: [1.0, x] + [0.0] * 62
    rows = [
        ("q-0000000000", "other", "s0", "filler " * 60 + "zebra zebra", near(0.0)), ("c1", "atomic", "s1", "a zebra here", near(0.2)),
        ("c2", "atomic", "s2", "nothing of it", near(0.1)), ("c3", "episodic", "s3", "nothing " * 40 + "zebra", near(0.3)),
    ]
    rows = [(*r, "t", None, None, 1) for r in rows]
    vectors = spark.createDataFrame(rows, "id string, store string, source string, text string, vector array<float>, tenant_id string, status string, session_id string, tokens int")
    monkeypatch.setattr(memory, "_vectors", lambda *_: vectors)
    scores = {r["doc_id"]: r["bm25"] for r in memory.bm25_scores(spark, "").collect()}
    own = sum(len(w) > 1 for w in ("filler " * 60)[:239].split())  # the row that asks is among the candidates
    words = {"c1": 2, "c2": 3, "c3": 30, "q-0000000000": own}  # words of two letters or more; of long texts what the cut leaves
    want = 2 * math.log((4 - 1 + 0.5) / (1 + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * words["c1"] / (sum(words.values()) / 4)))
    assert scores.pop("q-0000000000") > 100
    assert scores == {"c1": pytest.approx(want, abs=1e-6), "c2": 0.0, "c3": 0.0}
    ranked = {r["doc_id"]: r["rank"] for r in memory.recall_reranked(spark, "").collect()}
    assert ranked == {"q-0000000000": 1, "c1": 2, "c2": 3, "c3": 4}
