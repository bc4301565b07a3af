import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions import predicates as P
from memlake.functions import vectors as V
from memlake.operators import vector_search
from memlake.operators.vector_search import search


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z")), V.to_text(F.col("a")), V.from_text(F.lit("[1,2.5]")), V.from_text(F.lit("no"))).first()
    assert row[0] == pytest.approx(0.96) and row[1] == 0 and row[2] == pytest.approx([0.6, 0.8]) and row[3] == [0, 0] and row[4] == "[3.0,4.0]" and row[5] == [1, 2.5] and not row[6]
    with pytest.raises(Exception, match="unequal dimension"):
        df.select(V.cosine(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_hash_embedding(spark):
    import hashlib

    got = spark.createDataFrame([(" Hello ",)], "x string").select(V.hash_embedding(F.col("x"), 20).alias("v")).first()["v"]
    raw = b"".join(hashlib.sha256(f"hello::{i}".encode()).digest() for i in range(2))
    want = np.array([int.from_bytes(raw[i * 2 : i * 2 + 2], "big") / 65535 * 2 - 1 for i in range(20)])
    assert got == pytest.approx(want / np.linalg.norm(want))


def test_predicates(spark):
    df = spark.createDataFrame([(1, "t1", None, ["a", "b"], 1, None), (2, None, "u", None, 1, 5), (3, "t2", "u", ["a"], 4, 4)], "id int, tenant_id string, user_id string, tags array<string>, f int, t int")
    ids = lambda c: [r["id"] for r in df.where(c).orderBy("id").collect()]
    assert ids(P.namespace_filter({})) == [1, 2, 3] and ids(P.namespace_filter({"tenant_id": "t1"})) == [1]
    assert ids(P.metadata_filter({"tags": ["a"]})) == [1, 3] and ids(P.metadata_filter({"tags": ["a", "b"], "user_id": None})) == [1]
    assert ids(P.valid_at(F.col("f"), F.col("t"), F.lit(4))) == [1, 2] and ids(P.valid_now(F.col("t"))) == [1]
    assert ids(P.within_namespace({"tenant_id": F.lit(None).cast("string"), "user_id": F.lit("u")}, {"tenant_id": F.col("tenant_id"), "user_id": F.col("user_id")})) == [2, 3]


DOCS = "doc_id string, vector array<float>, tenant_id string, score string"


def brute(queries, docs, k, threshold):
    out = set()
    for q, v, t in queries:
        hits = []
        for d, w, u, _ in docs:
            if v and w and len(v) == len(w) and (t is None or t == u):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                s = round(float(np.dot(v, w) / n), 12) if n else 0.0
                if s >= threshold:
                    hits.append((-s, d))
        hits.sort()
        out |= {(q, d, round(-s, 9)) for s, d in (hits if k is None else hits[:k])}
    return out


@pytest.mark.parametrize("k,most", [(3, 8192), (None, 8192), (3, 7)])
def test_search(spark, monkeypatch, k, most):
    monkeypatch.setattr(vector_search, "MAX_QUERIES", most)
    rng = np.random.default_rng(1)
    vec = lambda d: [float(np.float32(x)) for x in rng.normal(size=d)]
    docs = [(f"d{i:03}", vec(6), ["a", "b", None][i % 3], "x") for i in range(150)]
    docs += [(f"s{i:03}", docs[0][1], "a", "x") for i in range(20)] + [("none", None, "a", "x"), ("zero", [0.0] * 6, "a", "x"), ("short", vec(3), "a", "x"), ("empty", [], "a", "x")]
    queries = [(f"q{i:02}", vec(6), ["a", None][i % 2]) for i in range(18)] + [("same", docs[0][1], "a"), ("dim", vec(3), None), ("null", None, None), ("odd", vec(5), None)]
    got = search(spark.createDataFrame(queries, "query_id string, vector array<double>, tenant_id string"), spark.createDataFrame(docs, DOCS).repartition(3), k=k, threshold=0.1, namespace=["tenant_id"]).collect()
    assert {(r["query_id"], r["doc_id"], round(r["score"], 9)) for r in got} == brute(queries, docs, k, 0.1)


def test_search_empty(spark):
    q, d = spark.createDataFrame([], "query_id string, vector array<double>"), spark.createDataFrame([], "doc_id string, vector array<float>")
    assert search(q, d).count() == 0
    assert search(q.sparkSession.createDataFrame([("q", [1.0])], q.schema), d).count() == 0
