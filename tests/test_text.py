import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,want", [
    ("Hello, World!", "hello world"), ("a b　c", "a b c"), ("\U0001f600x", "x"), ("", ""), (None, None), ("ÄÖ-ü 9", "äö ü 9"),
])
def test_normalize(spark, value, want):
    assert one(spark, value, T.normalize_text) == want


def test_tokenize(spark):
    assert one(spark, "I saw a BIG cat, a cat", T.tokenize) == ["saw", "big", "cat", "cat"]
    assert one(spark, "", T.tokenize) == [] and one(spark, None, T.tokenize) is None


@pytest.mark.parametrize("h,n,want", [("The quick brown fox", "QUICK, brown", True), ("alpha beta gamma", "gamma beta alpha delta", True), ("alpha", "omega", False), ("x", "", False), ("", "word", False)])
def test_contains_snippet(spark, h, n, want):
    df = spark.createDataFrame([(h, n)], "h string, n string")
    assert df.select(T.contains_snippet(F.col("h"), F.col("n")).alias("y")).first()["y"] is want


def test_truncate(spark):
    assert one(spark, "abcdef", lambda c: T.truncate(c, 4)) == "abc…" and one(spark, "abcd", lambda c: T.truncate(c, 4)) == "abcd"
    assert one(spark, " a \n b ", lambda c: T.truncate(c, 9, squeeze=True)) == "a b"


def test_redact(spark):
    got = one(spark, "Authorization: abcdefgh12 Bearer abcdefghij token=abcdefgh99 sk-ant-abcdefghijklmnop ghp_abcdefghijklmnop xoxb-abcdefghij eyJab.cd.ef", T.redact_secrets)
    for secret in ("abcdefgh12", "abcdefghij ", "abcdefgh99", "abcdefghijklmnop", "eyJab"):
        assert secret not in got
    assert one(spark, "plain words", T.redact_secrets) == "plain words"


def test_estimates(spark):
    assert one(spark, "a b c", T.word_tokens) == 4 and one(spark, None, T.word_tokens) == 0 and one(spark, "abcdefgh", T.char_tokens) == 3


def test_ids(spark):
    assert one(spark, "Big Fish & Co", lambda c: T.atomic_id("INSIGHT", c)) == "INSIGHT--BIG-FISH-CO"
    assert one(spark, "A-very long title", lambda c: T.slugify(c, 7)) == "a-very"
    assert [one(spark, v, T.is_atomic_id) for v in ("ADR--X1", "adr--x", "ADR-X", None)] == [True, False, False, False]
    assert [one(spark, v, T.normalise_status) for v in (" Approved", "ACCEPTED", "Draft", None)] == ["stable", "stable", "draft", None]
    assert one(spark, "src/a.ts:run:12", T.symbol_parts).asDict() == {"file": "src/a.ts", "fn": "run", "line": 12}
    assert one(spark, "src/a.ts::-1", T.symbol_parts).asDict() == {"file": "src/a.ts", "fn": None, "line": None}
    assert one(spark, "a", lambda c: T.stable_id("n", c)) == "n-ca978112ca1bbdca"


def test_links_and_front_matter(spark):
    assert one(spark, "see [[A#x|y]] and [[B]] [[A]] [[ ]]", T.wikilinks) == ["A", "B"]
    note = "---\r\nid: X--1\r\ntype: adr\r\ntype: fact\r\n---\r\nbody"
    assert one(spark, note, T.front_fields) == {"id": "X--1", "type": "fact"} and one(spark, note, T.body) == "body"
    assert one(spark, "no matter", T.front_fields) == {} and one(spark, "no matter", T.body) == "no matter" and one(spark, "a", T.front_matter) is None
    assert one(spark, " First one. Second.", T.first_sentence) == "First one." and one(spark, "none", T.first_sentence) == "none"
    assert one(spark, "a b\nc", lambda c: T.derive_title(c, 1)) == "a"


def test_numbers(spark):
    row = spark.range(1).select(T.half_up(F.lit(1.005)).alias("a"), T.half_up(F.lit(-0.125), 2).alias("b"), T.clamp01(F.lit(float("nan"))).alias("c"), T.clamp01(F.lit(2.0)).alias("d")).first()
    assert tuple(row) == (1.0, -0.12, 0.0, 1.0)
