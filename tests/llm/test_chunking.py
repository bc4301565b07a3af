import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm.chunking import cut_level, split_items, split_text

BITS = st.sampled_from(["word ", "A sentence ends. ", "line\n", "para\n\n", "\r\n\r\n", "ไทยไทย", "漢字。", "é", "\U0001f469‍\U0001f4bb", "x" * 37, "\t", "\n \t\n", " "])


@settings(max_examples=200, deadline=None)
@given(st.lists(BITS, max_size=60).map("".join), st.integers(12, 60), st.integers(0, 11))
def test_pieces_cover_the_text_and_keep_the_limits(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[cut:end] for _, cut, end, _ in pieces) == text
    for start, cut, end, _ in pieces:
        assert end - start <= limit and 0 <= cut - start <= overlap and (end > cut or not text)
    assert len(pieces) <= 1 or pieces[0][0] == 0


def test_natural_boundaries_win():
    text = "\n\n".join("Paragraph %d has some words. And a second sentence." % i for i in range(40))
    pieces = split_text(text, 300, 30)
    assert all(b in ("paragraph", "end") for *_, b in pieces)
    lengths = [end - cut for _, cut, end, _ in pieces]
    assert max(lengths) - min(lengths) < 110
    words = split_text("word " * 500, 200, 20)
    assert all(b in ("word", "end") for *_, b in words) and all(not s or (("word " * 500)[s - 1] == " ") for s, *_ in words)
    hard = split_text("x" * 1000, 200, 20)
    assert {b for *_, b in hard} == {"none", "end"} and len(hard) == 6


@pytest.mark.parametrize("text,level", [
    ("a" * 9 + "\n\n" + "b" * 9, "paragraph"), ("a" * 9 + "\n \t\r\n" + "b" * 9, "paragraph"), ("a" * 9 + "\n" + "b" * 9, "line"),
    ("a" * 9 + " " + "b" * 9, "word"), ("a" * 9 + " " + "b" * 9, "word"), ("a" * 19, "none"), ("", "paragraph"),
])
def test_levels(text, level):
    assert cut_level(text, 10) == level


def test_table(spark):
    long = "Some words here. " * 3000
    rows = [("a", "p", long, "t"), ("b", None, "short", "t"), ("c", "q", "", "t"), ("d", "r", None, "t"), (None, "s", "x y " * 900, "t"), ("a", "p", long, "t")]
    df = spark.createDataFrame(rows, "id string, chunk_id string, text string, piece string")
    out = split_items(df, ["id", "chunk_id"], "text").collect()
    by = {}
    for r in out:
        by.setdefault((r["id"], r["chunk_id"]), []).append(r)
    assert ("d", "r") not in by and [r["piece"] for r in by["c", "q"]] == [""] and [r["piece"] for r in by["b", None]] == ["short"]
    pieces = sorted(by["a", "p"], key=lambda r: r["piece_no"])
    assert "".join(r["piece"][r["n_overlap"]:] for r in pieces[::2]) == long
    assert split_items(df.limit(0), ["id"], "text").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=4, max_size=40))
def test_every_cut_is_at_a_paragraph_where_paragraphs_fit(lengths):
    text = "\n\n".join("word. "[: n % 6 or 6] * (n // 6) + "x" for n in lengths)
    assert cut_level(text, 60) == "paragraph"
    assert {b for *_, b in split_text(text, 60, 8)} <= {"paragraph", "end"}


@pytest.mark.parametrize("text", ["".join(w + (". " if i % 9 == 0 else " ") for i, w in enumerate(["word", "sentence", "thing"] * 27_000)), ("x" * 1500 + " ") * 660, "y" * 1_000_000])
def test_a_long_text_takes_linear_time(text):
    began = time.perf_counter()
    pieces = split_text(text)
    assert time.perf_counter() - began < 1.5
    assert len(pieces) <= 1.25 * (1 + -(-(len(text) - 2000) // 1800))
