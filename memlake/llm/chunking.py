"""Splitting oversized texts at natural boundaries by balanced targets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Boundary kinds, the stronger the higher.
NONE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
NAMES = ("none", "word", "sentence", "line", "paragraph")

_PARAGRAPH = re.compile(r"\n(?:[ \t\r]*\n)+")
_SENTENCE = re.compile(r"""[.!?…]+["'”’»)\]]*\s+|[。！？]+["'”’」』)\]]*\s*""")
_SPACE = re.compile(r"\s+")
_JOINERS = "‍︎️"


def cut_level(text: str, limit: int) -> str:
    """The strongest kind of boundary that alone keeps every stretch within ``limit`` code points."""
    if max(map(len, _PARAGRAPH.split(text))) <= limit:
        return "paragraph"
    if max(map(len, text.split("\n"))) <= limit:
        return "line"
    if max(map(len, text.split()), default=0) <= limit:
        return "word"
    return "none"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places between which ``text`` may be cut, in order, with their strength. A cut lies behind the white space."""
    kind: dict[int, int] = {}
    for m in _SPACE.finditer(text):
        kind[m.end()] = LINE if "\n" in m.group() else WORD
    for m in _SENTENCE.finditer(text):
        kind[m.end()] = max(kind.get(m.end(), 0), SENTENCE)
    for m in _PARAGRAPH.finditer(text):
        end = _SPACE.match(text, m.end())
        kind[end.end() if end else m.end()] = PARAGRAPH
    kind.pop(len(text), None)
    places = sorted(kind)
    return places, [kind[p] for p in places]


def _whole(text: str, at: int, least: int) -> int:
    """``at`` moved left, not below ``least``, so that no combined character is cut."""
    to = at
    while to > least and to < len(text) and (unicodedata.combining(text[to]) or text[to] in _JOINERS or text[to - 1] == "‍"):
        to -= 1
    return to if to > least else at


def _cuts(text: str, limit: int, fresh: int, places: list[int], kinds: list[int], wanted: int) -> list[int]:
    """Cuts at balanced targets, from the start to the end, each looked for within reach of the one before.

    The rest of the text behind a cut is divided into the smallest number of pieces of ``fresh`` new
    characters (the first: ``limit``), with targets at equal distances. A cut goes to the strongest
    boundary near its target; where the rest could not be held by the pieces left from any boundary of the
    ``wanted`` kind, a piece is added, and where there is none within reach, up to ``limit`` new
    characters, at the cost of the overlap. Weaker boundaries follow in the same order; where there
    is no boundary at all the cut is at the target.
    """
    size, cuts, last = len(text), [], 0
    while size - last > (fresh if cuts else limit):
        most = fresh if cuts else limit
        rest = size - last
        pieces = 1 + -(-(rest - most) // fresh)
        soft, hard = min(last + most, size - 1), min(last + limit, size - 1)
        # from here on the rest fits the pieces left
        fits = max(size - (pieces - 1) * fresh, last + 1)
        target, slack = last + rest / pieces, rest / pieces / 3

        def strongest(a: float, b: float, kind: int, target: float = target, slack: float = slack) -> int | None:
            lo, hi = bisect_left(places, a), bisect_right(places, b)
            return max((j for j in range(lo, hi) if kinds[j] >= kind), key=lambda j: (kinds[j] - abs(places[j] - target) / (2 * slack), -places[j]), default=None)

        best = None
        for kind in dict.fromkeys((wanted, WORD)):
            more = last + rest / (pieces + 1)
            tries = ((max(fits, target - slack), min(soft, target + slack)), (fits, soft), (max(last + 1, more - slack), soft, more), (last + 1, soft, more), (soft + 1, hard))
            for low, high, *at in tries:
                best = strongest(low, high, kind, *at)
                if best is not None:
                    break
            if best is not None:
                break
        last = places[best] if best is not None else _whole(text, int(min(max(target, fits), soft)), fits)
        cuts.append(last)
    return cuts


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """Pieces ``(start, cut, end, boundary)``: ``text[start:end]`` of which ``text[cut:end]`` is new.

    Targets lie at equal distances for the smallest number of pieces, each snapped to the
    strongest boundary nearby; a piece is added whenever a limit fails. Time is linear in the text.
    The new parts of all pieces joined give the text; a piece never exceeds ``limit``,
    and repeats at most ``overlap`` characters of the piece before, from a word's start where there is one.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    size, fresh = len(text), limit - overlap
    if size <= limit:
        return [(0, 0, size, "end")]
    places, kinds = boundaries(text)
    wanted = {"paragraph": PARAGRAPH, "line": LINE}.get(cut_level(text, limit), WORD)
    cuts = _cuts(text, limit, fresh, places, kinds, wanted)
    strength = dict(zip(places, kinds))
    out, before = [], 0
    for cut, end in zip([0, *cuts], [*cuts, size]):
        start = cut
        if cut:
            start = max(before, cut - overlap, end - limit)
            j = bisect_left(places, start)
            if start > before and j < len(places) and places[j] < cut:
                start = places[j]
            elif start > before and text[start - 1 : start].strip() and start < cut:
                start = min(cut, next((k for k in range(start, min(start + 8, cut)) if not (unicodedata.combining(text[k]) or text[k] in _JOINERS)), start))
        out.append((start, cut, end, "end" if end == size else NAMES[strength.get(end, NONE)]))
        before = cut
    return out


def split_items(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of every text: ``keys``, ``piece_no`` from 0, ``start``, ``n_new``, ``n_overlap``, ``n_chars`` (of the text), ``piece``, ``boundary``, ``cut_level``.

    ``boundary`` is what the piece ends at (``end`` for the last), ``cut_level`` see the function.
    Texts within ``limit`` come out whole, empty texts as one empty piece, null texts not at all.
    Each row is worked on by itself: no shuffle, memory for one batch and one text.
    """
    schema = df.select(*keys).schema
    for name, kind in (("piece_no", "integer"), ("start", "integer"), ("n_new", "integer"), ("n_overlap", "integer"), ("n_chars", "integer"), ("piece", "string"), ("boundary", "string"), ("cut_level", "string")):
        schema = schema.add(name, kind)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 5 + [pa.string()] * 3
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []

            def flush():
                head = [batch.column(i).take(pa.array(take, pa.int64())) for i in range(width)]
                tail = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                return pa.RecordBatch.from_arrays(head + tail, names=schema.names)

            held = 0
            for i, value in enumerate(batch.column(width).to_pylist()):
                if value is None:
                    continue
                level = cut_level(value, limit)
                for no, (start, cut, end, bound) in enumerate(split_text(value, limit, overlap)):
                    rows.append((no, cut, end - cut, cut - start, len(value), value[start:end], bound, level))
                    take.append(i)
                held += len(value)
                if held > 8_000_000:
                    yield flush()
                    rows, take, held = [], [], 0
            yield flush()

    return df.select(*keys, text).mapInArrow(run, schema)
