"""Subject areas of documents by clustering, discriminative terms and leaf mixtures.

1. Every text becomes sentences of hashed words; front matter and headings are left out.
2. Languages are modelled from the cleaned ``lang`` column and assigned to every text by its
   words, so that words count as discriminative within their language only.
3. Normalised document vectors (squared inverse document frequencies counted over all documents,
   boilerplate words of a language left out) are clustered by bisecting k-means over all
   documents, and the centroids become the means of the documents that go down the tree.
4. Leaves are described by the subjects of the labelled documents in them, and through the
   mixtures of the leaves every word of the corpus gets a distribution over subjects: the
   discriminative terms. A second round counts them from the sentences the first one assigned.
5. Each sentence goes to the subject its terms speak for, or to none; a document has the
   subjects that hold at least ``share`` of its sentences.

Texts are tokenised once; every pass then reads flat arrays and sends on sums for at most WORDS words
(or LEAVES * FEATURES coordinates) a task, which Spark adds up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from memlake.session import cut

#: Bounds and settings. WORDS bounds every term table that is collected or broadcast.
WORDS = 2**18
FEATURES = 4096
LEAVES = 96
#: Up to so many documents the tree is grown from on the driver; from more in passes over all. No leaf is smaller than LEAF_DOCS.
TREE_SAMPLE = 20_000
#: Tasks of such a pass at most; each sends sums of at most 2 * LEAVES * FEATURES coordinates to the driver.
TASKS = 64
LEAF_DOCS = 8
#: Languages modelled one by one, the commonest first; all others are one language more.
LANGUAGES = 16
LANGUAGE_WORDS = 4096
BOILERPLATE = 0.4
SHARE = 0.25
SMOOTH = 20.0
NONE_PRIOR = 0.3

_FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_SPEAKER = re.compile(r"^\w{1,20}: ")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def sentences(text: str) -> list[str]:
    """The sentences of ``text`` without front matter, headings and speaker names."""
    out = []
    for line in _FRONT.sub("", text).splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            out += [s for s in _SENTENCE.split(_SPEAKER.sub("", line)) if s]
    return out


class _Hasher(dict):
    """Hashes of words, each computed once in a task; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode()) % WORDS
        return h


def _hashed(text: str, known: _Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words of each sentence, one after the other, and where each sentence ends."""
    terms: list[int] = []
    ends: list[int] = []
    for s in sentences(text):
        words = sorted({known[w] for w in _WORD.findall(s.lower())})
        if words:
            terms += words
            ends.append(len(terms))
    return np.array(terms, dtype=np.int32), np.array(ends, dtype=np.int32)


def _tokenised(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, lang, terms, ends``; the last two are flat 32-bit numbers."""
    cleaned = F.nullif(F.substring(F.lower(F.trim(F.col(lang))), 1, 2), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hasher()
        for batch in batches:
            both = [_hashed(t or "", known) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([b[i].tobytes() for b in both], pa.binary()) for i in (0, 1))], names=["key", "lang", "terms", "ends"])

    schema = docs.select(F.col(key).alias("key")).schema.add("lang", "string").add("terms", "binary").add("ends", "binary")
    return docs.select(F.col(key).alias("key"), cleaned.alias("lang"), text).mapInArrow(run, schema)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column one after the other, and how many each row has."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.int32, count=at[-1] // 4)[at[0] // 4 :] if data is not None and len(column) else np.zeros(0, np.int32)
    return flat.astype(np.int64), np.diff(at) // 4


def _summed(parts: DataFrame, by: str, *sums: str) -> "pd.DataFrame":  # noqa: F821
    """Partial sums of the tasks added up by a bounded number."""
    return parts.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums]).toArrow().to_pandas()


@dataclass
class Languages:
    """Log-probabilities of the commonest words in each language; everything else is neutral."""

    names: list[str]
    table: np.ndarray  # WORDS x languages, float32

    def of(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The language of each document; ``starts``: where its terms begin (none may be empty)."""
        return np.add.reduceat(self.table[terms], starts, axis=0).argmax(1)


#: The name of the languages beyond the LANGUAGES commonest.
OTHER = "*"


def _languages(rows: DataFrame) -> Languages:
    sizes = {r["lang"]: r["count"] for r in rows.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    names = list(sizes) or [OTHER]
    rest = rows.where("lang is not null").where(~F.col("lang").isin(names)).count() if len(names) == LANGUAGES else 0
    if rest:
        names, sizes = [*names, OTHER], {**sizes, OTHER: rest}
    table = np.zeros((WORDS, len(names)), dtype=np.float32)
    if len(names) < 2:
        return Languages(names, table)
    code = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(WORDS * len(code), dtype=np.int64)
        for batch in batches:
            said = np.array([code.get(s, len(code) - 1) for s in batch.column(0).to_pylist()], dtype=np.int64)
            terms, size = _numbers(batch.column(1))
            doc = np.repeat(np.arange(len(size)), size)
            pair = _distinct(doc * WORDS + terms)
            np.add.at(seen, pair % WORDS * len(code) + said[pair // WORDS], 1)
        used = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["at", "n"])

    counts = rows.where("lang is not null").select("lang", "terms").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = counts.select("n", F.expr(f"at div {len(names)}").alias("term"), (F.col("at") % len(names)).alias("lang"))
    common = counts.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(LANGUAGE_WORDS)
    seen = counts.join(F.broadcast(common.select("term")), "term", "left_semi").toArrow().to_pandas()
    total = np.array([sizes[s] for s in names], dtype=float)
    table[np.unique(seen["term"].to_numpy())] = np.log(0.5 / (total + 1))
    column = seen["lang"].to_numpy()
    table[seen["term"].to_numpy(), column] = np.log((seen["n"].to_numpy() + 0.5) / (total[column] + 1))
    return Languages(names, table)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; sorting beats hashing here."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class _Batch:
    """Flat arrays of one batch of documents: their words as (language, word) features, sentence and document bounds."""

    def __init__(self, batch: pa.RecordBatch, langs: Languages):
        flat, size = _numbers(batch.column("terms"))
        local, self.n_sents = _numbers(batch.column("ends"))
        self.n = len(size)
        first = np.cumsum(size) - size
        full = np.nonzero(size)[0]
        self.lang = np.zeros(self.n, dtype=np.int64)
        if len(flat):
            self.lang[full] = langs.of(flat, first[full])
        self.term_doc = np.repeat(np.arange(self.n), size)
        self.features = (flat + self.lang[self.term_doc] * 40_503_001) % WORDS
        self.sent_doc = np.repeat(np.arange(self.n), self.n_sents)
        stop = local + first[self.sent_doc]
        self.sent_start = np.r_[0, stop[:-1]] if len(stop) else stop
        self.sent_len = stop - self.sent_start

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their distinct words."""
        pair = _distinct(self.term_doc * WORDS + self.features)
        return pair // WORDS, pair % WORDS

    def by_sentence(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.features], self.sent_start, axis=0) if len(self.sent_start) else np.zeros((0, table.shape[1]))

    def by_document(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, values.shape[1]))
        np.add.at(out, self.sent_doc, values)
        return out


def _spread(word: np.ndarray) -> np.ndarray:
    """The coordinate of each word in the document vectors."""
    return (word * 2_654_435_761 >> 7) % FEATURES


@dataclass
class Tree:
    """A bisecting k-means tree over sparse normalised document vectors.

    ``children``: two nodes of each inner node, -1 of a leaf; ``leaf``: the number of each leaf. Node 0 is the root.
    """

    weights: np.ndarray  # FEATURES
    kept: np.ndarray  # WORDS, boolean: no boilerplate
    centres: np.ndarray  # nodes x FEATURES
    children: np.ndarray  # nodes x 2
    leaf: np.ndarray  # nodes

    def vectors(self, doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates of the documents' vectors: document, dimension, value (in order of documents); words may be repeated."""
        keep = self.kept[word]
        there = np.zeros(n * FEATURES, dtype=bool)
        there[doc[keep] * FEATURES + _spread(word[keep])] = True
        doc, dim = np.divmod(np.flatnonzero(there), FEATURES)
        value = self.weights[dim]
        length = np.sqrt(np.bincount(doc, weights=value**2, minlength=n))
        return doc, dim, value / np.maximum(length[doc], 1e-30)

    def down(self, doc: np.ndarray, dim: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The node each document ends at; documents without words stay above, at -1."""
        node = np.full(n, -1)
        node[doc] = 0
        apart = np.zeros_like(self.centres)
        inner = self.children[:, 0] >= 0
        apart[inner] = self.centres[self.children[inner, 0]] - self.centres[self.children[inner, 1]]
        while len(doc):
            mine = inner[node[doc]]
            if not mine.all():
                doc, dim, value = doc[mine], dim[mine], value[mine]
            lead = np.bincount(doc, weights=value * apart[node[doc], dim], minlength=n)
            at = np.flatnonzero(inner[node] & (node >= 0))
            node[at] = self.children[node[at], (lead[at] < 0).astype(int)]
        return node


def _grown(tree: Tree, doc: np.ndarray, dim: np.ndarray, value: np.ndarray, n: int, leaves: int, rounds: int = 6) -> None:
    """Grows ``tree`` on ``n`` vectors: the leaf of most documents is cut in two, until there are ``leaves`` or none is large enough."""
    start = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(1)

    def mean(rows: np.ndarray) -> np.ndarray:
        at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
        c = np.bincount(dim[at], weights=value[at], minlength=FEATURES)
        return c / max(np.linalg.norm(c), 1e-30)

    members = {0: np.unique(doc)}
    centres, children = [mean(members[0])], [[-1, -1]]
    shut: set[int] = set()
    while len(members) < leaves:
        open_ = [i for i in members if i not in shut and len(members[i]) >= 2 * LEAF_DOCS]
        if not open_:
            break
        node = max(open_, key=lambda i: (len(members[i]), -i))
        rows = members[node]
        size = start[rows + 1] - start[rows]
        at = np.repeat(start[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        own, x, v = np.repeat(np.arange(len(rows)), size), dim[at], value[at]
        noise = rng.normal(size=FEATURES) * centres[node] * 0.5
        two = np.stack([centres[node] + noise, centres[node] - noise])
        side = np.zeros(len(rows), dtype=bool)
        for _ in range(rounds):
            side = np.bincount(own, weights=v * (two[0, x] - two[1, x]), minlength=len(rows)) < 0
            for k in (0, 1):
                mine = side[own] == bool(k)
                c = np.bincount(x[mine], weights=v[mine], minlength=FEATURES)
                two[k] = c / max(np.linalg.norm(c), 1e-30)
        if min(side.sum(), (~side).sum()) < LEAF_DOCS:
            shut.add(node)
            continue
        children[node] = [len(centres), len(centres) + 1]
        for k in (0, 1):
            members[len(centres)] = rows[side == bool(k)]
            centres.append(two[k])
            children.append([-1, -1])
        del members[node]
    tree.centres, tree.children = np.array(centres), np.array(children)
    tree.leaf = np.full(len(centres), -1)
    ends = np.nonzero(tree.children[:, 0] < 0)[0]
    tree.leaf[ends] = np.arange(len(ends))


def _grown_in_passes(tree: Tree, rows: DataFrame, langs: Languages, leaves: int, rounds: int = 6) -> None:
    """``_grown`` for any number of documents: all leaves that may be among the largest are cut at once, level by level, each round a pass.

    A part is smaller than what it was cut from, so the nodes cut one by one, the largest first, are the largest
    of those that a tree cut everywhere has; what was cut beyond them is taken back at the end.
    """
    context = rows.sparkSession.sparkContext
    model = context.broadcast((langs, tree))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tree = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = _Batch(batch.slice(i, 2000), langs)
                doc, dim, _ = tree.vectors(b.term_doc, b.features, b.n)
                parts = np.split(dim.astype(np.int32), np.searchsorted(doc, np.arange(1, b.n)))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary())], names=["dims"])

    held = cut(rows.select("terms", "ends").mapInArrow(vectors, "dims binary").coalesce(TASKS))

    def sums(nodes: list[int], two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of both sides of every node to be cut the sums and numbers of documents."""
        where = np.full(len(centres), -1)
        where[nodes] = np.arange(len(nodes))
        now = Tree(tree.weights, tree.kept, np.array(centres), np.array(children), tree.leaf)
        shared = context.broadcast((now, where, (two[:, 0] - two[:, 1])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, where, apart = shared.value
            total, count = np.zeros(2 * len(apart) * FEATURES), np.zeros(2 * len(apart), dtype=np.int64)
            for batch in batches:
                dim, size = _numbers(batch.column(0))
                n = len(size)
                doc = np.repeat(np.arange(n), size)
                value = now.weights[dim]
                value = value / np.maximum(np.sqrt(np.bincount(doc, weights=value**2, minlength=n)), 1e-30)[doc]
                node = now.down(doc, dim, value, n)
                at = np.where(node < 0, -1, where[node])
                mine = at[doc] >= 0
                doc, dim, value = doc[mine], dim[mine], value[mine]
                lead = np.bincount(doc, weights=value * apart[at[doc], dim], minlength=n)
                side = 2 * at + (lead < 0)
                total += np.bincount(side[doc] * FEATURES + dim, weights=value, minlength=len(total))
                count += np.bincount(side[at >= 0], minlength=len(count))
            for k in np.flatnonzero(count):
                own = total[k * FEATURES : (k + 1) * FEATURES]
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([count[k]]), pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([own[used].tobytes()], pa.binary())], names=["side", "n", "used", "sums"])

        out, number = np.zeros((2 * len(nodes), FEATURES)), np.zeros(2 * len(nodes), dtype=np.int64)
        for r in held.mapInArrow(run, "side long, n long, used binary, sums binary").collect():
            out[r["side"], np.frombuffer(r["used"], dtype=np.int32)] += np.frombuffer(r["sums"])
            number[r["side"]] += r["n"]
        shared.destroy()
        return out.reshape(len(nodes), 2, FEATURES), number.reshape(len(nodes), 2)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)

    centres, children = [np.zeros(FEATURES)], [[-1, -1]]
    whole, number = sums([0], np.zeros((1, 2, FEATURES)))  # without a difference all are on one side
    centres[0], size = unit(whole[0, 0]), {0: int(number.sum())}
    ends, shut = {0}, set()
    while True:
        inner = sorted((size[i] for i in size if children[i][0] >= 0), reverse=True)
        least = inner[leaves - 2] if leaves > 1 and len(inner) >= leaves - 1 else 0
        nodes = sorted((i for i in ends - shut if size[i] >= 2 * LEAF_DOCS and size[i] > least), key=lambda i: (-size[i], i))[: leaves - 1]
        if not nodes:
            break
        noise = np.stack([np.random.default_rng([1, i]).normal(size=FEATURES) * centres[i] * 0.5 for i in nodes])
        middle = np.stack([centres[i] for i in nodes])
        two = np.stack([middle + noise, middle - noise], axis=1)
        for _ in range(rounds):
            before = two
            parts, number = sums(nodes, two)
            two = unit(parts)
            if np.allclose(before, two, atol=1e-12):
                break
        for k, i in enumerate(nodes):
            if number[k].min() < LEAF_DOCS:
                shut.add(i)
                continue
            children[i] = [len(centres), len(centres) + 1]
            ends.remove(i)
            for side in (0, 1):
                ends.add(len(centres))
                size[len(centres)] = int(number[k, side])
                centres.append(two[k, side])
                children.append([-1, -1])
    # the largest are cut, their parents always among them; the numbers stay in order, children behind their parents
    largest = set(sorted((i for i in size if children[i][0] >= 0), key=lambda i: (-size[i], i))[: max(0, leaves - 1)])
    kept = [0] + [c for i in range(len(centres)) if i in largest for c in children[i]]
    kept.sort()
    new = {old: k for k, old in enumerate(kept)}
    tree.centres = np.array([centres[i] for i in kept])
    tree.children = np.array([[new[c] for c in children[i]] if i in largest else [-1, -1] for i in kept])
    tree.leaf = np.full(len(kept), -1)
    last = np.nonzero(tree.children[:, 0] < 0)[0]
    tree.leaf[last] = np.arange(len(last))


def _tree(rows: DataFrame, langs: Languages, leaves: int) -> Tree:
    """The tree: word counts, growth and centroids over all documents."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tongue, spoken = np.zeros(WORDS, dtype=np.int64), np.zeros(WORDS, dtype=np.int64), np.zeros(len(shared.value.names), dtype=np.int64)
        for batch in batches:
            b = _Batch(batch, shared.value)
            doc, word = b.words()
            np.add.at(seen, word, 1)
            tongue[word] = b.lang[doc]
            spoken += np.bincount(b.lang[np.unique(doc)], minlength=len(spoken))
        used = np.nonzero(seen)[0]
        # the languages follow the words, as numbers below 0
        at, n = np.r_[used, -1 - np.arange(len(spoken))], np.r_[seen[used], spoken]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(np.r_[tongue[used], np.arange(len(spoken))])], names=["at", "n", "tongue"])

    narrow = rows.select("terms", "ends")
    counts = narrow.mapInArrow(count, "at long, n long, tongue long").groupBy("at").agg(F.sum("n").alias("n"), F.max("tongue").alias("tongue")).toArrow().to_pandas()
    word = counts[counts["at"] >= 0]
    spoken = np.zeros(len(langs.names))
    spoken[-1 - counts["at"][counts["at"] < 0].to_numpy()] = counts["n"][counts["at"] < 0]
    kept = np.ones(WORDS, dtype=bool)
    n = word["n"].to_numpy()
    kept[word["at"].to_numpy()[(n >= BOILERPLATE * spoken[word["tongue"].to_numpy()]) & (n > 3)]] = False
    df = np.bincount(_spread(word["at"].to_numpy()[kept[word["at"].to_numpy()]]), weights=n[kept[word["at"].to_numpy()]], minlength=FEATURES)
    # the small constant keeps documents of nothing but rare or common words from being all zero
    idf = np.where(df >= 2, np.maximum(np.log((spoken.sum() + 1) / (np.minimum(df, spoken.sum()) + 1)), 0), 0)
    tree = Tree(idf**2 + 1e-6, kept, np.zeros((1, FEATURES)), np.full((1, 2), -1), np.zeros(1, dtype=int))
    if spoken.sum() <= TREE_SAMPLE:
        for part in narrow.toArrow().combine_chunks().to_batches():
            b = _Batch(part, langs)
            _grown(tree, *tree.vectors(*b.words(), b.n), b.n, leaves)
    else:
        _grown_in_passes(tree, rows, langs, leaves)
    grown = context.broadcast((langs, tree))

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tree = grown.value
        sums = np.zeros(tree.centres.size)
        for batch in batches:
            b = _Batch(batch, langs)
            doc, dim, value = tree.vectors(b.term_doc, b.features, b.n)
            node = tree.down(doc, dim, value, b.n)
            sums += np.bincount(node[doc] * FEATURES + dim, weights=value, minlength=len(sums))
        used = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["at", "sum"])

    moved = _summed(narrow.mapInArrow(means, "at long, sum double"), "at", "sum")
    flat = np.zeros(tree.centres.size)
    flat[moved["at"].to_numpy()] = moved["sum"].to_numpy()
    sums = flat.reshape(tree.centres.shape)
    for node in range(len(sums) - 1, -1, -1):  # children come behind their parents
        if tree.children[node, 0] >= 0:
            sums[node] += sums[tree.children[node]].sum(0)
    tree.centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    return tree


def _log_odds(table: np.ndarray, tongue: np.ndarray) -> np.ndarray:
    """How much more likely each word is in a class than in its language as a whole."""
    out = np.zeros(table.shape, dtype=np.float32)
    for t in range(int(tongue.max(initial=-1)) + 1):
        mine = tongue == t
        own = table[mine]
        if own.sum():
            base = own.sum(1, keepdims=True) / own.sum()
            out[mine] = np.log((own + SMOOTH * base) / (own.sum(0) + SMOOTH)) - np.log(np.maximum(base, 1e-12))
    return out


def _own(given: pa.Array, classes: int) -> np.ndarray:
    """The classes people gave each document, in equal parts; zeros where they gave none."""
    size = np.asarray(pc.fill_null(pc.list_value_length(given), 0))
    doc = np.repeat(np.arange(len(size)), size)
    own = np.zeros((len(size), classes))
    own[doc, np.asarray(given.flatten(), dtype=np.int64)] = 1 / size[doc]
    return own


@dataclass
class Model:
    """Everything the passes over the sentences share; bounded by WORDS and LEAVES."""

    langs: Languages
    tree: Tree
    leaf_mix: np.ndarray
    rounds: list[np.ndarray]

    def prior(self, given: pa.Array, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mix = self.leaf_mix[leaf].copy()
        own = _own(given, mix.shape[1])
        labelled = own.any(1)
        mix[labelled] = 0.3 * mix[labelled] + 0.7 * own[labelled]
        weight = np.where(labelled, 3.0, 1.0)
        mix *= 1 - NONE_PRIOR
        mix[:, -1] += NONE_PRIOR
        return mix, weight

    def leaves(self, b: _Batch) -> np.ndarray:
        """The leaf of each document; -1 of those without words, which is the last row of ``leaf_mix``."""
        node = self.tree.down(*self.tree.vectors(b.term_doc, b.features, b.n), b.n)
        return np.where(node < 0, -1, self.tree.leaf[node])

    def assign(self, batch: pa.RecordBatch) -> tuple[_Batch, np.ndarray, np.ndarray]:
        """The batch, the weight of each document, and the class distribution of each sentence after the rounds so far."""
        b = _Batch(batch, self.langs)
        mix, weight = self.prior(batch.column("given"), self.leaves(b))
        post, prior = mix[b.sent_doc], mix
        for odds in self.rounds:
            score = b.by_sentence(odds) + np.log(prior[b.sent_doc] + 0.01)
            post = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
            post /= np.maximum(post.sum(1, keepdims=True), 1e-30)
            prior = b.by_document(post) + 0.3 * mix
            prior /= prior.sum(1, keepdims=True)
        return b, weight, post


def _count(rows: DataFrame, model: Model, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Words counted by the classes of their sentences, and the language of each word; one pass, at most WORDS rows collected."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tongue = np.zeros((WORDS, classes)), np.full(WORDS, -1)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b, weight, post = shared.value.assign(batch.slice(i, 2000))
                if len(post):
                    share = np.repeat(post * weight[b.sent_doc][:, None], b.sent_len, axis=0)
                    for c in range(classes):
                        table[:, c] += np.bincount(b.features, weights=share[:, c], minlength=WORDS)
                    tongue[b.features] = b.lang[b.term_doc]
        used = np.nonzero(tongue >= 0)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(tongue[used].astype(np.int32)), *[pa.array(table[used, c]) for c in range(classes)]], names=["word", "tongue", *names])

    parts = rows.mapInArrow(run, "word int, tongue int, " + ", ".join(f"{c} double" for c in names))
    summed = parts.groupBy("word").agg(F.max("tongue").alias("tongue"), *[F.sum(c).alias(c) for c in names]).toArrow().to_pandas()
    table, tongue = np.zeros((WORDS, classes)), np.full(WORDS, -1)
    table[summed["word"]] = summed[names].to_numpy()
    tongue[summed["word"]] = summed["tongue"]
    return table, tongue


def subject_shares(docs: DataFrame, key: str, text: str, lang: str, labels: DataFrame, subjects: list[str], leaves: int = LEAVES) -> DataFrame:
    """The share of each document's sentences that treat a subject: ``key, subject, share, n_sentences``, shares above 0.

    ``labels``: ``key, subject`` as people gave them (``none`` for no subject; anything else not in
    ``subjects``, and null keys, are left out; repeated labels count once). Null and empty texts have
    no sentences and come out with no row. ``lang`` may be null, padded or wrong.
    """
    classes = [*subjects, "none"]
    at = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    wanted = labels.where(F.col(key).isNotNull() & F.col("subject").isin(classes)).select(F.col(key).alias("key"), F.element_at(at, F.col("subject")).alias("class"))
    given = wanted.groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("given"))
    rows = cut(_tokenised(docs, key, text, lang).join(given, "key", "left"))
    langs = _languages(rows)
    tree = _tree(rows, langs, leaves)
    model = Model(langs, tree, np.zeros((leaves + 2, len(classes))), [])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((leaves + 2, len(classes)))
        for batch in batches:
            np.add.at(table, shared.value.leaves(_Batch(batch, shared.value.langs)), _own(batch.column("given"), len(classes)))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table.ravel()[used])], names=["at", "sum"])

    placed = _summed(rows.where("given is not null").mapInArrow(place, "at long, sum double"), "at", "sum")
    model.leaf_mix.ravel()[placed["at"].to_numpy()] = placed["sum"].to_numpy()
    mix = model.leaf_mix
    base = mix.sum(0) / mix.sum() if mix.sum() else np.full(len(classes), 1 / len(classes))
    model.leaf_mix = (mix + 2 * base) / (mix.sum(1, keepdims=True) + 2)
    first, tongue = _count(rows, model, len(classes))
    model.rounds = [_log_odds(first, tongue)]
    second, tongue = _count(rows, model, len(classes))
    model.rounds.append(_log_odds(0.5 * first + second, tongue))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                b, _, post = shared.value.assign(part)
                best = np.zeros_like(post)
                if len(post):
                    best[np.arange(len(post)), post.argmax(1)] = 1
                share = b.by_document(best) / np.maximum(b.n_sents, 1)[:, None]
                doc, subject = np.nonzero(share[:, : len(subjects)] > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc)), pa.array([classes[c] for c in subject], pa.string()), pa.array(share[doc, subject]), pa.array(b.n_sents[doc].astype(np.int32))],
                    names=[key, "subject", "share", "n_sentences"],
                )

    schema = docs.select(key).schema.add("subject", StringType()).add("share", DoubleType()).add("n_sentences", IntegerType())
    return rows.mapInArrow(run, schema)
