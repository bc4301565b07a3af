"""Hooks for models, and what to do with their answers: embedders, scorers, summaries with a fallback, JSON in free text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import is_atomic_id
from memlake.functions.vectors import hash_embedding, l2_normalize

#: Answers whose JSON is longer are refused, as in the contract of extractors.
MAX_JSON = 1 << 20
ANSWER = (
    "summary string, tags array<string>, outcomes array<string>, emotionSummary string, linkedAtoms array<string>, "
    "proposals array<struct<proposed_id:string,phase:double,type:string,title:string,body:string,confidence:double>>"
)
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S | re.I)
_MARK = re.compile(r'\\.|["{}]', re.S)


def embedder(encode: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64) -> Callable[[Column], Column]:
    """A function from a text column to vectors of length 1, batch by batch.

    ``encode``: from a list of texts to a matrix; null texts give null. None: the deterministic stand-in. Documents and queries may
    need different prompts: make one embedder of each.
    """
    if encode is None:
        return lambda text: hash_embedding(text, dim)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        there = np.flatnonzero(texts.notna())
        made = encode(texts.iloc[there].tolist()) if len(there) else []
        if len(made) != len(there):
            raise ValueError("an embedder must give a vector for every text")
        out: list = [None] * len(texts)
        for i, v in zip(there, made):
            out[i] = np.asarray(v, dtype=float)
        return pd.Series(out, dtype=object)

    return lambda text: l2_normalize(run(text))


def scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[DataFrame], DataFrame]:
    """A second score for ``fusion.rerank`` from a model over (query, snippet) pairs.

    Where a batch fails, or comes back with another number of scores, its rows have none, and ``rerank`` keeps the first pass there.
    """

    @F.pandas_udf("double")
    def run(query: pd.Series, snippet: pd.Series) -> pd.Series:
        try:
            made = list(score(query.fillna("").tolist(), snippet.fillna("").tolist()))
        except Exception:
            made = []
        return pd.Series([float(x) if x is not None else None for x in made] if len(made) == len(query) else [None] * len(query), dtype=float)

    return lambda hits: hits.withColumn("second", run("query", "snippet"))


def json_object(text: str) -> str | None:
    """The outermost JSON object in a model's answer: the whole of it, a fenced block, or the first balanced braces; None without any."""
    text = text.strip()
    if text.startswith("{"):
        return text
    fenced = _FENCED.search(text)
    if fenced:
        return fenced[1]
    start, depth, quoted = text.find("{"), 0, False
    for m in _MARK.finditer(text, max(start, 0)):
        if m[0] == '"':
            quoted = not quoted
        elif m[0] in "{}" and not quoted:
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[start : m.end()]
    return None


def _valid_json(text: str | None) -> str | None:
    found = json_object(text) if isinstance(text, str) else None
    if found is None or len(found) > MAX_JSON:
        return None
    try:
        return found if isinstance(json.loads(found), dict) else None
    except ValueError:
        return None


def extract_json(text: Column) -> Column:
    """``json_object`` of every text; null where there is none, it is too long or no JSON."""
    return F.pandas_udf(lambda texts: texts.map(_valid_json), "string")(text)


def parsed_answer(answer: Column) -> Column:
    """An extractor's answer as a struct (ANSWER), or null: a summary is a must, proposals need a well-formed id, title and body.

    Missing phases, and those that are no whole number from 0 to 5, are 1; confidences are clamped to [0, 1].
    """
    a = F.from_json(extract_json(answer), ANSWER)
    texts = lambda field: F.filter(F.coalesce(field, F.array().cast("array<string>")), lambda t: t.isNotNull())
    good = F.filter(
        F.coalesce(a["proposals"], F.array().cast("array<struct<proposed_id:string,phase:double,type:string,title:string,body:string,confidence:double>>")),
        lambda p: p.isNotNull() & is_atomic_id(p["proposed_id"]) & (p["title"] != "") & (p["body"] != ""),
    )
    proposals = F.transform(
        good,
        lambda p: F.struct(
            p["proposed_id"].alias("proposed_id"), F.when((p["phase"] == F.floor(p["phase"])) & p["phase"].between(0, 5), p["phase"].cast("int")).otherwise(1).alias("phase"),
            F.coalesce(p["type"], F.lit("insight")).alias("type"), p["title"].alias("title"), p["body"].alias("body"),
            F.when(p["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["confidence"]))).alias("confidence"),
        ),
    )
    made = F.struct(
        a["summary"].alias("summary"), texts(a["tags"]).alias("tags"), texts(a["outcomes"]).alias("outcomes"), F.coalesce(a["emotionSummary"], F.lit("neutral")).alias("emotion"),
        texts(a["linkedAtoms"]).alias("linked_atoms"), proposals.alias("proposals"),
    )
    return F.when(F.coalesce(a["summary"], F.lit("")) != "", made)


def summarised(sessions: DataFrame, prompt: str, plain: str, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """``sessions`` with ``answer`` (see ``parsed_answer``) and ``summary``: the model's, or the ``plain`` one where it fails.

    ``prompt``: the column given to ``complete``, in batches; an exception, another number of answers or an unusable one
    leaves the batch, or the row, to the fallback.
    """

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        try:
            made = list(complete(prompts.fillna("").tolist()))
        except Exception:
            made = []
        return pd.Series(made if len(made) == len(prompts) else [None] * len(prompts), dtype=object)

    out = sessions.withColumn("answer", parsed_answer(run(prompt)))
    return out.withColumn("summary", F.coalesce(F.col("answer.summary"), F.col(plain)))
