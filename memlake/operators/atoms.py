"""The index of atoms: lookups, reverse citations, crosslinks and chains of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import normalise_status, symbol_parts
from memlake.operators import skew
from memlake.operators.graph import reachable

# The crosslinks a chain follows.
CHAIN_LINKS = ("references", "implements", "parent_blueprint", "resolves")


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; rows without a key are dropped."""
    rest = [c for c in df.columns if c != key]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return first.select(*[F.col(key) if c == key else F.col("__x")[c].alias(c) for c in df.columns])


def substring_search(atoms: DataFrame, needle: str, order: Column, k: int = 5) -> DataFrame:
    """The first ``k`` atoms whose id, title or one of whose tags contains ``needle``, ignoring case; score 1."""
    low = F.lit(needle.lower())
    tags = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(F.lower(t).contains(low), F.lit(False)))
    hit = F.coalesce(F.lower("id").contains(low), F.lit(False)) | F.coalesce(F.lower("title").contains(low), F.lit(False)) | tags
    return atoms.where(hit).withColumn("score", F.lit(1.0)).orderBy(order).limit(k)


def citations(atoms: DataFrame) -> DataFrame:
    """What each atom cites, one row each: ``id, via, file, fn, line``; a ``geography`` entry covers its whole file."""
    symbols = atoms.select("id", F.lit("symbol").alias("via"), F.explode("linked_symbols").alias("s")).select("id", "via", "s.file", "s.fn", "s.line")
    places = atoms.select("id", F.lit("geography").alias("via"), F.explode("geography").alias("g"))
    places = places.select("id", "via", F.split("g", ":")[0].alias("file"), F.lit(None).cast("string").alias("fn"), F.lit(None).cast("int").alias("line"))
    return symbols.unionByName(places).where("file is not null").distinct()


def citing_atoms(queries: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms that cite a symbol, once each: ``symbol, id``.

    ``queries``: ``symbol`` as ``file[:fn[:line]]``. The file must agree; a function or line given on one side
    only matches anything, a ``geography`` entry ignores both. Equi-join on the file, the rest as its condition.
    """
    asked = queries.select("symbol").where("symbol is not null").distinct().withColumn("q", symbol_parts(F.col("symbol"))).select("symbol", F.col("q.file").alias("file"), F.col("q.fn").alias("qfn"), F.col("q.line").alias("qline"))
    line = F.col("qline").isNull() | F.col("line").isNull() | (F.col("line") == F.col("qline"))
    fits = F.col("fn").isNull() | F.col("qfn").isNull() | ((F.col("fn") == F.col("qfn")) & line)
    left, right, on = skew.salted(citations(atoms), asked, ["file"], ["id"])
    return left.join(right, on).where(fits).select("symbol", "id").distinct()


def crosslinks(atoms: DataFrame, via: tuple[str, ...] | None = None) -> DataFrame:
    """Crosslinks, one row each: ``id, via, target``; null and empty targets are none, repeated ones one."""
    out = atoms.select("id", F.explode("crosslinks").alias("via", "targets")).select("id", "via", F.explode("targets").alias("target"))
    out = out.where("target is not null and target <> ''").distinct()
    return out.where(F.col("via").isin(*via)) if via else out


def broken_links(atoms: DataFrame, via: tuple[str, ...] | None = None) -> DataFrame:
    """Crosslinks whose target is not in the index."""
    known = atoms.select(F.col("id").alias("target")).where("target is not null").distinct()
    return crosslinks(atoms, via).join(known, "target", "left_anti").select("id", "via", "target")


def backlinks(atoms: DataFrame) -> DataFrame:
    """Who links to each target, scored 1/rank by id: ``target, id, score``. Hot targets are ranked over several partitions."""
    ranked = skew.numbered(crosslinks(atoms).select("target", "id").distinct(), ["target"], ["id"], "__r")
    return ranked.select("target", "id", (1.0 / F.col("__r")).alias("score"))


def tagged(atoms: DataFrame) -> DataFrame:
    """The atoms of every tag, scored 1/rank by id: ``tag, id, score``. Tags compare as written; null and empty ones are none."""
    pairs = atoms.select(F.explode("tags").alias("tag"), "id").where("tag is not null and tag <> '' and id is not null").distinct()
    return skew.numbered(pairs, ["tag"], ["id"], "__r").select("tag", "id", (1.0 / F.col("__r")).alias("score"))


# How grave a change to what an atom of a type cites is; any other type is LOW, and none cited NONE.
RISK = {"adr": "HIGH", "blueprint": "HIGH", "feat": "MEDIUM", "concept": "MEDIUM", "flow": "MEDIUM"}
RISKS = ("NONE", "LOW", "MEDIUM", "HIGH")


def risk_rank(kind: Column) -> Column:
    """The rank in RISKS of an atom's type; null types are LOW."""
    rank = F.lit(1)
    for name, risk in RISK.items():
        rank = F.when(F.lower(kind) == name, F.lit(RISKS.index(risk))).otherwise(rank)
    return rank


def drift(changed: DataFrame, atoms: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """What a change touches: ``symbol, n_atoms, n_callers, risk`` for every changed ``symbol`` (``file[:fn[:line]]``).

    ``risk`` is the greatest of the citing atoms, ``NONE`` without any. ``callers``: ``seed, node`` as ``graph.neighbors`` finds them
    against the calls, with symbols as seeds.
    """
    asked = changed.select("symbol").where("symbol is not null").distinct()
    cited = citing_atoms(asked, atoms).join(atoms.select("id", "type"), "id").groupBy("symbol").agg(F.count("*").alias("n_atoms"), F.max(risk_rank(F.col("type"))).alias("__r"))
    out = asked.join(cited, "symbol", "left")
    if callers is None:
        out = out.withColumn("n_callers", F.lit(0).cast("long"))
    else:
        out = out.join(callers.groupBy(F.col("seed").alias("symbol")).agg(F.countDistinct("node").alias("n_callers")), "symbol", "left")
    names = F.array(*map(F.lit, RISKS))
    return out.select("symbol", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"), F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.element_at(names, F.coalesce("__r", F.lit(0)) + 1).alias("risk"))


def drift_summary(report: DataFrame) -> DataFrame:
    """Changed symbols per risk, those that do not occur with 0: ``risk, n``."""
    every = report.sparkSession.createDataFrame([(r,) for r in RISKS], "risk string")
    return every.join(report.groupBy("risk").agg(F.count("*").alias("n")), "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Link texts resolved by id, else by title ignoring case (the smallest id of equal titles): ``link, id``; null if neither."""
    by_id = notes.select(F.col("id").alias("link"), F.col("id").alias("by_id")).where("link is not null").distinct()
    by_title = notes.where("title is not null").groupBy(F.lower("title").alias("low")).agg(F.min("id").alias("by_title"))
    met = links.select("link").distinct().join(by_id, "link", "left").withColumn("low", F.lower("link")).join(by_title, "low", "left")
    return met.select("link", F.coalesce("by_id", "by_title").alias("id"))


def verify_chains(starts: DataFrame, atoms: DataFrame) -> DataFrame:
    """Errors of every chain: ``start, id, kind, via, target``, as a walk over CHAIN_LINKS from each start meets them.

    ``missing``: the start is not in the index; ``not_approved``: an atom on the chain is not stable;
    ``broken_crosslink``: a link on the chain has no target in the index. Cycles are walked once.
    """
    links = crosslinks(atoms, CHAIN_LINKS)
    known = atoms.select("id").where("id is not null").distinct()
    whole = links.join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    seen = reachable(starts, whole.select(F.col("id").alias("node"), F.col("target").alias("next"))).select(F.col("seed").alias("start"), F.col("node").alias("id"))
    none = F.lit(None).cast("string")
    missing = seen.where("start = id").join(known, "id", "left_anti").select("start", "id", F.lit("missing").alias("kind"), none.alias("via"), none.alias("target"))
    bad = atoms.where(~F.coalesce(normalise_status(F.col("status")) == "stable", F.lit(False))).select("id").distinct()
    unapproved = seen.join(bad, "id").select("start", "id", F.lit("not_approved").alias("kind"), none.alias("via"), none.alias("target"))
    broken = seen.join(broken_links(atoms, CHAIN_LINKS), "id").select("start", "id", F.lit("broken_crosslink").alias("kind"), "via", "target")
    return missing.unionByName(unapproved).unionByName(broken)
