"""History of changing attributes as insert-only satellites with lead-based end dates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import skew
from memlake.session import cut

#: Attributes whose rates are broadcast; where there are more, the split is an ordinary join.
MAX_ATTRIBUTES = 10_000


def change_rates(df: DataFrame, entity: str, attribute: str, fast: float | None = None) -> DataFrame:
    """Mean number of recorded changes per entity for each attribute, and its satellite.

    Attributes changing at least ``fast`` times an entity on average (default: the mean over all attributes of
    all entities) go to the ``fast`` satellite, the others to ``slow``. One row per attribute.
    """
    per = df.groupBy(attribute, entity).agg(F.count("*").alias("__n"))
    rate = per.groupBy(attribute).agg(F.sum("__n").alias("__n"), F.count("*").alias("__k"))
    if fast is None:
        whole = Window.partitionBy()  # one row per attribute
        limit = F.sum("__n").over(whole) / F.sum("__k").over(whole)
    else:
        limit = F.lit(fast)
    rate = rate.withColumns({"rate": F.col("__n") / F.col("__k"), "__limit": limit})
    return rate.select(attribute, "rate", F.when(F.col("rate") >= F.col("__limit"), "fast").otherwise("slow").alias("satellite"))


def split_by_rate(df: DataFrame, entity: str, attribute: str, rates: DataFrame) -> dict[str, DataFrame]:
    """``df`` cut into the rows of fast and those of slow attributes (see ``change_rates``); attributes without a rate are slow."""
    fast = rates.where("satellite = 'fast'").select(F.col(attribute).alias("__fast"))
    held = fast.limit(MAX_ATTRIBUTES + 1).collect()
    fast = cut(fast) if len(held) > MAX_ATTRIBUTES else F.broadcast(df.sparkSession.createDataFrame(held, fast.schema))
    same = F.col(attribute).eqNullSafe(F.col("__fast"))
    return {"fast": df.join(fast, same, "left_semi"), "slow": df.join(fast, same, "left_anti")}


@dataclass
class History:
    """The fast and the slow satellite of the same entities, each a table of its own."""

    fast: "Satellite"
    slow: "Satellite"

    def table(self) -> DataFrame:
        """The rows of both, with the ``satellite`` they are in."""
        parts = [s.table.drop("__bucket").withColumn("satellite", F.lit(name)) for name, s in (("fast", self.fast), ("slow", self.slow))]
        return parts[0].unionByName(parts[1])

    def view(self) -> DataFrame:
        """The versions of both, see ``Satellite.view``."""
        return self.fast.view().unionByName(self.slow.view())


def history(
    df: DataFrame, entity: str, attribute: str, value: str, start: str, end: str, recorded: str, tie: str,
    rows_per_task: int = skew.ROWS_PER_TASK, probe: DataFrame | None = None, fast: float | None = None,
) -> History:
    """Attribute history in two insert-only satellites, attributes split by change rate; arguments as of ``satellites``.

    Rates and hot keys come from one count per entity and attribute over ``probe`` (default: ``df``). The fast
    satellite is usually the smaller table of the two with most of the loads, so that a load rarely touches the slow one.
    """
    keys = [entity, attribute]
    counted = (df if probe is None else probe).where(F.col(start).isNotNull()).select(*keys, F.unix_micros(start).alias("__s"))
    rates = change_rates(counted, entity, attribute, fast)
    hot = skew.find_hot(counted, keys, "__s", rows_per_task)
    parts = split_by_rate(df, entity, attribute, rates)
    made = {name: satellites(rows, entity, attribute, value, start, end, recorded, tie, rows_per_task, hot=hot, known=True) for name, rows in parts.items()}
    return History(made["fast"], made["slow"])


def appended(satellite: DataFrame, load: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """What a load appends to a stored satellite: ``keys, value, hash_diff, load_us``; nothing stored is changed.

    ``satellite``: rows appended so far. ``load``: a snapshot or updates, one row per key, valid from the timestamp
    ``at``, none older than the stored ones. A row is appended where the hash-diff differs from the key's latest stored
    one, or the key is new; a null ``value`` is a value like any other. Keys the load does not name go on.
    """
    last = satellite.groupBy(*keys).agg(F.max_by("hash_diff", "load_us").alias("__last"), F.lit(True).alias("__known"))
    new = load.select(*keys, F.col(value).alias("value"), hash_diff(F.col(value)).alias("hash_diff"), F.unix_micros(at).alias("load_us"))
    met = new.join(last.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__last", "__known"), reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]), "left")
    return met.where(F.col("__known").isNull() | ~F.col("hash_diff").eqNullSafe(F.col("__last"))).select(*keys, "value", "hash_diff", "load_us")


def hash_diff(value: Column) -> Column:
    """SHA-256 of a value, null told apart from any text."""
    return F.sha2(F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n")), 256)


@dataclass
class Satellite:
    """Appended rows ``entity, attribute, value, hash_diff, load_us``; a null ``hash_diff`` closes a value."""

    table: DataFrame
    keys: list[str]
    hot: skew.HotKeys | None

    def view(self) -> DataFrame:
        """Versions with end dates by ``lead``: ``entity, attribute, value, hash_diff, from_us, to_us`` (null: still valid)."""
        ended = skew.neighbour(self.table, self.keys, "load_us", F.col("load_us"), "to_us", self.hot, ahead=True)
        return ended.where("hash_diff is not null").select(*self.keys, "value", "hash_diff", F.col("load_us").alias("from_us"), "to_us")


def satellites(
    df: DataFrame, entity: str, attribute: str, value: str, start: str, end: str, recorded: str, tie: str,
    rows_per_task: int = skew.ROWS_PER_TASK, probe: DataFrame | None = None, hot: skew.HotKeys | None = None, known: bool = False,
) -> Satellite:
    """Insert-only satellite rows: ``entity, attribute, value, hash_diff, load_us``.

    Of rows with equal entity, attribute and ``start`` only the latest ``recorded``
    counts (equal there too: the greater ``tie``). A value holds from its ``start`` to
    the next one's start or to its own ``end``, whichever comes first; where it ends
    before the next begins, a row with a null ``hash_diff`` closes it. A row is appended
    only when its hash-diff differs from the row before, so equal values without time
    between them stay one version. Rows with a null ``start``, or an ``end`` not after
    it, are left out; a null ``value`` is a value like any other. Null entities and
    attributes form keys of their own.

    Hot keys (above ``rows_per_task`` rows) are cut into time buckets, see ``skew``. ``probe`` may
    name a table with both keys and ``start`` that is cheaper to count than ``df`` and holds at
    least its rows; hot keys are then found in it. With ``known``, ``hot`` has them already.
    """
    keys = [entity, attribute]
    rows = df.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).select(
        *keys, F.col(value).alias("__value"), F.unix_micros(start).alias("__s"), F.unix_micros(end).alias("__e"), F.col(recorded).alias("__r"), F.col(tie).alias("__t")
    )
    if not known:
        hot = skew.find_hot(rows if probe is None else probe.select(*keys, F.unix_micros(start).alias("__s")), keys, "__s", rows_per_task)
    if hot:
        rows = hot.bucketed(rows, "__s")
    parts = [*keys, "__bucket"] if hot else keys
    # every window below runs over these partitions, so one shuffle serves them all
    local = rows.repartition(*[F.col(k) for k in parts])
    one = local.groupBy(*parts, "__s").agg(F.max_by(F.struct("__value", "__e"), F.struct(F.col("__r").isNotNull(), "__r", "__t")).alias("__x"))
    one = one.select(*parts, "__s", F.col("__x")["__value"].alias("__value"), F.col("__x")["__e"].alias("__e"))
    one = skew.neighbour(one, keys, "__s", F.col("__s"), "__next", hot, ahead=True)
    begun = F.struct(
        F.col("__s").alias("load_us"), F.col("__value").alias("value"), hash_diff(F.col("__value")).alias("hash_diff")
    )
    null = F.lit(None).cast("string")
    closed = F.when(
        F.col("__e").isNotNull() & (F.col("__next").isNull() | (F.col("__e") < F.col("__next"))),
        F.struct(F.col("__e").alias("load_us"), null.alias("value"), null.alias("hash_diff")),
    )
    events = one.select(*parts, F.explode(F.array_compact(F.array(begun, closed))).alias("ev")).select(*parts, "ev.*")
    events = skew.neighbour(events, keys, "load_us", F.col("hash_diff"), "__before", hot, ahead=False)
    kept = events.where(~F.col("hash_diff").eqNullSafe(F.col("__before")))
    return Satellite(kept.select(*parts, "value", "hash_diff", "load_us"), keys, hot)
