"""Vector functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once: inside a lambda a column expression is evaluated for every element, a lambda's variable is not."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is all zero. Unequal dimensions raise an error."""
    length = norm(a) * norm(b)
    checked = F.when(F.size(a) == F.size(b), F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length))
    return F.when(F.size(a) == F.size(b), checked).otherwise(F.raise_error(F.lit("vectors of unequal dimension")).cast("double"))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; all-zero vectors unchanged."""
    scaled = lambda u, n: F.when(n == 0, F.transform(u, lambda x: x.cast("double"))).otherwise(F.transform(u, lambda x: x.cast("double") / n))
    return let(v, lambda u: let(norm(u), lambda n: scaled(u, n)))


def to_text(v: Column) -> Column:
    """``[1.0,2.0]`` as the vector columns of databases read it."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(x: Column) -> Column:
    """The numbers of such a text; null where it is none."""
    return F.from_json(x, "array<double>")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedder: SHA-256 of the lower-cased trimmed text and a block number, as unsigned 16-bit numbers scaled to [-1, 1], normalised."""
    blocks = lambda base: F.concat(*[F.sha2(F.concat(base, F.lit(f"::{i}")), 256) for i in range((dim + 15) // 16)])
    number = lambda h, j: F.conv(F.substring(h, j * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535 * 2 - 1
    raw = let(let(F.lower(F.trim(text)), blocks), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: number(h, j)))
    return F.when(text.isNotNull(), l2_normalize(raw))
