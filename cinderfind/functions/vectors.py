"""Vector functions as Columns over array<float|double>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, _wide(v)).otherwise(F.transform(_wide(v), lambda x: x / n))


def rounded(x: Column, places: int) -> Column:
    """A double rounded in binary, ties away from zero and the sign of zero kept, as SQL engines on C's round() do it.
    Spark's own round() goes by way of decimals, which have no negative zero."""
    y = x * F.lit(10.0**places)
    near = F.rint(y)
    return F.when(F.abs(y) - F.abs(near) == 0.5, near + F.signum(y)).otherwise(near) / F.lit(10.0**places)


def clip(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; 0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(clip(dot(a, b) / n))


def sound(v: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and finite components alone."""
    return F.coalesce((F.size(v) == dimension) & F.forall(_wide(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checked(v: Column, dimension: int) -> Column:
    """The vector, or an error for one that isn't sound."""
    return F.when(sound(v, dimension), v).otherwise(F.raise_error(F.lit(f"a vector isn't {dimension} finite numbers")))


def bucket(token: Column, dimension: int) -> Column:
    """The place of a token in a hashed bag of words."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dimension


def hash_embed(tokens: Column, dimension: int) -> Column:
    """Counts of tokens by bucket. It looks through all tokens for each bucket, which suits queries; operators.embed
    has the same for tables."""
    buckets = F.transform(tokens, lambda t: bucket(t, dimension))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
