"""Vector arithmetic on array columns, in doubles."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length, of which 1e-12 more is assumed."""
    return F.transform(a, lambda x: x / (norm(a) + 1e-12))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clamp01(v: Column) -> Column:
    """Within 0 and 1; not a number is 0."""
    return F.when(F.isnan(v), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def rescored(child: Column, parent: Column, alpha: float = 0.7) -> Column:
    """The parent's share alpha and the child's rest."""
    return alpha * parent + (1 - alpha) * child


def valid(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x))
