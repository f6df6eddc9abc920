"""The engine's operators: each a declaration that Catalyst plans.

None collects, loops over rows or hints a physical join.  Which side is
broadcast, and where skewed partitions are split, is left to size estimates
and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Mapping[str, str]


def scan(df: DataFrame, columns: Sequence[str], where: Column | str | None = None) -> DataFrame:
    """Named columns of the rows that pass."""
    return (df if where is None else df.where(where)).select(*columns)


def compute(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def _on(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    on = [left[a] == right[b] for a, b in keys.items()]
    out = on[0]
    for c in on[1:]:
        out &= c
    return out


def lookup(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Inner equi-join on one key or several."""
    return left.join(right, _on(left, right, keys), "inner")


def keep(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of left with a partner: semi-join."""
    return left.join(right, _on(left, right, keys), "left_semi")


def drop(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of left without a partner: NOT EXISTS.  A null key has none."""
    return left.join(right, _on(left, right, keys), "left_anti")


def not_in(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """NOT IN with its nulls: a null on the right excludes all, a null on the left is unknown unless right is empty.

    An anti-join on the key, which may shuffle, and one row of counts; a join
    that is aware of nulls would broadcast the right side whatever its size.
    """
    seen = right.agg(F.count("*").alias("n"), F.count(b).alias("known"))
    empty, whole = seen.select(F.col("n") == 0).scalar(), seen.select(F.col("n") == F.col("known")).scalar()
    return left.join(right, left[a] == right[b], "left_anti").where((left[a].isNotNull() & whole) | empty)


def with_other(left: DataFrame, right: DataFrame, same: Keys, other: tuple[str, str], exists: bool = True) -> DataFrame:
    """Rows of left for which right has (or lacks) a row with the same key but another value."""
    on = _on(left, right, same) & (left[other[0]] != right[other[1]])
    return left.join(right, on, "left_semi" if exists else "left_anti")


def optional(left: DataFrame, right: DataFrame, keys: Keys, where: Column | None = None) -> DataFrame:
    """Left outer join; `where` restricts partners, not rows of left."""
    on = _on(left, right, keys)
    return left.join(right, on if where is None else on & where, "left")


def any_of(left: DataFrame, right: DataFrame, keys: Keys, conditions: Sequence[Column]) -> DataFrame:
    """Join where one of several conjunctions over both sides holds."""
    out = conditions[0]
    for c in conditions[1:]:
        out |= c
    return left.join(right, _on(left, right, keys) & out, "inner")


def money(c: Column) -> Column:
    """Sum of decimals, shown as double: the same whatever the order of additions."""
    return F.sum(c).cast("double")


def mean(c: Column) -> Column:
    """Exact sum by count, null without rows."""
    return F.when(F.count(c) > 0, F.sum(c).cast("double") / F.count(c))


def ratio(part: Column, whole: Column) -> Column:
    """Ratio of two sums, null where the whole is null or zero."""
    return F.sum(part).cast("double") / F.nullif(F.sum(whole).cast("double"), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def aggregate(df: DataFrame, by: Sequence[str] = (), having: Column | str | None = None, **sums: Column) -> DataFrame:
    """Scalar or keyed aggregates, filtered by `having`."""
    out = df.groupBy(*by).agg(*(c.alias(n) for n, c in sums.items()))
    return out if having is None else out.where(having)


def distribution(df: DataFrame, by: Sequence[str], size: Column, name: str = "size", count: str = "n") -> DataFrame:
    """How many groups have each size: an aggregate of an aggregate."""
    return df.groupBy(*by).agg(size.alias(name)).groupBy(name).agg(F.count("*").alias(count))


def above_share(df: DataFrame, by: str, value: Column, share: float, name: str = "value") -> DataFrame:
    """Groups whose sum exceeds a share of the sum of all, which is a scalar subquery over the groups' exact sums."""
    sums = df.groupBy(by).agg(F.sum(value).alias(name))
    bound = sums.agg((money(F.col(name)) * share).alias("bound"))
    return sums.select(by, F.col(name).cast("double").alias(name)).where(F.col(name) > bound.scalar())


def extreme(df: DataFrame, by: str, value: str, least: bool = True) -> DataFrame:
    """Rows whose value is the least (or greatest) of their group."""
    best = df.groupBy(F.col(by).alias("_by")).agg((F.min if least else F.max)(value).alias("_best"))
    return df.join(best, (F.col(by) == F.col("_by")) & (F.col(value) == F.col("_best"))).drop("_by", "_best")


def below_mean(df: DataFrame, by: str, value: str, factor: float) -> DataFrame:
    """Rows whose value is under a factor of their group's mean."""
    means = df.groupBy(F.col(by).alias("_by")).agg((mean(F.col(value)) * factor).alias("_mean"))
    return df.join(means, (F.col(by) == F.col("_by")) & (F.col(value).cast("double") < F.col("_mean"))).drop("_by", "_mean")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n in an order that a key makes total."""
    return df.orderBy(*order).limit(n)
