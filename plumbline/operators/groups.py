"""Sizes of groups, their histogram, and aggregates that keep rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.positions import ordered, quoted


def _named(c: str | Column) -> Column:
    """A column by its whole name, dots included."""
    return F.col(quoted(c)) if isinstance(c, str) else c


def group_sizes(df: DataFrame, keys: list[str], dropna: bool = False) -> DataFrame:
    """(keys, size); with dropna, without groups that have a null key."""
    rows = df.dropna(subset=keys) if dropna else df
    return rows.groupBy(*map(_named, keys)).agg(F.count(F.lit(1)).alias("size"))


def group_stats(df: DataFrame, keys: list[str], dropna: bool = False) -> DataFrame:
    """One row (n_groups, size_min, size_median, size_max)."""
    return group_sizes(df, keys, dropna).agg(F.count(F.lit(1)).alias("n_groups"), F.min("size").alias("size_min"), F.median("size").alias("size_median"), F.max("size").alias("size_max"))


def size_histogram(df: DataFrame, keys: list[str], bins: int = 10, dropna: bool = False) -> DataFrame:
    """(bin, bin_start, bin_end, n_groups): min(bins, max - min + 1) bins of equal width, closed on the right."""
    sizes = group_sizes(df, keys, dropna)
    ends = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).withColumn("bins", F.least(F.lit(bins), F.col("hi") - F.col("lo") + 1))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = F.ceil((F.col("size") - F.col("lo")) * F.col("bins") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))) - 1
    number = F.least(F.col("bins") - 1, F.greatest(F.lit(0), at)).cast("int")
    counted = sizes.crossJoin(F.broadcast(ends)).withColumn("bin", number).groupBy("bin", "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("n_groups"))
    start, end = F.round(F.col("lo") + F.col("bin") * width, 2), F.round(F.col("lo") + (F.col("bin") + 1) * width, 2)
    return counted.select("bin", start.alias("bin_start"), end.alias("bin_end"), "n_groups")


def transform(df: DataFrame, keys: list[str], **made: Column) -> DataFrame:
    """df with aggregates of each row's group; null keys are a group.

    The aggregates are made on their own, partly where rows are read, and joined back: a join that Spark can split where
    one key holds a large share of the rows, which it can't do with a window over the key.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    found = df.groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[c.alias(f"__v{i}") for i, c in enumerate(made.values())])
    same = reduce(Column.__and__, [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    values = dict(zip(made, [f"__v{i}" for i in range(len(made))], strict=True))
    old = [F.col(values.get(c) or quoted(c)).alias(c) for c in df.columns]
    return df.join(found, same, "left").select(*old, *[F.col(v).alias(k) for k, v in values.items() if k not in df.columns])


def running(df: DataFrame, keys: list[str], order_by: list, **made: Column) -> DataFrame:
    """df with aggregates from the start of the group to the row."""
    w = Window.partitionBy(*map(_named, keys)).orderBy(*map(_named, order_by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({k: c.over(w) for k, c in made.items()})


def cumcount(df: DataFrame, keys: list[str], order_by: list, name: str, ascending: bool = True) -> DataFrame:
    """df with the number of rows of the group before each row in the given order, or after it."""
    w = Window.partitionBy(*map(_named, keys)).orderBy(*ordered(order_by))
    before = F.row_number().over(w) - 1
    return df.withColumn(name, before if ascending else F.count(F.lit(1)).over(Window.partitionBy(*map(_named, keys))).cast("int") - 1 - before)


def idx(df: DataFrame, keys: list[str], label: str, by: str, most: bool = True) -> DataFrame:
    """(keys, label): that of the row of each group with the greatest (or smallest) value, of ties the smallest label; rows without a value don't count."""
    rows = df.where(F.col(quoted(by)).isNotNull())
    value, name = F.col(quoted(by)), F.col(quoted(label))
    least = rows.groupBy(*[F.col(quoted(k)) for k in keys]).agg((F.max if most else F.min)(value).alias("__best"))
    met = rows.join(least, [*keys]).where(value == F.col("__best"))
    return met.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.min(name).alias(label))


def rank(df: DataFrame, keys: list[str], by: str, name: str, method: str = "average", ascending: bool = True) -> DataFrame:
    """df with the rank of `by` in its group: average, min, max, dense or first (of tied rows any order); nulls have none and don't count."""
    value = _named(by)
    w = Window.partitionBy(*map(_named, keys)).orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*map(_named, keys), value))
    least = F.rank().over(w)
    place = {"average": (2 * least + ties - 1) / 2.0, "min": least, "max": least + ties - 1, "dense": F.dense_rank().over(w), "first": F.row_number().over(w)}[method]
    return df.withColumn(name, F.when(value.isNotNull(), place))


def filter_groups(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """The rows of the groups whose aggregates meet the condition.

    The groups that do are found by an aggregate and joined back, so that the rows of one key need not meet in one task.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    found = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]).agg(condition.alias("__kept")).where("__kept").drop("__kept")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(found, same, "left_semi")
