"""Long, wide and flat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(ids, values or [c for c in df.columns if c not in ids], var_name, value_name)


#: Values of a column that may become columns without being given.
MOST_VALUES = 1000


def values_of(df: DataFrame, column: str) -> list:
    """The values of a column, sorted, without null: one job that brings MOST_VALUES + 1 of them at most; refused beyond."""
    found = [r[0] for r in df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct().limit(MOST_VALUES + 1).collect()]
    if len(found) > MOST_VALUES:
        raise ValueError(f"{column} has over {MOST_VALUES} values: give those that are to become columns")
    return sorted(found)


def pivot_table(df: DataFrame, index: list[str], columns: str, values: list, agg: Column) -> DataFrame:
    """One column for each of the given values of `columns`; giving them saves the job that would look for them."""
    return df.groupBy(*index).pivot(columns, values).agg(agg)


def pivot(df: DataFrame, index: list[str], columns: str, values: list, value: str) -> DataFrame:
    """As pivot_table, of single values; fails where an index and column have several."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot: several values for an index and column"))).otherwise(F.first(value))
    return df.groupBy(*index).pivot(columns, values).agg(one)


def stack(df: DataFrame, ids: list[str], values: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """As melt, without the rows that hold no value."""
    return melt(df, ids, values, var_name, value_name).where(F.col(value_name).isNotNull())


def transpose(df: DataFrame, label: str, labels: list, name: str = "variable") -> DataFrame:
    """A row for each column but `label`, whose given values become the columns."""
    return pivot(melt(df, [label], var_name=name, value_name="__value"), [name], label, labels, "__value")


def convert_dtypes(df: DataFrame) -> DataFrame:
    """Floating columns that hold whole numbers only, as long; one aggregate over the frame looks at them all."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    if not floats:
        return df
    fits = lambda c: F.col(f"`{c}`").cast("long").cast("double") == F.col(f"`{c}`")
    whole = df.agg(*[F.coalesce(F.bool_and(fits(c)), F.lit(True)).alias(f"c{i}") for i, c in enumerate(floats)]).first()
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for i, c in enumerate(floats) if whole[i]})


def crosstab(df: DataFrame, index: str, columns: str, values: list) -> DataFrame:
    """Rows of each pair of labels; null labels, of either column, count nowhere."""
    known = df.where(F.col(f"`{index}`").isNotNull() & F.col(f"`{columns}`").isNotNull())
    counts = known.groupBy(F.col(f"`{index}`")).pivot(f"`{columns}`", values).agg(F.count(F.lit(1)))
    return counts.select(f"`{index}`", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in counts.columns[1:]])


def get_dummies(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row for each element; of empty and null arrays, one with null."""
    return df.withColumn(column, F.explode_outer(column))


def reindex(df: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each label, null where df has none."""
    return labels.select(*keys).join(df, keys, "left")


def value_counts(df: DataFrame, column: str, dropna: bool = True, normalize: bool = False, sort: bool = False) -> DataFrame:
    """Rows of each value; sort: the most frequent first, of equally frequent ones the smaller value."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if sort:
        counts = counts.orderBy(F.col("count").desc(), F.col(f"`{column}`").asc_nulls_last())
    if not normalize:
        return counts
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, (F.col("count") / F.col("total")).alias("proportion"))


#: Buckets of a factor of two in the first of the histograms that look for a percentile, and into how many parts the next
#: ones cut a bucket. Three of them leave 16,384 different doubles in a bucket at most.
OCTAVE, CUTS = 64, 1 << 16


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], keys: list[str] | None = None) -> DataFrame:
    """One row for each group with a value: the keys, and for each name the exact percentile (column, fraction), interpolated.

    As Spark's `percentile` but for the last bit (low + part of the difference, as in SQL's quantile_cont), which holds all values of a group in one task. Here values are counted where they are,
    and histograms look for the wanted ranks: of each only the buckets that hold one go on and are cut again, by linear
    parts between their least and largest value, until the values themselves are ranked. What a task orders are the buckets
    of one histogram, however many rows there are.
    """
    keys = keys or []
    names = [f"k{i}" for i in range(len(keys))]
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    fractions = sorted({p for _, p in wanted.values()})
    group = [*names, "c"]
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.explode(values).alias("e")).select(*names, "e.c", "e.v")
    counts = rows.where("v IS NOT NULL").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    place = lambda p: F.lit(float(p)) * (F.col("total") - 1)

    def holding(parts: DataFrame, bucket: Column, within: list[str]) -> DataFrame:
        """(group, least, most, n, before, total) of the buckets that hold a wanted rank."""
        found = parts.groupBy(*within, bucket.alias("bucket")).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("n").alias("n"))
        if "total" not in within:
            found = found.withColumn("total", F.sum("n").over(Window.partitionBy(*group))).withColumn("start", F.lit(0))
        first = [c for c in within if c not in ("start", "total")]
        before = F.col("start") + F.sum("n").over(Window.partitionBy(*first).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        found = found.withColumn("before", before)
        holds = [(F.floor(place(p)) < F.col("before") + F.col("n")) & (F.ceil(place(p)) >= F.col("before")) for p in fractions]
        return found.where(reduce(lambda a, b: a | b, holds)).select(*group, "least", "most", "n", "before", "total")

    v, size = F.col("v"), F.floor(F.log2(F.abs("v")) * OCTAVE) + 100_000  # of all finite doubles: above 0
    infinite = F.lit(float("inf"))
    octave = F.when(F.isnan(v), 300_000).when(v == infinite, 250_000).when(v == -infinite, -250_000).when(v == 0, 0).when(v > 0, size).otherwise(-size)
    part = F.when(F.col("high") > F.col("low"), F.floor((v - F.col("low")) * CUTS / (F.col("high") - F.col("low")))).otherwise(0)
    found = holding(counts, octave, group)
    for bucket in (part, part, v):
        some = found.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("least").alias("low"), F.col("most").alias("high"), F.col("before").alias("start"), "total")
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
        parts = counts.join(some if keys else F.broadcast(some), reduce(lambda a, b: a & b, [*same, v >= F.col("low"), v <= F.col("high")]))
        found = holding(parts, bucket, [*group, "low", "high", "start", "total"])
    out = []
    for name, (column, p) in wanted.items():
        mine = F.col("c") == columns.index(column)
        at = lambda rank, mine=mine: F.max(F.when(mine & (rank >= F.col("before")) & (rank < F.col("before") + F.col("n")), F.col("least")))
        low, high = at(F.floor(place(p))), at(F.ceil(place(p)))
        over = F.max(F.when(mine, place(p) - F.floor(place(p))))
        under = F.max(F.when(mine, F.ceil(place(p)) - place(p)))
        between = F.when(F.abs(high - low) < infinite, low + (high - low) * over).otherwise(under * low + over * high)
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.groupBy(*names).agg(*out)


def describe(df: DataFrame, columns: list[str], keys: list[str] | None = None, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, percentiles and max of each column, as <column>_<what>; a percentile of 0.25 as p25."""
    out = []
    for c in columns:
        made = {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
        out += [v.alias(f"{c}_{k}") for k, v in made.items()]
    plain = df.groupBy(*(keys or [])).agg(*out)
    if not columns or not percentiles:
        return plain
    by = plain.columns[: len(keys or [])]
    ranked = exact_percentiles(df, {f"{c}_p{100 * p:g}": (c, p) for c in columns for p in percentiles}, keys)
    whats = ["count", "mean", "std", "min", *[f"p{100 * p:g}" for p in percentiles], "max"]
    return joined(plain, ranked, by).select(*[f"`{k}`" for k in by], *[f"`{c}_{what}`" for c in columns for what in whats])


def joined(groups: DataFrame, ranked: DataFrame, by: list[str]) -> DataFrame:
    """groups with the columns of exact_percentiles(), null for a group that has no value."""
    if not by:
        return groups.join(F.broadcast(ranked), F.lit(True), "left")
    same = [groups[f"`{k}`"].eqNullSafe(ranked[f"k{i}"]) for i, k in enumerate(by)]
    return groups.join(ranked, reduce(lambda a, b: a & b, same), "left").drop(*[f"k{i}" for i in range(len(by))])
