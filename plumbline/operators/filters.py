"""What a filter keeps and drops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.positions import quoted


def filter_stats(df: DataFrame, condition: Column) -> DataFrame:
    """One row (rows_in, rows_out, rows_dropped, pct_kept) in one pass; a null condition drops the row."""
    kept = F.count_if(F.coalesce(condition, F.lit(False)))
    out = df.agg(F.count(F.lit(1)).alias("rows_in"), kept.alias("rows_out"))
    return out.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out")).withColumn("pct_kept", F.when(F.col("rows_in") > 0, F.round(100.0 * F.col("rows_out") / F.col("rows_in"), 2)))


def dropped_rows(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that filter(condition) leaves out."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def numbered(df: DataFrame, keys: list[str], order_by: list, name: str = "__n") -> DataFrame:
    named = lambda c: F.col(quoted(c)) if isinstance(c, str) else c
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*map(named, keys)).orderBy(*map(named, order_by))))


#: Which rows of a key stay: tests on the row's number and on the rows of its key.
_KEPT = {"first": "__n = 1", "last": "__n = __of", "none": "__of = 1"}


def _marked(df: DataFrame, keys: list[str], order_by: list, keep: str) -> DataFrame:
    rows = numbered(df, keys, order_by)
    return rows if keep == "first" else rows.withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy(*[F.col(quoted(k)) for k in keys])))


def drop_duplicates(df: DataFrame, keys: list[str], order_by: list, keep: str = "first") -> DataFrame:
    """The first (or last) row of each key in the given order, or with "none" only the rows whose key occurs once.

    For the last row by names of columns the order is turned round, so that each task keeps one row of a key before any
    row moves; keys that occur once are found by an aggregate.
    """
    if keep == "last" and all(isinstance(c, str) for c in order_by):
        return numbered(df, keys, [F.col(quoted(c)).desc_nulls_last() for c in order_by]).where("__n = 1").drop("__n")
    if keep == "none":
        names = [f"__k{i}" for i in range(len(keys))]
        once = df.groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("__of")).where("__of = 1").drop("__of")
        return df.join(once, reduce(Column.__and__, [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]), "left_semi")
    return _marked(df, keys, order_by, keep).where(_KEPT[keep]).drop("__n", "__of")


def duplicates(df: DataFrame, keys: list[str], order_by: list, keep: str = "first") -> DataFrame:
    """The rows that drop_duplicates leaves out."""
    return _marked(df, keys, order_by, keep).where(f"NOT ({_KEPT[keep]})").drop("__n", "__of")


def _row_hash(df: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits of a row's values, by column name; nulls and where they stand count."""
    kinds = dict(df.dtypes)
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] else F.col(f"`{c}`") for c in columns]
    nulls = F.array(*[v.isNull() for v in values])
    return [F.xxhash64(F.lit(seed), nulls, *values) for seed in (1, 2)]


def lost_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(h1, h2, lost): rows of before that after has fewer of, by their hash; a row that occurs twice may be lost once.

    Both sides are put together before anything moves, as +1 and -1 for a row, and added up where they are read, so one
    shuffle moves a hash and a number for each distinct row of a task.
    """
    columns = [c for c in before.columns if c in after.columns]
    sides = []
    for df, sign in ((before, 1), (after, -1)):
        a, b = _row_hash(df, columns)
        sides.append(df.select(a.alias("h1"), b.alias("h2"), F.lit(sign).cast("long").alias("n")))
    return sides[0].union(sides[1]).groupBy("h1", "h2").agg(F.sum("n").alias("lost")).where("lost > 0")


def lost_rows(before: DataFrame, after: DataFrame, n: int | None = None) -> DataFrame:
    """The rows of before that are not in after, each as often as it was lost (n of them at most), whatever dropped them.

    after has columns of before; rows are told apart by these.
    """
    lost = lost_counts(before, after)
    columns = [c for c in before.columns if c in after.columns]
    a, b = _row_hash(before, columns)
    marked = before.withColumns({"__h1": a, "__h2": b})
    same = (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2"))
    if n is not None:
        # one row of each hash, as often as it was lost: no more than n rows of a hash ever meet
        few = marked.join(F.broadcast(lost.orderBy("h1", "h2").limit(n)), same)
        one = few.groupBy("h1", "h2", "lost").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in before.columns])).alias("row"))
        return one.select("row.*", F.explode(F.sequence(F.lit(1), F.least("lost", F.lit(n)))).alias("__n")).drop("__n").limit(n)
    order = Window.partitionBy("__h1", "__h2").orderBy("lost")
    return marked.join(lost, same).withColumn("__n", F.row_number().over(order)).where("__n <= lost").drop("__h1", "__h2", "h1", "h2", "lost", "__n")


def missing_rows(df: DataFrame, subset: list[str] | None = None, how: str = "any", thresh: int | None = None) -> DataFrame:
    """The rows that dropna leaves out; thresh: those with fewer values than that, whatever how says."""
    if thresh is not None:
        present = [F.col(f"`{c}`").isNotNull().cast("int") for c in subset or df.columns]
        return df.filter(sum(present, F.lit(0)) < thresh)
    tests = [F.col(f"`{c}`").isNull() for c in subset or df.columns]
    found = tests[0]
    for t in tests[1:]:
        found = found | t if how == "any" else found & t
    return df.filter(found)
