"""Joins with suffixes, and what a join does to the rows of its inputs.

The statistics come from the counts of each key on both sides: inputs are counted by key before they meet, so the
diagnosis of an exploding join never makes its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = list[str]


def merge(left: DataFrame, right: DataFrame, on: Keys | None = None, left_on: Keys | None = None, right_on: Keys | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """A join on equal keys (all common columns by default). Other columns that both sides have get suffixes.

    Nulls match nothing, or each other with null_safe. how: inner, left, right, outer, cross, semi, anti.
    """
    if how == "cross":
        lk, rk = [], []
    elif left_on or right_on:
        lk, rk = list(left_on or []), list(right_on or [])
    else:
        lk = rk = list(on or [c for c in left.columns if c in right.columns])
    if not lk and how != "cross":
        raise ValueError("no common columns to join on")
    if len(lk) != len(rk):
        raise ValueError("as many keys are needed on the left as on the right")
    both = {a for a, b in zip(lk, rk, strict=True) if a == b}
    clash = (set(left.columns) & set(right.columns)) - both
    l = left.select(*[F.col(f"`{c}`").alias(f"l_{i}") for i, c in enumerate(left.columns)])
    r = right.select(*[F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(right.columns)])
    at_l, at_r = {c: f"l_{i}" for i, c in enumerate(left.columns)}, {c: f"r_{i}" for i, c in enumerate(right.columns)}
    pairs = [(F.col(at_l[a]), F.col(at_r[b])) for a, b in zip(lk, rk, strict=True)]
    if how == "cross":
        joined = l.crossJoin(r)
    else:
        joined = l.join(r, reduce(Column.__and__, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]), {"semi": "left_semi", "anti": "left_anti", "outer": "full"}.get(how, how))
    out = []
    for c in left.columns:
        own = F.col(at_l[c])
        if c in both and how in ("right", "outer"):
            own = F.coalesce(own, F.col(at_r[c]))
        out.append(own.alias(c + suffixes[0] if c in clash and how not in ("semi", "anti") else c))
    if how not in ("semi", "anti"):
        out += [F.col(at_r[c]).alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in both]
    return joined.select(*out)


def _counted(df: DataFrame, keys: Keys, name: str) -> DataFrame:
    return df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(name))


def join_stats(left: DataFrame, right: DataFrame, left_on: Keys, right_on: Keys | None = None, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """One row of what a join does: rows, explosion, cardinality, matched and unmatched rows, duplicate and null keys.

    cardinality says on which sides keys repeat (a null is a key value); suggested_validate is what to demand of the
    join, validate_passes whether it holds now.
    """
    right_on = right_on or left_on
    names = [f"k{i}" for i in range(len(left_on))]
    a, b = _counted(left, left_on, "nl"), _counted(right, right_on, "nr")
    any_null = reduce(Column.__or__, [F.col(k).isNull() for k in names])
    a, b = a.withColumn("zl", any_null), b.withColumn("zr", any_null)  # before the join, which makes nulls of its own
    same = reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in names])
    joined = a.join(b, same, "full").select(F.coalesce("nl", F.lit(0)).alias("nl"), F.coalesce("nr", F.lit(0)).alias("nr"), F.coalesce("zl", "zr").alias("null_key"))
    match = (F.col("nl") > 0) & (F.col("nr") > 0) & (F.lit(True) if null_safe else ~F.col("null_key"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    inner = F.when(match, F.col("nl") * F.col("nr")).otherwise(0)
    sums = joined.agg(
        total("nl").alias("rows_left"),
        total("nr").alias("rows_right"),
        total(inner).alias("rows_inner"),
        total(F.when(match, F.col("nl")).otherwise(0)).alias("left_matched"),
        total(F.when(match, F.col("nr")).otherwise(0)).alias("right_matched"),
        total(F.greatest(F.col("nl") - 1, F.lit(0))).alias("left_duplicate_keys"),
        total(F.greatest(F.col("nr") - 1, F.lit(0))).alias("right_duplicate_keys"),
        total(F.when(F.col("null_key"), F.col("nl")).otherwise(0)).alias("left_null_keys"),
        total(F.when(F.col("null_key"), F.col("nr")).otherwise(0)).alias("right_null_keys"),
    )
    sums = sums.withColumn("left_only", F.col("rows_left") - F.col("left_matched")).withColumn("right_only", F.col("rows_right") - F.col("right_matched"))
    extra = {"inner": F.lit(0), "left": F.col("left_only"), "right": F.col("right_only"), "outer": F.col("left_only") + F.col("right_only")}[how]
    unique_l, unique_r = F.col("left_duplicate_keys") == 0, F.col("right_duplicate_keys") == 0
    one_to_many = unique_l & F.lit(how in ("right", "outer"))
    return (
        sums.withColumn("rows_out", F.col("rows_inner") + extra)
        .withColumn("explosion_factor", F.when(F.col("rows_left") > 0, F.round(F.col("rows_out") / F.col("rows_left"), 4)))
        .withColumn("cardinality", F.concat(F.when(unique_l, "1").otherwise("m"), F.lit(":"), F.when(unique_r, "1").otherwise("m")))
        .withColumn("suggested_validate", F.when(unique_r, "m:1").when(one_to_many, "1:m").otherwise("m:1"))
        .withColumn("validate_passes", unique_r | one_to_many)
        .drop("rows_inner")
    )


def unmatched(df: DataFrame, other: DataFrame, keys: Keys, other_keys: Keys | None = None, null_safe: bool = False) -> DataFrame:
    """The rows of df whose key other doesn't have."""
    return merge(df, other.select(*(other_keys or keys)).distinct(), left_on=keys, right_on=other_keys or keys, how="anti", null_safe=null_safe)


def duplicate_key_rows(df: DataFrame, keys: Keys) -> DataFrame:
    """The rows that share their key with another row; a null is a key value.

    Repeated keys are found by an aggregate and joined back, so that the rows of one key need not meet in one task.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    often = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(often, reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]), "left_semi")


def null_key_rows(df: DataFrame, keys: Keys) -> DataFrame:
    return df.where(reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in keys]))


def key_type_mismatches(left: DataFrame, right: DataFrame, left_on: Keys, right_on: Keys | None = None) -> list[tuple[str, str, str, str]]:
    """(left key, type, right key, type) where the types differ."""
    pairs = zip(left_on, right_on or left_on, strict=True)
    return [(a, left.schema[a].dataType.simpleString(), b, right.schema[b].dataType.simpleString()) for a, b in pairs if left.schema[a].dataType != right.schema[b].dataType]


def suffix_collisions(left: DataFrame, right: DataFrame, out: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")) -> list[str]:
    before = {*left.columns, *right.columns}
    return sorted(c for c in out.columns if c not in before and any(s and c.endswith(s) for s in suffixes))


def concat(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Columns side by side, by key."""
    return merge(left, right, on=keys, how="outer")


def columns_not_in_all(frames: list[DataFrame]) -> list[str]:
    sets = [set(f.columns) for f in frames]
    return sorted(set.union(*sets) - set.intersection(*sets))
