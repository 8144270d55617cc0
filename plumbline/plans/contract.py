"""A contract of a frame: types, nulls, keys, values and rows, checked by one aggregate, with the rows that break it.

Each rule is compiled into a part of one aggregate over the frame; uniqueness of keys adds one aggregate of the keys. What
the rules of a pipeline's frames come to is a table of violations; the rows themselves are found only when asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.positions import quoted

_SCHEMA = "rule string, subject string, violations long"


@dataclass(frozen=True)
class Contract:
    """What a frame has to be. Of `types` every column must be there with that type (others may be there too, unless `closed`)."""

    types: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: Name of a rule to its condition; a null condition breaks it.
    values: dict[str, str] = field(default_factory=dict)
    least_rows: int = 0
    most_rows: int | None = None
    closed: bool = False

    @classmethod
    def of(cls, df: DataFrame, unique: Iterable[Iterable[str]] = ()) -> Contract:
        """The contract that df's schema makes: its columns and types, and no nulls where it says so."""
        return cls(dict(df.dtypes), tuple(f.name for f in df.schema.fields if not f.nullable), tuple(tuple(u) for u in unique), closed=True)


def _schema_rules(df: DataFrame, c: Contract) -> list[tuple[str, str, int]]:
    """Rules that the schema alone decides."""
    kinds = dict(df.dtypes)
    out = [("column", name, int(name not in kinds)) for name in c.types]
    out += [("type", f"{name} {kind}", int(kinds[name] != kind)) for name, kind in c.types.items() if name in kinds]
    if c.closed:
        out += [("closed", name, 1) for name in kinds if name not in c.types]
    return out


def _missing(df: DataFrame, c: Contract) -> set[str]:
    return {*c.not_null, *(k for u in c.unique for k in u)} - set(df.columns)


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, subject, violations), a row for each rule, 0 where it holds.

    not_null counts nulls, values the rows whose condition isn't true, unique the rows beyond the first of a key (null keys
    are keys), rows what the number of rows is off by. Rules on columns that aren't there count as one violation.
    """
    spark, absent = df.sparkSession, _missing(df, contract)
    rows = F.count(F.lit(1))
    made: list[tuple[str, str, Column]] = [("rows", f"at least {contract.least_rows}", F.greatest(F.lit(contract.least_rows) - rows, F.lit(0)))]
    if contract.most_rows is not None:
        made.append(("rows", f"at most {contract.most_rows}", F.greatest(rows - F.lit(contract.most_rows), F.lit(0))))
    made += [("not_null", n, F.count_if(F.col(quoted(n)).isNull()) if n not in absent else F.lit(1)) for n in contract.not_null]
    made += [("values", name, F.count_if(~F.coalesce(F.expr(test), F.lit(False)))) for name, test in contract.values.items()]
    one = df.agg(rows.alias("rows"), *[c.cast("long").alias(f"v{i}") for i, (_, _, c) in enumerate(made)])
    entries = [F.struct(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), F.col(f"v{i}").alias("violations")) for i, (rule, subject, _) in enumerate(made)]
    out = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    for keys in contract.unique:
        if absent & {*keys}:
            out = out.union(spark.createDataFrame([("unique", ", ".join(keys), 1)], _SCHEMA))
        else:
            repeats = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
            out = out.union(repeats.select(F.lit("unique"), F.lit(", ".join(keys)), "violations"))
    known = _schema_rules(df, contract)
    return spark.createDataFrame(known, _SCHEMA).union(out) if known else out


def violating_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows of df that break a rule on rows, with `broken`, the rules: not_null, values, and unique (all rows of a repeated key).

    Repeated keys are found by an aggregate and joined back, so the rows of one key need not meet in one task.
    """
    absent = _missing(df, contract)
    tests = [(f"not_null {n}", F.col(quoted(n)).isNull()) for n in contract.not_null if n not in absent]
    tests += [(f"values {name}", ~F.coalesce(F.expr(test), F.lit(False))) for name, test in contract.values.items()]
    rows = df.withColumn("broken", F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]) if tests else F.array().cast("array<string>"), lambda x: x.isNotNull()))
    for u, keys in enumerate(k for k in contract.unique if not absent & {*k}):
        names = [f"__k{u}_{i}" for i in range(len(keys))]
        often = df.groupBy(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n").withColumn(f"__often{u}", F.lit(True))
        same = reduce(Column.__and__, [F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
        broken = F.when(F.col(f"__often{u}"), F.array_append("broken", F.lit(f"unique {', '.join(keys)}"))).otherwise(F.col("broken"))
        rows = rows.join(often, same, "left").withColumn("broken", broken).drop(*names, f"__often{u}")
    return rows.where(F.size("broken") > 0)
