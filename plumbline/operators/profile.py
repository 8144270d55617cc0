"""Profiles: rows, types, nulls, NaN and distinct values of each column, by one aggregate over the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which distinct values are counted exactly; sample rows.
EXACT_ROWS, SAMPLE_ROWS = 1_000_000, 20
#: Distinct counts in one aggregate: each multiplies the rows of its Expand.
DISTINCTS = 8


def is_missing(df: DataFrame, name: str, nan: bool = False) -> Column:
    """Null, and NaN too where it is asked for."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if nan and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def count_columns(df: DataFrame) -> DataFrame:
    """One row: rows, and for the i-th column nulls_i and nan_i."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        out.append(F.count_if(c.isNull()).alias(f"nulls_{i}"))
        out.append((F.count_if(F.isnan(c)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")).alias(f"nan_{i}"))
    return df.agg(*out)


def profile(df: DataFrame, distinct: bool = True, approximate: bool = False) -> DataFrame:
    """A row (position, column, dtype, rows, null_count, nan_count, n_unique) for each column; nulls aren't a value.

    n_unique is exact or, with approximate, by HyperLogLog; null where it isn't counted or values can't be compared.
    """
    fields = df.schema.fields
    entries = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("rows"), F.col(f"nulls_{i}").alias("null_count"), F.col(f"nan_{i}").alias("nan_count")) for i, f in enumerate(fields)]
    counts = count_columns(df).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    if not distinct:
        return counts.withColumn("n_unique", F.lit(None).cast("long"))
    able = [(i, f) for i, f in enumerate(fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    count = F.approx_count_distinct if approximate else F.count_distinct
    found = None
    for at in range(0, len(able), DISTINCTS):
        some = able[at : at + DISTINCTS]
        row = df.agg(*[count(F.col(f"`{f.name}`")).alias(f"u_{i}") for i, f in some])
        part = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"u_{i}").alias("n_unique")) for i, _ in some])).alias("e")).select("e.*")
        found = part if found is None else found.union(part)
    return counts.join(F.broadcast(found), "position", "left") if found is not None else counts.withColumn("n_unique", F.lit(None).cast("long"))


#: Bits of a sketch's registers: an estimate of its distinct values is off by 1.04 / sqrt(2 ** SKETCH_BITS) (one standard
#: deviation: 1.6 %), and a sketch takes 4 KB at most.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
_SKETCHED = (T.StringType, T.BinaryType, T.IntegerType, T.LongType)


def _sketchable(df: DataFrame, name: str) -> Column | None:
    """A column as a type that sketches take: others by their text; nothing for maps and variants."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, _SKETCHED):
        return c
    if isinstance(kind, (T.MapType, T.VariantType)):
        return None
    return F.to_json(F.struct(c)) if isinstance(kind, (T.ArrayType, T.StructType)) else c.cast("string")


def sketches(df: DataFrame) -> DataFrame:
    """(column, rows, null_count, sketch) for each column, by one aggregate: profiles that can be added up.

    The sketch (HyperLogLog) of a column's values is null where they can't be compared.
    """
    made = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        c = _sketchable(df, name)
        made.append(F.count_if(F.col(f"`{name}`").isNull()).alias(f"n{i}"))
        made.append((F.lit(None).cast("binary") if c is None else F.hll_sketch_agg(c, F.lit(SKETCH_BITS))).alias(f"s{i}"))
    row = df.agg(*made)
    entries = [F.struct(F.lit(name).alias("column"), F.col("rows"), F.col(f"n{i}").alias("null_count"), F.col(f"s{i}").alias("sketch")) for i, name in enumerate(df.columns)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def united(parts: DataFrame) -> DataFrame:
    """The sketches of batches, steps or days, any number of them, as one row (column, rows, null_count, n_unique) for each column.

    Rows and nulls are exact sums; n_unique is an estimate with a standard deviation of SKETCH_ERROR, of one or many parts alike.
    """
    return parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"), F.when(F.count("sketch") > 0, F.hll_sketch_estimate(F.hll_union_agg("sketch"))).alias("n_unique"))


def sample_rows(df: DataFrame, order_by: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order_by).limit(n)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
