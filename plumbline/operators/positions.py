"""Positions of rows in a total order, however far in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from the start up to which every task may keep its first rows; beyond, they are found by position.
SHALLOW = 10_000
#: monotonically_increasing_id counts from here on in each partition.
_PARTITION = 1 << 33


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ordered(order_by: list[str | Column]) -> list[Column]:
    """Names as ascending with nulls last, expressions as they are."""
    return [F.col(quoted(c)).asc_nulls_last() if isinstance(c, str) else c for c in order_by]


def positions(df: DataFrame, order_by: list[str | Column], name: str = "position") -> DataFrame:
    """df with the place of each row, from 0, in the given order (of tied rows in any order).

    Rows are partitioned by range and sorted, in as many tasks as there are partitions, and written to the session's
    checkpoint folder, so that no later job can deal them in another way. A partition's rows are counted, and the counts of
    those before it added to the places in it; the counts, one for each partition, are all that the driver sees.
    """
    _checkpoint_folder(df)
    order = ordered(order_by)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(_PARTITION - 1)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, so_far = [], 0
    for p, n in sizes:
        offsets.append((p, so_far))
        so_far += n
    before = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    return rows.join(F.broadcast(before), part == F.col("__part")).withColumn(name, F.col("__before") + place).drop("__at", "__part", "__before")


def slice_rows(df: DataFrame, order_by: list[str | Column], first: int, last: int) -> DataFrame:
    """The rows from position first to last, the end excluded."""
    return positions(df, order_by, "__position").where((F.col("__position") >= first) & (F.col("__position") < last)).drop("__position")


def _checkpoint_folder(df: DataFrame) -> None:
    """The folder that spark.checkpoint.dir names; in a local session without it, one of the machine's."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
            import tempfile

            folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(folder)
