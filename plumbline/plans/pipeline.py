"""Recorded pipelines: DataFrame verbs that also note each step, and a report of what the steps do to the data.

A step keeps the function that makes its frame of its inputs, so a report can build the pipeline again with metrics
between the steps (`DataFrame.observe`) and read the numbers of all steps from the one run of each result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import filters, groups, joins, positions, profile, reshape

#: Operation to category, as the verbs below declare it; steps without inputs are sources, others "other".
CATEGORIES: dict[str, str] = {}
#: Operations that may give a column another type on purpose, and those that leave rows as they are.
TYPE_OPS: set[str] = set()
ROW_WISE: set[str] = set()


def verb(category: str, *ops: str, types: bool = False, row_wise: bool = False):
    """Declare the category of a method's operations (by default of its own name)."""

    def declare(method):
        for op in ops or (method.__name__,):
            CATEGORIES[op] = category
            if types:
                TYPE_OPS.add(op)
            if row_wise:
                ROW_WISE.add(op)
        return method

    return declare


MAX_STEPS = 500


@dataclass
class Step:
    id: int
    op: str
    label: str
    df: DataFrame
    inputs: list[tuple[int, str]]
    args: dict[str, Any] = field(default_factory=dict)
    name: str | None = None
    #: File and line outside this package that recorded the step.
    site: str = ""
    #: Makes the frame of those of the inputs; steps without it (sources, unknown operations) are taken as they are.
    make: Callable[..., DataFrame] | None = None

    @property
    def category(self) -> str:
        return CATEGORIES.get(self.op, "other") if self.inputs else "source"


def _site() -> str:
    frame = sys._getframe(1)
    while frame.f_back and frame.f_globals.get("__name__", "").startswith("plumbline.plans"):
        frame = frame.f_back
    return f"{frame.f_code.co_filename}:{frame.f_lineno}"


class Pipeline:
    """The steps of one pipeline, in the order they were recorded."""

    def __init__(self, max_steps: int = MAX_STEPS):
        self.steps: list[Step] = []
        self.max_steps = max_steps
        self.warnings: list[str] = []

    def source(self, df: DataFrame, label: str = "source", op: str = "source") -> Frame:
        return self.add(op, label, df, [])

    def add(self, op: str, label: str, df: DataFrame, inputs: list[tuple[Frame, str]], make: Callable[..., DataFrame] | None = None, **args: Any) -> Frame:
        """Record a step; make: how df comes from the frames of the inputs, where it comes from nothing else."""
        if len(set(df.columns)) != len(df.columns):
            raise ValueError(f"{op}: column names repeat: {df.columns}")
        if len(self.steps) >= self.max_steps:
            if not self.warnings:
                self.warnings.append(f"only the first {self.max_steps} steps are recorded")
            return Frame(self, df, None)
        known = all(f.step for f, _ in inputs)
        step = Step(len(self.steps), op, label[:90], df, [(f.step.id, role) for f, role in inputs if f.step], args, site=_site(), make=make if known else None)
        self.steps.append(step)
        return Frame(self, df, step)

    def consumers(self, step: Step) -> list[Step]:
        return [s for s in self.steps if any(i == step.id for i, _ in s.inputs)]

    def report(self, distinct: bool = False, cache_shared: bool = True) -> Report:
        from plumbline.plans.report import Report

        return Report.of(self, distinct, cache_shared)


class Frame:
    """A DataFrame whose verbs are recorded. Order matters only where an order is given."""

    def __init__(self, pipeline: Pipeline, df: DataFrame, step: Step | None):
        self.pipeline, self.df, self.step = pipeline, df, step

    def named(self, name: str) -> Frame:
        if self.step:
            self.step.name = name
        return self

    def _add(self, op: str, make: Callable[..., DataFrame], label: str = "", inputs: list[tuple[Frame, str]] | None = None, **args: Any) -> Frame:
        inputs = inputs or [(self, "input")]
        return self.pipeline.add(op, label or op, make(*(f.df for f, _ in inputs)), inputs, make, **args)

    def _values(self, column: str, values: list | None) -> list:
        """The values that become columns: given, or looked up by a job when the step is recorded."""
        return reshape.values_of(self.df, column) if values is None else values

    # columns
    @verb("projection")
    def select(self, *columns: str | Column) -> Frame:
        return self._add("select", lambda df: df.select(*columns), f"select {columns}")

    @verb("projection")
    def drop(self, *columns: str) -> Frame:
        return self._add("drop", lambda df: df.drop(*columns), f"drop {columns}")

    @verb("projection")
    def rename(self, columns: dict[str, str]) -> Frame:
        """All at once, so that two columns may swap names."""
        return self._add("rename", lambda df: df.select(*[F.col(positions.quoted(c)).alias(columns.get(c, c)) for c in df.columns]), f"rename {columns}", columns=columns)

    @verb("projection")
    def select_dtypes(self, *types: str) -> Frame:
        return self._add("select_dtypes", lambda df: df.select([c for c, t in df.dtypes if t in types]))

    @verb("projection")
    def filter_columns(self, like: str | None = None, items: list[str] | None = None, regex: str | None = None) -> Frame:
        """Columns whose name holds `like`, is one of `items` or matches `regex`."""
        wanted = lambda c: c in items if items is not None else re.search(regex, c) if regex is not None else like in c
        return self._add("filter_columns", lambda df: df.select([c for c in df.columns if wanted(c)]))

    @verb("projection")
    def column(self, name: str) -> Frame:
        return self._add("column", lambda df: df.select(name), f"column {name}")

    @verb("projection")
    def to_frame(self, name: str) -> Frame:
        """A single column under another name."""
        (only,) = self.df.columns
        return self._add("to_frame", lambda df: df.withColumnRenamed(only, name), f"to_frame {name}")

    @verb("projection")
    def rename_axis(self, keys: dict[str, str]) -> Frame:
        """Other names for the columns that serve as the index."""
        return self._add("rename_axis", lambda df: df.withColumnsRenamed(keys), f"rename_axis {keys}", columns=keys)

    @verb("reshape")
    def set_index(self, *keys: str) -> Frame:
        """The keys come first: an index is a column like others here, and loses nothing by it."""
        return self._add("set_index", lambda df: df.select(*keys, *[c for c in df.columns if c not in keys]), f"set_index {keys}", keys=[*keys])

    @verb("reshape")
    def reset_index(self) -> Frame:
        return self._add("reset_index", lambda df: df)

    @verb("projection")
    def copy(self) -> Frame:
        """The same frame as a step of its own; frames don't change, so nothing is copied."""
        return self._add("copy", lambda df: df)

    # rows
    @verb("filter", "filter", "query")
    def filter(self, condition: Column | str) -> Frame:
        cond = F.expr(condition) if isinstance(condition, str) else condition
        return self._add("query" if isinstance(condition, str) else "filter", lambda df: df.filter(cond), f"filter {condition}", condition=cond)

    @verb("filter")
    def dropna(self, subset: list[str] | None = None, how: str = "any", thresh: int | None = None) -> Frame:
        return self._add("dropna", lambda df: df.na.drop(how, thresh, subset), f"dropna {subset}", subset=subset, how=how, thresh=thresh)

    @verb("filter")
    def drop_duplicates(self, keys: list[str], order_by: list, keep: str = "first") -> Frame:
        return self._add("drop_duplicates", lambda df: filters.drop_duplicates(df, keys, order_by, keep), f"drop_duplicates {keys}", keys=keys, order_by=order_by, keep=keep)

    @verb("filter")
    def loc(self, first: int, last: int, order_by: list) -> Frame:
        """Rows first to last (from 0, the end excluded) in the given order, nulls last.

        Up to positions.SHALLOW rows in, tasks keep their first rows; beyond, the order is partitioned by range and written
        to the checkpoint folder when this is recorded, and positions are counted from the partitions' sizes.
        """
        if last <= positions.SHALLOW:
            return self._add("loc", lambda df: df.orderBy(*positions.ordered(order_by)).limit(last).offset(first), f"rows {first} to {last}")
        made = positions.slice_rows(self.df, order_by, first, last)
        return self.pipeline.add("loc", f"rows {first} to {last}", made, [(self, "input")])

    @verb("filter", "loc_labels")
    def loc_labels(self, key: str, first: Any, last: Any, columns: list[str] | None = None) -> Frame:
        """The rows whose label lies between first and last, both included, of some columns only where they are named."""
        label = F.col(positions.quoted(key))
        return self._add("loc_labels", lambda df: df.where(label.between(F.lit(first), F.lit(last))).select(*[positions.quoted(c) for c in columns or df.columns]), f"labels {first} to {last}")

    @verb("filter", "filter_groups")
    def filter_groups(self, keys: list[str], condition: Column | str) -> Frame:
        """The rows of the groups whose aggregates meet the condition."""
        cond = F.expr(condition) if isinstance(condition, str) else condition
        return self._add("filter_groups", lambda df: groups.filter_groups(df, keys, cond), f"groups of {keys} with {condition}", keys=keys)

    @verb("filter", "group_head")
    def group_head(self, keys: list[str], n: int, order_by: list) -> Frame:
        """The first n rows of each group in the given order, nulls last."""
        return self._add("group_head", lambda df: filters.numbered(df, keys, positions.ordered(order_by)).where(F.col("__n") <= n).drop("__n"), f"first {n} of {keys}", keys=keys)

    @verb("filter", "group_tail")
    def group_tail(self, keys: list[str], n: int, order_by: list[str]) -> Frame:
        """The last n rows of each group in the given order, in which nulls come last."""
        return self._add("group_tail", lambda df: filters.numbered(df, keys, [F.col(positions.quoted(c)).desc_nulls_first() for c in order_by]).where(F.col("__n") <= n).drop("__n"), f"last {n} of {keys}", keys=keys)

    @verb("aggregate", "idxmax", "idxmin")
    def idx(self, keys: list[str], label: str, by: str, most: bool = True) -> Frame:
        """The label of each group's row with the greatest (idxmax) or smallest (idxmin) value."""
        return self._add("idxmax" if most else "idxmin", lambda df: groups.idx(df, keys, label, by, most), f"{label} of the {'greatest' if most else 'smallest'} {by}", keys=keys)

    @verb("aggregate", "size")
    def size(self, keys: list[str], dropna: bool = False) -> Frame:
        """Rows of each group."""
        return self._add("size", lambda df: groups.group_sizes(df, keys, dropna), f"size of {keys}", keys=keys)

    @verb("mutate", "cumcount")
    def cumcount(self, keys: list[str], order_by: list, name: str, ascending: bool = True) -> Frame:
        return self._add("cumcount", lambda df: groups.cumcount(df, keys, order_by, name, ascending), f"cumcount of {keys}")

    @verb("limit")
    def head(self, n: int, order_by: list) -> Frame:
        """The first n rows in the given order; as in sort_values and loc, nulls come last."""
        return self._add("head", lambda df: df.orderBy(*positions.ordered(order_by)).limit(n), f"head {n}")

    @verb("limit")
    def tail(self, n: int, order_by: list[str]) -> Frame:
        return self._add("tail", lambda df: df.orderBy(*[F.col(positions.quoted(c)).desc() for c in order_by]).limit(n), f"tail {n}")

    @verb("limit")
    def nlargest(self, n: int, by: str, ties: list) -> Frame:
        return self._add("nlargest", lambda df: df.orderBy(F.col(positions.quoted(by)).desc(), *ties).limit(n), f"nlargest {n} {by}")

    @verb("limit")
    def nsmallest(self, n: int, by: str, ties: list) -> Frame:
        return self._add("nsmallest", lambda df: df.orderBy(F.col(positions.quoted(by)).asc_nulls_last(), *ties).limit(n), f"nsmallest {n} {by}")

    @verb("limit")
    def sample(self, fraction: float | None = None, seed: int = 0, n: int | None = None) -> Frame:
        """Each row with the given chance, or n rows, each set of n as likely; a task keeps n rows at most for that."""
        if (fraction is None) == (n is None):
            raise ValueError("sample takes either fraction or n")
        if n is not None:
            return self._add("sample", lambda df: df.orderBy(F.rand(seed)).limit(n), f"sample {n} rows")
        return self._add("sample", lambda df: df.sample(fraction, seed), f"sample {fraction}")

    @verb("sort")
    def sort_values(self, *by: str, ascending: bool | list[bool] = True) -> Frame:
        """Nulls last; ascending for all keys or for each."""
        ways = [ascending] * len(by) if isinstance(ascending, bool) else ascending
        return self._add("sort_values", lambda df: df.orderBy(*[F.col(positions.quoted(c)).asc_nulls_last() if up else F.col(positions.quoted(c)).desc_nulls_last() for c, up in zip(by, ways, strict=True)]), f"sort {by}", by=by)

    @verb("sort")
    def sort_index(self, *keys: str, ascending: bool = True) -> Frame:
        return self._add("sort_index", lambda df: df.orderBy(*[F.col(k).asc_nulls_last() if ascending else F.col(k).desc_nulls_last() for k in keys]), f"sort_index {keys}", by=keys)

    # values
    @verb("mutate", types=True, row_wise=True)
    def assign(self, **columns: Column) -> Frame:
        return self._add("assign", lambda df: df.withColumns(columns), f"assign {[*columns]}", touched=[*columns])

    @verb("mutate", types=True, row_wise=True)
    def astype(self, types: dict[str, str], coerce: bool = False) -> Frame:
        return self._add("astype", lambda df: df.withColumns({c: F.col(c).try_cast(t) if coerce else F.col(c).cast(t) for c, t in types.items()}), f"astype {types}", touched=[*types])

    @verb("mutate", types=True)
    def convert_dtypes(self) -> Frame:
        """Floating columns of whole numbers as long: the one verb that runs a job, to look at the values."""
        return self._add("convert_dtypes", lambda df: reshape.convert_dtypes(df))

    @verb("mutate", row_wise=True)
    def fillna(self, values: dict[str, Any]) -> Frame:
        return self._add("fillna", lambda df: df.na.fill(values), f"fillna {values}", touched=[*values])

    @verb("mutate", row_wise=True)
    def where(self, column: str, condition: Column, other: Any = None) -> Frame:
        return self._add("where", lambda df: df.withColumn(column, F.when(condition, F.col(column)).otherwise(F.lit(other))), f"where {column}", touched=[column])

    @verb("mutate", row_wise=True)
    def mask(self, column: str, condition: Column, other: Any = None) -> Frame:
        return self._add("mask", lambda df: df.withColumn(column, F.when(condition, F.lit(other)).otherwise(F.col(column))), f"mask {column}", touched=[column])

    @verb("mutate", row_wise=True)
    def replace(self, column: str, values: dict) -> Frame:
        return self._add("replace", lambda df: df.replace(values, subset=[column]), f"replace {column}", touched=[column])

    @verb("mutate", types=True, row_wise=True)
    def map(self, column: str, values: dict | Callable[[Column], Column]) -> Frame:
        """Values by a dictionary, others becoming null, or by a function that makes an expression of the column."""
        made = values(F.col(column)) if callable(values) else F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))
        return self._add("map", lambda df: df.withColumn(column, made), f"map {column}", touched=[column])

    @verb("mutate", types=True)
    def apply(self, function: Callable, schema: str) -> Frame:
        """A function of batches (iterator of pandas frames), where no expression will do."""
        return self._add("apply", lambda df: df.mapInPandas(function, schema), "apply")

    # several frames
    @verb("join")
    def merge(self, right: Frame, on: list[str] | None = None, how: str = "inner", left_on: list[str] | None = None, right_on: list[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> Frame:
        out = lambda a, b: joins.merge(a, b, on, left_on, right_on, how, suffixes, null_safe)
        keys = (left_on or on or [c for c in self.df.columns if c in right.df.columns], right_on or on or [c for c in self.df.columns if c in right.df.columns])
        return self._add("merge", out, f"merge {how} {keys[0]}", [(self, "left"), (right, "right")], how=how, left_on=keys[0], right_on=keys[1], suffixes=suffixes, null_safe=null_safe)

    @verb("join")
    def join(self, right: Frame, on: list[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> Frame:
        """merge on the columns that serve as both sides' index, all rows of the left by default."""
        out = lambda a, b: joins.merge(a, b, on, how=how, suffixes=suffixes)
        return self._add("join", out, f"join {how} {on}", [(self, "left"), (right, "right")], how=how, left_on=on, right_on=on, suffixes=suffixes, null_safe=False)

    @verb("concat")
    def concat(self, *others: Frame) -> Frame:
        return self._add("concat", lambda *frames: joins.concat([*frames]), "concat", [(f, "input") for f in (self, *others)])

    # groups and shapes
    @verb("aggregate", "agg", "groupby")
    def agg(self, keys: list[str], dropna: bool = False, **made: Column) -> Frame:
        rows = lambda df: df.dropna(subset=keys) if dropna and keys else df
        return self._add("groupby" if keys else "agg", lambda df: rows(df).groupBy(*[F.col(positions.quoted(k)) for k in keys]).agg(*[c.alias(k) for k, c in made.items()]), f"groupby {keys} {[*made]}", keys=keys, dropna=dropna, made=made)

    @verb("aggregate")
    def value_counts(self, column: str, dropna: bool = True, sort: bool = False) -> Frame:
        return self._add("value_counts", lambda df: reshape.value_counts(df, column, dropna, sort=sort), f"value_counts {column}", keys=[column], dropna=dropna)

    @verb("mutate")
    def transform(self, keys: list[str], **made: Column) -> Frame:
        return self._add("transform", lambda df: groups.transform(df, keys, **made), f"transform {keys}")

    @verb("reshape", types=True)
    def melt(self, ids: list[str], values: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return self._add("melt", lambda df: reshape.melt(df, ids, values, var_name, value_name), "melt")

    @verb("reshape")
    def pivot(self, index: list[str], columns: str, values: list | None, value: str) -> Frame:
        values = self._values(columns, values)
        return self._add("pivot", lambda df: reshape.pivot(df, index, columns, values, value), "pivot")

    @verb("reshape", types=True)
    def stack(self, ids: list[str], values: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return self._add("stack", lambda df: reshape.stack(df, ids, values, var_name, value_name), "stack")

    @verb("reshape")
    def unstack(self, index: list[str], columns: str, values: list | None, value: str) -> Frame:
        values = self._values(columns, values)
        return self._add("unstack", lambda df: reshape.pivot(df, index, columns, values, value), f"unstack {columns}")

    @verb("reshape", types=True)
    def transpose(self, label: str, labels: list | None = None, name: str = "variable") -> Frame:
        labels = self._values(label, labels)
        return self._add("transpose", lambda df: reshape.transpose(df, label, labels, name), "transpose")

    @verb("aggregate", types=True)
    def pivot_table(self, index: list[str], columns: str, values: list | None, agg: Column) -> Frame:
        values = self._values(columns, values)
        return self._add("pivot_table", lambda df: reshape.pivot_table(df, index, columns, values, agg), "pivot_table")

    @verb("reshape", types=True)
    def explode(self, column: str) -> Frame:
        return self._add("explode", lambda df: reshape.explode(df, column), f"explode {column}")

    @verb("aggregate")
    def crosstab(self, index: str, columns: str, values: list | None = None) -> Frame:
        values = self._values(columns, values)
        return self._add("crosstab", lambda df: reshape.crosstab(df, index, columns, values), f"crosstab {index} {columns}")

    @verb("aggregate")
    def describe(self, columns: list[str], keys: list[str] | None = None, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> Frame:
        return self._add("describe", lambda df: reshape.describe(df, columns, keys, percentiles), f"describe {columns}")

    @verb("reshape")
    def get_dummies(self, column: str, values: list | None = None) -> Frame:
        values = self._values(column, values)
        return self._add("get_dummies", lambda df: reshape.get_dummies(df, column, values), f"get_dummies {column}")

    @verb("mutate")
    def rank(self, keys: list[str], by: str, name: str, method: str = "average") -> Frame:
        return self._add("rank", lambda df: groups.rank(df, keys, by, name, method), f"rank {by}")

    @verb("mutate")
    def running(self, keys: list[str], order_by: list, **made: Column) -> Frame:
        return self._add("running", lambda df: groups.running(df, keys, order_by, **made), f"running {[*made]}")

    @verb("mutate", row_wise=True)
    def isin(self, column: str, values: list, name: str) -> Frame:
        """Whether the column's value is one of the given ones; null is not."""
        return self._add("isin", lambda df: df.withColumn(name, F.coalesce(F.col(positions.quoted(column)).isin(values), F.lit(False))), f"isin {column}", touched=[name])

    @verb("concat")
    def concat_columns(self, other: Frame, keys: list[str]) -> Frame:
        return self._add("concat_columns", lambda a, b: joins.concat_columns(a, b, keys), f"concat_columns {keys}", [(self, "left"), (other, "right")])

    @verb("reshape")
    def reindex(self, labels: DataFrame, keys: list[str]) -> Frame:
        return self._add("reindex", lambda df: reshape.reindex(df, labels, keys), "reindex")


__all__ = ["Frame", "Pipeline", "Step", "profile"]
