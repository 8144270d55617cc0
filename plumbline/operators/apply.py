"""Functions over whole groups, of any size: a group is streamed through the function, never held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.positions import ordered, quoted

#: Of the batches of one group, in order, the rows that it comes to (any number, as frames).
GroupFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _cut(batch: pd.DataFrame, keys: list[str]) -> list[pd.DataFrame]:
    """The runs of equal keys of a sorted batch; nulls equal each other."""
    if not len(batch):
        return []
    before, now = batch[keys].iloc[:-1].reset_index(drop=True), batch[keys].iloc[1:].reset_index(drop=True)
    change = ((before != now) & ~(before.isna() & now.isna())).any(axis=1)
    edges = [0, *(change.to_numpy().nonzero()[0] + 1).tolist(), len(batch)]
    return [batch.iloc[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


def _streamed(keys: list[str], function: GroupFunction):
    """Sorted batches to the results of one group after another; the batches of a group are handed on as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (part for batch in batches for part in _cut(batch, keys))
        held = next(parts, None)
        while held is not None:
            key = tuple(held[keys].iloc[0])
            left: list[pd.DataFrame | None] = [None]

            def group(first: pd.DataFrame = held, key: tuple = key, left: list = left) -> Iterator[pd.DataFrame]:
                yield first.reset_index(drop=True)
                for part in parts:
                    if not _same(tuple(part[keys].iloc[0]), key):
                        left[0] = part
                        return
                    yield part.reset_index(drop=True)

            stream = group()
            for made in function(stream):
                if len(made):
                    yield made.assign(**dict(zip(keys, [[k] * len(made) for k in key], strict=True)))[[*keys, *[c for c in made.columns if c not in keys]]]
            for _ in stream:  # what the function left unread
                pass
            held = left[0]

    return run


def _schema(df: DataFrame, keys: list[str], columns: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*[f"{quoted(k)} {kinds[k]}" for k in keys], columns])


def apply_groups(df: DataFrame, keys: list[str], function: GroupFunction, columns: str, order_by: list[str | Column] | None = None) -> DataFrame:
    """The keys and the given columns ("name type, ...") that the function makes of each group's rows in the given order.

    Rows are partitioned by key and sorted; each group's batches pass through the function while they are read, so a task
    holds a batch and what the function keeps, however large the group. Groups of null keys are groups too. A function whose
    results for parts of a group can be combined should go through `combine_groups`, which spreads a large group.
    """
    order = [F.col(quoted(k)) for k in keys] + ordered(order_by or [])
    rows = df.repartition(*[F.col(quoted(k)) for k in keys]).sortWithinPartitions(*order)
    return rows.mapInPandas(_streamed(keys, function), _schema(df, keys, columns))


def combine_groups(df: DataFrame, keys: list[str], part: GroupFunction, columns: str, combine: GroupFunction) -> DataFrame:
    """As apply_groups, for functions of parts: `part` makes of a part of a group rows that `combine` makes one result of.

    Each task applies `part` to the rows it reads, so no row of df is shuffled: only what the parts came to is, and of one
    key no more than a few rows for each task, whatever its share of all rows. Both functions make the same columns.
    """
    order = [F.col(quoted(k)) for k in keys]
    schema = _schema(df, keys, columns)
    parts = df.sortWithinPartitions(*order).mapInPandas(_streamed(keys, part), schema)
    return parts.repartition(*order).sortWithinPartitions(*order).mapInPandas(_streamed(keys, combine), schema)


def frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Rows as one frame, for functions that make a few."""
    first = next(rows, None)
    if first is not None:
        yield pd.DataFrame([*chain([first], rows)])
