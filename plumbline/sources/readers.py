"""Readers by format and a small catalog of named datasets."""

from __future__ import annotations

import builtins
import json
import keyword
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.catalyst import relations
from plumbline.sources.sheets import read_excel


@dataclass(frozen=True)
class Format:
    """How files of some suffixes are read."""

    name: str
    suffixes: tuple[str, ...]
    load: Callable[[SparkSession, DataFrameReader, str], DataFrame]


def _separated(sep: str):
    return lambda spark, reader, path: reader.options(header=True, sep=sep).csv(path)


def _json(spark: SparkSession, reader: DataFrameReader, path: str) -> DataFrame:
    """Lines of objects where the first line is a whole object, else one value (an array, or an object of several lines) a file."""
    first = spark.read.text(path).where(F.trim("value") != "").head()
    try:
        lines = first is not None and isinstance(json.loads(first["value"]), dict)
    except ValueError:
        lines = False
    return reader.option("multiLine", not lines).json(path)


FORMATS = [
    Format("csv", ("csv", "txt"), _separated(",")),
    Format("tsv", ("tsv",), _separated("\t")),
    Format("json", ("json",), _json),
    Format("jsonl", ("jsonl", "ndjson"), lambda spark, reader, path: reader.json(path)),
    Format("parquet", ("parquet", "pq"), lambda spark, reader, path: reader.parquet(path)),
    Format("excel", ("xlsx",), lambda spark, reader, path: read_excel(spark, path)),
    Format("orc", ("orc",), lambda spark, reader, path: reader.orc(path)),
]
_BY_NAME = {f.name: f for f in FORMATS}
_BY_SUFFIX = {suffix: f for f in FORMATS for suffix in f.suffixes}


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A file or folder by its suffix or the name of a format. Without a schema, types of separated text are inferred."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    found = _BY_NAME.get(fmt) if fmt else _BY_SUFFIX.get(suffix)
    if found is None:
        raise ValueError(f"no reader for {fmt or suffix}; there are {', '.join(_BY_NAME)}")
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return found.load(spark, reader, path)


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file, which one machine holds: for small tables."""
    from pyarrow import feather

    return spark.createDataFrame(feather.read_table(path))


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


#: Ranges of the key that are counted for each partition of a table, to cut it evenly.
FINE = 16


def key_ranges(spark: SparkSession, url: str, table: str, key: str, partitions: int, **options: str) -> list[str]:
    """Conditions on a whole-number key (written as the database wants it, quoted or not) that cut a table of a database into parts of about as many rows.

    One aggregate tells the ends of the key, a second one the rows of FINE * partitions ranges of equal width; neighbours
    are put together until they hold their share. A single range is never cut, so keys that crowd in one make it larger.
    """
    ask = lambda query: spark.read.format("jdbc").options(url=url, query=query, **options).load()
    low, high, rows = ask(f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}").first()
    if low is None or partitions < 2:
        return ["1 = 1"]
    low, high = int(low), int(high)
    width = max(1, -(-(high - low + 1) // (FINE * partitions)))
    place = f"SELECT FLOOR(({key} - ({low})) / {width}) AS b FROM {table} WHERE {key} IS NOT NULL"
    counts = sorted((int(b), int(n)) for b, n in ask(f"SELECT b, COUNT(*) AS n FROM ({place}) q GROUP BY b").collect())
    cuts, held = [], 0
    for b, n in counts:
        if held and held + n / 2 > rows / partitions:
            cuts.append(low + b * width)
            held = 0
        held += n
    edges = [None, *cuts, None]
    parts = [" AND ".join(p for p in (f"{key} >= {a}" if a is not None else "", f"{key} < {b}" if b is not None else "") if p) for a, b in zip(edges, edges[1:], strict=False)]
    parts[0] = f"({parts[0]}) OR {key} IS NULL" if parts[0] else "1 = 1"
    return parts


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int | None = None, **options: str) -> DataFrame:
    """A table of a database, in one part or, by a whole-number key, in parts of about as many rows that are read side by side."""
    if key is None:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    parts = key_ranges(spark, url, table, key, partitions or spark.sparkContext.defaultParallelism, **options)
    return spark.read.jdbc(url, table, predicates=parts, properties=options)


#: Names that generated scripts use themselves.
RESERVED = {"pd", "spark"}


def variable_name(stem: str) -> str:
    """An identifier for a file's name: its words in lower case, with data_ before a digit and _df after a taken name."""
    words = [w for w in re.split(r"[\W_]+", stem.lower()) if w]
    if not words:
        return "data"
    if words[0][0].isdigit():
        words.insert(0, "data")
    name = "_".join(words)
    taken = name in RESERVED or name in vars(builtins) or keyword.iskeyword(name)
    return name + "_df" * taken


class Datasets:
    """Named inputs: temporary views that are read when used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.info = spark, {}

    def add(self, path: str, name: str | None = None, fmt: str | None = None) -> str:
        name = name or variable_name(path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])
        df = read(self.spark, path, fmt)
        df.createOrReplaceTempView(name)
        self.info[name] = {"path": path, "format": fmt, "columns": df.columns}
        return name

    def get(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def remove(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.info.pop(name, None)

    def referenced(self, query: str) -> list[str]:
        """The datasets that a query reads."""
        read_by = {parts[0].lower() for parts in relations(self.spark, query) if len(parts) == 1}
        return [n for n in self.info if n.lower() in read_by]
