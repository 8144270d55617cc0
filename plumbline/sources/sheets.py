"""Spreadsheets (the zipped XML of .xlsx files), a task for each file, with types as the cells have them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The numbers of the format's own date and time formats.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
#: Day 0 of dates in cells.
_ORIGIN = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    """The text of a string, of all its runs, without readings of its characters."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _column(reference: str) -> int:
    """The number of the column of a cell such as AB12, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """One file: its sheets, read a row at a time."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        self.strings = [_text(e) for e in self._all("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            own = {int(e.get("numFmtId")) for e in self._all("xl/styles.xml", "numFmt") if any(c in "ymdhs" for c in (e.get("formatCode") or "").split(";")[0].replace('"', "").lower()) and "general" not in (e.get("formatCode") or "").lower()}
            for xfs in self._all("xl/styles.xml", "cellXfs"):
                self.dates = [int(x.get("numFmtId") or 0) in DATE_FORMATS | own for x in xfs]
        targets = {e.get("Id"): e.get("Target") for e in self._all("xl/_rels/workbook.xml.rels", "Relationship")}
        key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        self.sheets = {e.get("name"): targets[e.get(key)].lstrip("/") for e in self._all("xl/workbook.xml", "sheet")}
        self.sheets = {n: t if t.startswith("xl/") else f"xl/{t}" for n, t in self.sheets.items()}

    def _all(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        with self.zip.open(part) as f:
            for _, element in ElementTree.iterparse(f):
                if _local(element.tag) == tag:
                    yield element
                    element.clear()

    def rows(self, sheet: str | int) -> Iterator[tuple[int, list[str | None], list[str | None]]]:
        """(number, values, kinds) of each row: n a number, d a date, b a truth value, s a text; both null for an empty cell."""
        part = list(self.sheets.values())[sheet] if isinstance(sheet, int) else self.sheets[sheet]
        number = 0
        for row in self._all(part, "row"):
            number = int(row.get("r") or number + 1)
            values: list[str | None] = []
            kinds: list[str | None] = []
            for n, cell in enumerate(c for c in row if _local(c.tag) == "c"):
                at = _column(cell.get("r")) if cell.get("r") else n
                while len(values) <= at:
                    values.append(None)
                    kinds.append(None)
                values[at], kinds[at] = self._cell(cell)
            yield number, values, kinds

    def _cell(self, cell: ElementTree.Element) -> tuple[str | None, str | None]:
        kind = cell.get("t") or "n"
        inner = {_local(c.tag): c for c in cell}
        if kind == "inlineStr":
            return (_text(inner["is"]), "s") if "is" in inner else (None, None)
        raw = inner["v"].text if "v" in inner else None
        if raw is None or kind == "e":
            return None, None
        if kind == "s":
            return self.strings[int(raw)], "s"
        if kind == "b":
            return "true" if raw == "1" else "false", "b"
        if kind in ("str", "d"):
            return raw, "s" if kind == "str" else "d"
        style = int(cell.get("s") or 0)
        if style < len(self.dates) and self.dates[style]:
            return str(_ORIGIN + timedelta(microseconds=round(float(raw) * 86_400_000_000))), "d"
        return raw, "n"


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """The rows of a sheet of each .xlsx file of a path, in columns of the first row's names (c0, c1, ... without header).

    A file is read by one task, in which it must fit. Columns are long or double where all their cells are numbers, timestamps
    where all are dates, boolean where all are truth values, else text; errors and empty cells are null. Rows without any
    value are left out. Files of one path have the columns of the first file by name.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                names: list[str] | None = None
                held = []
                for number, values, kinds in Workbook(bytes(content)).rows(sheet):
                    if not any(v is not None for v in values):
                        continue
                    if names is None:
                        names = [v if header and v is not None else f"c{i}" for i, v in enumerate(values)]
                        if header:
                            held.append((file, 0, names, [None] * len(names)))
                            continue
                    names += [f"c{i}" for i in range(len(names), len(values))]
                    held.append((file, number, values + [None] * (len(names) - len(values)), kinds + [None] * (len(names) - len(kinds))))
                    if len(held) >= 1000:
                        yield pd.DataFrame(held, columns=["file", "number", "cells", "kinds"])
                        held = []
                yield pd.DataFrame(held, columns=["file", "number", "cells", "kinds"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "file string, number int, cells array<string>, kinds array<string>")
    if header:
        first = rows.where("number = 0").orderBy("file").select("cells").head()
        names = list(first["cells"]) if first else []
    else:
        widest = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        names = [f"c{i}" for i in range(widest)]
    body = rows.where("number > 0")
    if not names:
        return body.select()
    if header:  # by the names of each file's own first row
        heads = rows.where("number = 0").select(F.col("file").alias("__file"), F.col("cells").alias("__names"))
        body = body.join(F.broadcast(heads), F.col("file") == F.col("__file"))
        place = lambda n: F.array_position("__names", F.lit(n)).cast("int")
        cell = lambda c, n: F.when(place(n) > 0, F.get(F.col(c), place(n) - 1))
    else:
        cell = lambda c, n: F.get(F.col(c), F.lit(int(n[1:])))
    texts = body.select(*[cell("cells", n).alias(f"v{i}") for i, n in enumerate(names)], *[cell("kinds", n).alias(f"k{i}") for i, n in enumerate(names)])
    whole = lambda i: F.bool_and(F.col(f"v{i}").rlike("^-?[0-9]{1,18}$"))
    seen = texts.agg(*[F.array_join(F.array_sort(F.collect_set(f"k{i}")), "").alias(f"k{i}") for i in range(len(names))], *[whole(i).alias(f"w{i}") for i in range(len(names))]).first()
    kind = lambda i: {"n": "long" if seen[f"w{i}"] else "double", "d": "timestamp_ntz", "b": "boolean"}.get(seen[f"k{i}"], "string")
    return texts.select(*[F.col(f"v{i}").cast(kind(i)).alias(n) for i, n in enumerate(names)])



