"""Datasets kept in a folder that all machines see: copied whole or not at all, described beside their data, replaced at once.

A dataset is a folder of versions, each with the data as it was given and a description. A version is copied under a
temporary name and renamed when it is whole, so a crash at any moment leaves the last whole version in place; readers take
the highest one. (On a file system where a rename isn't atomic, an object store, it is as good as its rename.)
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import catalyst
from plumbline.sources.readers import read, variable_name

#: Bytes of a dataset, at most, unless the catalog is made with another limit.
MOST_BYTES = 500 << 20
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,99}")
_TEMPORARY = "_coming-"


class Catalog:
    """Named datasets under one folder, on any file system that Hadoop reads."""

    def __init__(self, spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES):
        self.spark, self.folder, self.most_bytes = spark, folder.rstrip("/"), most_bytes
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # files
    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _names(self, path: str) -> list[str]:
        fs = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(self._path(path))) if fs.exists(self._path(path)) else []

    def _write(self, path: str, text: str) -> None:
        out = self._fs(path).create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _at(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no name of a dataset: letters, digits and _, at most 100")
        return f"{self.folder}/{name}"

    def _version(self, name: str) -> str:
        whole = [v for v in self._names(self._at(name)) if not v.startswith(_TEMPORARY)]
        if not whole:
            raise KeyError(name)
        return f"{self._at(name)}/{whole[-1]}"

    # datasets
    def put(self, path: str, name: str | None = None, fmt: str | None = None, replace: bool = False) -> str:
        """Copy a file or folder into the catalog; its name is made of the file's where none is given.

        It is refused if it is too large, can't be read, lies in the catalog itself, or the name is taken (unless it replaces).
        """
        file = path.rstrip("/").rsplit("/", 1)[-1]
        name = name or variable_name(file.rsplit(".", 1)[0])
        home, source = self._at(name), self._path(path)
        if ".." in path.split("/") or path.rstrip("/").startswith(self.folder + "/"):
            raise ValueError(f"{path}: a path without .. and outside the catalog is needed")
        if not self._fs(path).exists(source):
            raise FileNotFoundError(path)
        if not replace and [v for v in self._names(home) if not v.startswith(_TEMPORARY)]:
            raise FileExistsError(f"{name}: there is such a dataset; replace=True puts this in its place")
        size = self._fs(path).getContentSummary(source).getLength()
        if size > self.most_bytes:
            raise ValueError(f"{path}: {size} bytes, and the limit is {self.most_bytes}")
        coming = f"{home}/{_TEMPORARY}{uuid.uuid4().hex}"
        fs = self._fs(coming)
        fs.mkdirs(self._path(coming))
        try:
            self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(path), source, fs, self._path(f"{coming}/{file}"), False, self._conf)
            df = read(self.spark, f"{coming}/{file}", fmt)
            about = {"name": name, "file": file, "format": fmt, "bytes": size, "columns": dict(df.dtypes), "source": path, "added": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            self._write(f"{coming}/dataset.json", json.dumps(about))
            old = [v for v in self._names(home) if not v.startswith(_TEMPORARY)]
            number = int(old[-1].split("-")[0]) + 1 if old else 1
            if not fs.rename(self._path(coming), self._path(f"{home}/{number:010d}-{uuid.uuid4().hex}")):
                raise OSError(f"{name}: the copy can't be renamed")
        except BaseException:
            fs.delete(self._path(coming), True)
            raise
        for v in old:
            fs.delete(self._path(f"{home}/{v}"), True)
        return name

    def about(self, name: str) -> dict:
        """The description of a dataset: file, format, bytes, columns, where it came from and when."""
        path = self._path(f"{self._version(name)}/dataset.json")
        stream = self._fs(self.folder).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [n for n in self._names(self.folder) if _NAME.fullmatch(n) and any(not v.startswith(_TEMPORARY) for v in self._names(f"{self.folder}/{n}"))]

    def list(self) -> DataFrame:
        """(name, file, format, bytes, columns, source, added), a row for each dataset, by name."""
        rows = [self.about(n) for n in self.names()]
        keys = ("name", "file", "format", "bytes", "columns", "source", "added")
        return self.spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], "name string, file string, format string, bytes long, columns map<string,string>, source string, added string")

    def get(self, name: str) -> DataFrame:
        about = self.about(name)
        return read(self.spark, f"{self._version(name)}/{about['file']}", about["format"])

    def delete(self, name: str) -> None:
        self._version(name)
        self._fs(self.folder).delete(self._path(self._at(name)), True)

    def sql(self, query: str) -> DataFrame:
        """A query over the datasets that it names, and over the session's tables and views."""
        for name in self.referenced(query):
            self.get(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    def referenced(self, query: str) -> list[str]:
        """The datasets that a query reads."""
        read_by = {parts[0].lower() for parts in catalyst.relations(self.spark, query) if len(parts) == 1}
        return [n for n in self.names() if n.lower() in read_by]
