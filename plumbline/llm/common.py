"""What the operators share: the folder that all machines see, word hashes, sorted groups and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in a local session (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors.

    By zstandard: smaller than the default codec's files, and without its buffers outside of the heap, of which many files
    of many columns leave a pile until the next collection. "none" for tables of hashes and ids, which hardly get smaller:
    each page that zstandard writes or reads takes MB outside of the heap, which executors don't give back.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/plumbline/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_small(df: DataFrame, **entries: int) -> DataFrame:
    """df, with a broadcast hint if it takes at most BROADCAST_BYTES; entries: bytes of an entry of an array or of a byte in a binary column.

    df is counted, so it should be a written table.
    """
    size = F.lit(16 * (1 + len(df.columns)))
    for c, n in entries.items():
        size = size + n * F.coalesce(F.octet_length(c) if dict(df.dtypes)[c] == "binary" else F.size(c), F.lit(0))
    whole = df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if whole <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, so that further columns of the input, whatever their names, can't clash with ours."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


#: Stands for a null id in Python, where pandas would turn integers beside a null into floats.
NULL_ID = -(1 << 63)


#: Rows of an Arrow batch: of whole texts, the default of 10,000 takes hundreds of MB in each Python worker.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def keyed(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """pick() with the id as a 64-bit doc_id, NULL_ID where it is null. Lowers the session's BATCH_CONF to BATCH_ROWS."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    return pick(df, doc_id=id_col, **columns).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))


def unkeyed(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.when(F.col(name) != NULL_ID, F.col(name)))


# ---------------------------------------------------------------- word hashes

_RNG = np.random.Generator(np.random.PCG64(7))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WHITE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of text hashed in one go; bounds the memory of the arrays.
CHUNK = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):  # of scalars, numpy would warn
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + CHUNK // 4)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each word of a buffer that ends with white space."""
    a = np.frombuffer(buffer, np.uint8)
    space = _SPACE[a]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    power, inverse = _power_tables(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends


_NO_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def give_back() -> None:
    """Return freed memory to the system, Arrow's and, where the C library can, the rest: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def to_bytes(text: object, punctuation: bool = True) -> bytes:
    """UTF-8 with A-Z in lower case, ASCII punctuation as space where it isn't wanted; null and NaN are empty."""
    if not isinstance(text, str):
        return b""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.lower() if punctuation else raw.translate(_NO_PUNCTUATION)


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        found = _WHITE.search(text, at + CHUNK)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def word_hashes(texts: Iterable[object], punctuation: bool = True) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased; one array for each text.

    The polynomial hash of a word is a difference of prefix sums, so a chunk of texts takes a few numpy passes.
    """
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            h, starts, _ = _hash_buffer(b" ".join(held) + b" ")
            edges = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in held]]))
            for i in range(len(held)):
                yield h[edges[i] : edges[i + 1]]
            held.clear()

    for text in texts:
        raw = to_bytes(text, punctuation)
        if len(raw) > CHUNK:
            yield from flush()
            size = 0
            yield np.concatenate([_hash_buffer(p + b" ")[0] for p in _pieces(raw)])
            continue
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield from flush()
            size = 0
    yield from flush()
    give_back()


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of fewer words, of the whole sequence; of none, nothing. Not made distinct."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        return mix((words * _STEP[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - k + 1] * _STEP[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _STEP[i]
    return mix(total + np.uint64(k))


# ---------------------------------------------------------------- groups of sorted rows


def groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups as arrays by column, one after another, of batches sorted by keys; holds one group and one batch."""
    held: list[dict[str, np.ndarray]] = []
    last: tuple | None = None

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        change = np.zeros(len(batch), bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[k][a] for k in keys)
            if held and key != last:
                yield whole()
                held = []
            held.append({c: v[a:b] for c, v in columns.items()})
            last = key
    if held:
        yield whole()
    give_back()


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (u, v), component being its smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges stay as they are. Each
    round is a join on the node with its smallest neighbour, so no neighbourhood is gathered in one task, and each
    is written to the shared folder. Nodes without an edge are not returned; nulls and loops are left out.
    """
    edges = materialize(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, name)
        release(edges)
        now = _mark(after)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 31) - 1))).first()
    return (row[0], row[1])
