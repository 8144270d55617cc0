"""WARC: archives written with an index of their records, and read back by coalesced byte ranges of the index.

Records are gzip members of their own, so that any of them can be read alone. The write returns, per record, file,
offset, length, URL and digest; a read selects rows of that index, joins neighbouring ranges, and fetches each joined
range once. Files are written and read with pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import NULL_ID, broadcast_small, keyed, materialize, partitions, unkeyed
from plumbline.llm.token_files import file_system

INDEX = "doc_id long, file string, offset long, length long, url string, digest string, record_type string"
#: Dates of records, where the table has none, and the lines that end a record.
DATE, END = "2024-01-01T00:00:00Z", b"\r\n\r\n"
#: Ranges with at most this gap are joined, up to ranges of so many bytes.
GAP, LARGEST = 64 << 10, 8 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: object) -> str:
    """The URL without what would end a header line; a null one is empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if isinstance(url, str) else ""


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, null_url: bool) -> bytes:
    """A WARC/1.1 record: a response with HTTP headers and payload, or a revisit (identical payload) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not null_url:
        head.insert(2, f"WARC-Target-URI: {url}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + END)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:] if ": " in line), payload


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each row and return the index (doc_id, file, offset, length, url, digest, record_type).

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of at least `least` bytes that with
    the largest id is a response and the others are revisits of it; smaller ones are all responses. Rows that repeat
    the largest id are all responses; rows with a null id are responses of their own and take no part. Which payloads
    repeat is found on digests alone; each attempt of a task writes a file of its own name, which its index rows hold. Pages move once, to their files, in ascending order of id.
    """
    spark = pages.sparkSession
    rows = keyed(pages, id_col, url=url_col, html=html_col)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [h.encode("utf-8", "surrogatepass") if isinstance(h, str) else b"" for h in batch["html"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": [digest_of(p) for p in raw], "size": [len(p) for p in raw]})

    seen = materialize(rows.select("doc_id", "html").mapInPandas(digests, "doc_id long, digest string, size long"), "warc-digests")
    able = seen.where((F.col("doc_id") != NULL_ID) & (F.col("size") >= least))
    first = able.groupBy("digest").agg(F.max("doc_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = able.join(first, "digest").where("doc_id <> target").select("doc_id", "digest", "target").distinct()
    # of rows that repeat an id with other payloads, each has its own targets: chosen by the digest in the task
    revisits = revisits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "target"))).alias("targets"))
    revisits = materialize(revisits, "warc-revisits")
    bounds = partitions(spark)
    ordered = rows.join(broadcast_small(revisits, targets=48), "doc_id", "left").withColumn("targets", F.to_json("targets")).repartitionByRange(bounds, "doc_id").sortWithinPartitions("doc_id", "html", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        store, at = file_system(folder)
        store.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}-{uuid.uuid4().hex}.warc.gz"
        f, offset = None, 0
        for batch in batches:
            if f is None:
                f = store.open_output_stream(f"{at}/{name}", compression=None)
                head = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{part}>\r\nWARC-Date: {DATE}\r\nContent-Length: 0\r\n\r\n".encode() + END)
                f.write(head)
                offset = len(head)
            index = []
            for doc_id, url, html, targets in zip(batch["doc_id"], batch["url"], batch["html"], batch["targets"], strict=True):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                digest = digest_of(payload)
                target = json.loads(targets).get(digest) if isinstance(targets, str) else None
                raw = record(doc_id, _clean(url), payload, digest, target, not isinstance(url, str))
                f.write(raw)
                index.append((doc_id, f"{folder}/{name}", offset, len(raw), url, digest, "response" if target is None else "revisit"))
                offset += len(raw)
            yield pd.DataFrame(index, columns=["doc_id", "file", "offset", "length", "url", "digest", "record_type"])
        if f is not None:
            f.close()

    return materialize(ordered.mapInPandas(write, INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = GAP, largest: int = LARGEST) -> DataFrame:
    """The selected records' byte ranges, sorted and joined: (file, records array<struct<offset, length>>).

    Ranges of a file whose gap is at most `gap` share a fetch, cut at every `largest` bytes of the file.
    """
    by_file = Window.partitionBy("file").orderBy("offset")
    far = F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("length")).over(by_file), F.col("offset")) > gap
    cut = F.floor(F.col("offset") / largest)
    new = far | (cut != F.coalesce(F.lag(cut).over(by_file), cut))
    return (
        index.select("file", "offset", "length")
        .withColumn("new", new.cast("long"))
        .withColumn("range", F.sum("new").over(by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("file", "range")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .drop("range")
    )


def read_warc(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name: doc_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    Size and digest of a response are taken from the payload read, those of a revisit from its headers.
    """
    columns = ["doc_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, records in zip(batch["file"], batch["records"], strict=True):
                store, at = file_system(name)
                with store.open_input_file(at) as f:
                    begin = records[0]["offset"]
                    data = f.read_at(int(records[-1]["offset"] + records[-1]["length"] - begin), int(begin))
                out = []
                for r in records:
                    a = int(r["offset"] - begin)
                    fields, http, payload = parse(data[a : a + int(r["length"])])
                    revisit = fields["WARC-Type"] == "revisit"
                    size = int(http["Content-Length"]) if revisit else len(payload)
                    digest = fields["WARC-Payload-Digest"][5:] if revisit else digest_of(payload)
                    target = int(fields["WARC-Refers-To"][10:-1]) if revisit else NULL_ID
                    out.append((int(fields["WARC-Record-ID"][10:-1]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], target, payload)[: len(columns)])
                yield pd.DataFrame(out, columns=columns)

    schema = "doc_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return unkeyed(unkeyed(ranges(index).mapInPandas(read, schema)), "refers_to")
