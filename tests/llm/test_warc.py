from pyspark.sql import functions as F

from plumbline.llm import queries, warc
from plumbline.llm.common import shared_path


def want(rows):
    """By brute force: (id, bytes, digest, type, refers_to)."""
    raw = [(i, (h or "").encode()) for i, h in rows]
    last = {}
    for i, p in raw:
        if i is not None:
            last[p] = max(i, last.get(p, i))
    out = []
    for i, p in raw:
        own = i is None or last[p] == i
        out.append((i, len(p), warc.digest_of(p), "response" if own else "revisit", None if own else last[p]))
    return sorted(out, key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op3_warc(spark, sf).collect()), key=str)
    assert got == want([(r["page_id"], r["html"]) for r in pages.collect()])


def test_odd_rows(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nX: y", None), (4, "", ""), (5, "u", "x"), (5, "u", "x"), (5, "u", "y"), (6, "u", "y"), (None, "u", "x"), (7, "é", "日本\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, offset int, digest string")
    index = warc.write_warc(pages, shared_path(spark, "odd-warc"))
    got = warc.read_warc(index, with_payload=True).collect()
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got), key=str) == want([(r[0], r[2]) for r in rows])
    assert {r["doc_id"]: bytes(r["payload"]) for r in got}[7] == "日本\r\n\r\nWARC/1.1".encode()
    some = warc.read_warc(index.where("doc_id IN (3, 7)"))
    assert sorted((r["doc_id"], r["url"]) for r in some.collect()) == [(3, "http://b%0D%0AX:%20y"), (7, "é")]
    least = warc.read_warc(warc.write_warc(pages, shared_path(spark, "odd-warc"), least=2))
    assert least.where("record_type = 'revisit'").count() == 0


def test_empty_and_ranges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(none, shared_path(spark, "no-warc"))).count() == 0
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 500, 5), ("g", 0, 7)], "file string, offset long, length long")
    joined = warc.ranges(index, gap=100).select("file", F.size("records").alias("n")).collect()
    assert sorted(map(tuple, joined)) == [("f", 1), ("f", 2), ("g", 1)]
