import pytest

import corpus_pipeline
from plumbline.llm import queries, toxicity
from plumbline.llm.common import materialize
from tests.llm import test_decontamination, test_jaccard_join
from tests.llm.cases import empty_documents, odd_documents


def test_stages(spark, sf):
    """Each stage against a plain version of what it is to keep, on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, sf), name)
        old, new = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (before, after.withColumn("text", after[after.columns[0]].cast("string")) if name == "packing" else after))
        if name == "toxicity":
            bad = {r["doc_id"] for r in queries.op1_toxicity(spark, sf).where("predicted = 1").collect()}
            assert new == {d: t for d, t in old.items() if d not in bad}
        elif name == "near_copies":
            least = {d: c for d, _, c in test_jaccard_join.brute(list(old.items()), 5, 80)}
            assert new == {d: t for d, t in old.items() if least[d] == d}
        elif name == "repeated_passages":
            assert all(len(new[d] or "") <= len(old[d] or "") for d in new) and {*new} <= {*old}
            assert {d for d in old if d not in new or new[d] != old[d]} == {r["doc_id"] for r in __import__("plumbline.llm.substring_dedup", fromlist=["x"]).repeated_passages(before).collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            bad = {d for d, _, _ in test_decontamination.brute(list(old.items()), items)}
            assert new == {d: t for d, t in old.items() if d not in bad}
        else:
            assert {*new} == {*old}
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    assert toxicity.FEATURES and corpus_pipeline.run(spark, sf).count() == before.count()


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_and_empty_tables(spark, tmp_path, kind):
    """Null and repeated ids, null and long texts, columns of the operators' own names; or no rows in any table."""
    docs = odd_documents(spark) if kind == "odd" else empty_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 0), (5, 1), (None, 1), (99, None)] if kind == "odd" else []
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "two words"), (None, "and more words"), (2, None)] if kind == "odd" else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, str(tmp_path)), name)
        if name != "packing":
            assert after.columns == before.columns and after.dtypes == before.dtypes
            before = after
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert pieces == []
        return
    texts = [r["text"] for r in before.collect()]
    # "ONE" is a copy of "one", the item "two words" took its document along, and nothing else went
    assert sorted(texts, key=str) == sorted([r["text"] for r in docs.collect() if r["text"] not in ("two words", "ONE")], key=str)
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces) and sum(r["start"] == 0 for r in pieces) == len(texts)
