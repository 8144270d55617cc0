"""Functions of groups, contracts, sketches, and verbs on nulls and odd names."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.operators.apply import apply_groups, combine_groups
from plumbline.plans.contract import Contract, violating_rows, violations
from plumbline.plans.pipeline import Pipeline
from plumbline.streaming.batches import profile_so_far, sketch_stream


def total(batches):
    n, s = 0, 0
    for b in batches:
        n, s = n + int(b["n"].sum() if "n" in b else len(b)), s + int((b["s"] if "s" in b else b["v"]).sum())
    yield pd.DataFrame({"n": [n], "s": [s]})


def test_groups_of_any_size(spark):
    """One key holds a third of the rows, over many batches; null keys are a group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rng = random.Random(1)
        rows = [(None if i % 10 == 9 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i % 4, i) for i in range(5000)]
        df = spark.createDataFrame(rows, "`the key` string, j int, v long").repartition(5)
        want = {}
        for k, j, v in rows:
            n, s = want.get((k, j), (0, 0))
            want[k, j] = n + 1, s + v
        for made in (apply_groups(df, ["the key", "j"], total, "n long, s long"), combine_groups(df, ["the key", "j"], total, "n long, s long", total)):
            assert {(r["the key"], r["j"]): (r["n"], r["s"]) for r in made.collect()} == want and made.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_streamed(spark):
    """A function that reads only the first batch of a group, one that makes many rows, and none."""
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        def first(batches):
            b = next(batches)
            yield pd.DataFrame({"most": [len(b)], "low": [int(b["v"].min())]})

        assert sorted(tuple(r) for r in apply_groups(df, ["k"], first, "most long, low long", ["v"]).select("k", "low").collect()) == [(0, 0), (1, 1), (2, 2)]
        assert max(r["most"] for r in apply_groups(df, ["k"], first, "most long, low long", ["v"]).collect()) <= 50
        assert apply_groups(df, ["k"], lambda batches: (b[["v"]] for b in batches), "v long").count() == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert apply_groups(df.where("false"), ["k"], total, "n long, s long").collect() == []


def test_combined_parts_move_no_rows(spark):
    """Only what the parts came to is shuffled: the exchange is above the function of parts."""
    plan = combine_groups(spark.range(10).selectExpr("id % 2 AS k", "id AS v"), ["k"], total, "n long, s long", total)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") > plan.index("MapInPandas") and plan.count("RepartitionByExpression") == 1


def test_contracts(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 6), (2, "y", None), (None, "z", 8), (None, "z", 9)], "`a.b` long, s string, n int")
    c = Contract(types={"a.b": "bigint", "s": "string", "n": "bigint"}, not_null=("s", "gone"), unique=(("a.b",), ("s", "gone")), values={"small": "n < 9"}, least_rows=6, most_rows=4, closed=True)
    got = {(r["rule"], r["subject"]): r["violations"] for r in violations(df, c).collect()}
    assert got == {("column", "a.b"): 0, ("column", "s"): 0, ("column", "n"): 0, ("type", "a.b bigint"): 0, ("type", "s string"): 0, ("type", "n bigint"): 1, ("rows", "at least 6"): 1, ("rows", "at most 4"): 1, ("not_null", "s"): 1, ("not_null", "gone"): 1, ("values", "small"): 2, ("unique", "a.b"): 2, ("unique", "s, gone"): 1}
    rows = {(r["a.b"], r["s"], r["n"]): r["broken"] for r in violating_rows(df, c).collect()}
    assert rows == {(2, None, 6): ["not_null s", "unique a.b"], (2, "y", None): ["values small", "unique a.b"], (None, "z", 8): ["unique a.b"], (None, "z", 9): ["values small", "unique a.b"]}
    own = Contract.of(df, unique=[["s"]])
    assert {r["violations"] for r in violations(df, own).collect()} == {0, 1}
    empty = df.where("false")
    assert {(r["rule"], r["violations"]) for r in violations(empty, Contract(unique=(("s",),), not_null=("s",), values={"n": "n > 0"})).collect()} == {("rows", 0), ("not_null", 0), ("values", 0), ("unique", 0)}
    assert violating_rows(empty, c).count() == 0 and violating_rows(df, Contract()).count() == 0


def test_sketches_add_up(spark, sf, tmp_path):
    df = spark.range(40_000).selectExpr("id", "id % 100 AS few", "CAST(id % 5000 AS DOUBLE) AS d", "array(id % 10) AS l", "IF(id % 4 = 0, NULL, CAST(id % 9000 AS STRING)) AS s", "map('a', id) AS m")
    parts = None
    for i in range(4):
        one = profile.sketches(df.where(f"id % 4 = {i}"))
        parts = one if parts is None else parts.union(one)
    rows = {r["column"]: r for r in profile.united(parts).collect()}
    assert all(r["rows"] == 40_000 for r in rows.values()) and rows["s"]["null_count"] == 10_000 and rows["m"]["n_unique"] is None
    for name, exact in {"id": 40_000, "few": 100, "d": 5000, "l": 10, "s": 6750}.items():
        assert abs(rows[name]["n_unique"] - exact) <= 4 * profile.SKETCH_ERROR * exact + 1, name
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    for _ in range(2):  # nothing new the second time
        sketch_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    events = {r["column"]: r for r in profile_so_far(spark, str(tmp_path / "out")).collect()}
    assert events["event_id"]["rows"] == 1000 and abs(events["event_id"]["n_unique"] - 1000) <= 4 * profile.SKETCH_ERROR * 1000 + 1


def test_nulls_and_names(spark):
    p = Pipeline()
    a = p.source(spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", None), (None, 3.0)], "`a.b` string, v double"))
    ranks = {m: sorted(((r["v"] is None, r["v"] or 0, r["r"]) for r in a.rename({"a.b": "k"}).rank(["k"], "v", "r", m).df.where("k = 'g'").collect()), key=str) for m in ("average", "min", "max", "dense")}
    assert [[r[2] for r in sorted(rows, key=lambda x: x[:2])] for rows in ranks.values()] == [[1.0, 2.5, 2.5, None], [1, 2, 2, None], [1, 3, 3, None], [1, 2, 2, None]]
    assert [r["x"] for r in a.isin("a.b", ["g"], "x").df.orderBy("v").collect()].count(False) == 1
    assert [r["v"] for r in a.head(2, ["v", "a.b"]).df.collect()] == [1.0, 2.0] and a.loc(0, 1, ["a.b"]).df.count() == 1
    assert a.sort_values("a.b").df.collect()[-1]["a.b"] is None and a.loc_labels("a.b", "a", "z", ["v"]).df.count() == 4
    assert [tuple(r) for r in a.crosstab("a.b", "v", [1.0, 2.0]).df.collect()] == [("g", 1, 2)]
    named = [a.rank(["a.b"], "v", "r"), a.running(["a.b"], ["v"], n=F.count(F.lit(1))), a.cumcount(["a.b"], ["v"], "n"), a.group_head(["a.b"], 9, ["v"]), a.group_tail(["a.b"], 9, ["a.b", "v"]), a.transform(["a.b"], n=F.count(F.lit(1))), a.tail(9, ["a.b"]), a.nlargest(9, "a.b", ["v"])]
    assert [f.df.count() for f in named] == [5] * len(named)
    assert a.agg(["a.b"], n=F.count(F.lit(1))).df.count() == a.size(["a.b"]).df.count() == a.drop_duplicates(["a.b"], ["v"]).df.count() == a.drop_duplicates(["a.b"], ["v"], keep="last").df.count() == 2
    assert a.sample(n=3, seed=1).df.count() == 3 and a.filter_groups(["a.b"], F.count(F.lit(1)) > 1).df.count() == 4
    with pytest.raises(ValueError, match="either"):
        a.sample(0.5, n=3)


def test_values_looked_up(spark, monkeypatch):
    from plumbline.operators import reshape

    p = Pipeline()
    a = p.source(spark.createDataFrame([(1, "x", 5.0), (1, "y", 6.0), (2, None, 7.0)], "k long, s string, v double"))
    assert a.pivot(["k"], "s", None, "v").df.columns == ["k", "x", "y"] and a.get_dummies("s").df.columns == ["k", "v", "s_x", "s_y"]
    monkeypatch.setattr(reshape, "MOST_VALUES", 1)
    with pytest.raises(ValueError, match="over 1 values"):
        a.crosstab("k", "s")


def test_renames_by_likeness(spark):
    """A column computed anew under another name, with the same type, nulls and number of values."""
    from plumbline.plans.report import diff

    p = Pipeline()
    a = p.source(spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, None, 1)], "id long, s string, n long"))
    b = a.assign(t=F.concat("s", F.lit("!")), m=F.col("n") + 1).drop("s", "n")
    d = diff(p.report(distinct=True), a.step.id, b.step.id)["columns"]
    assert d == {"id": "same", "t": "likely renamed from s", "n": "removed", "m": "added"}
