"""Numbers of a report's one run against those of jobs of their own."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters
from plumbline.operators import positions as positions_module
from plumbline.operators.positions import positions, slice_rows
from plumbline.plans import catalyst
from plumbline.plans.observed import Runs, stops_early
from plumbline.plans.pipeline import Pipeline
from plumbline.plans.report import facts


def source(spark, p, n=200):
    return p.source(spark.range(n).selectExpr("id", "id % 7 AS k", "IF(id % 5 = 0, NULL, id) AS v", "CAST(id % 3 AS STRING) AS `odd name`"))


def chain(spark, p):
    a = source(spark, p).filter("id > 10").assign(w=F.col("v") * 2).fillna({"v": 0}).rename({"odd name": "a.b"}).sort_values("a.b", "id")
    return a.filter("w IS NOT NULL OR id % 2 = 0").astype({"k": "string"}).dropna(["w"]).drop("v")


def joined(spark, p):
    a, b = source(spark, p), source(spark, p, 20).select("k", "v").drop_duplicates(["k"], ["v"])
    j = a.filter("id < 150").merge(b, on=["k"], how="left")
    return j.agg(["k"], n=F.count("v_x")).merge(j.filter("id > 5"), on=["k"])


def several(spark, p):
    a = source(spark, p).filter("id > 3")
    a.agg(["k"], n=F.count("v"))
    a.merge(a.select("k"), on=["k"], how="semi").head(3, ["id"])
    a.concat(a.drop("v")).value_counts("k")
    return a.melt(["id"], ["k", "v"])


def empty_side(spark, p):
    a, none = source(spark, p), source(spark, p).filter("id < 0")
    return a.merge(none, on=["id"]).agg(["k_x"], n=F.count(F.lit(1)))


def unknown(spark, p):
    a = source(spark, p)
    b = p.add("mine", "mine", a.df.where("id > 50"), [(a, "input")])
    c = b.assign(y=b.df["id"] + 1).apply(lambda batches: (x[["id", "y"]] for x in batches), "id long, y long")
    return c.assign(x=F.col("id")).filter("x > 60")


@pytest.mark.parametrize("build", [chain, joined, several, empty_side, unknown])
@pytest.mark.parametrize("cache", [True, False])
def test_same_numbers(spark, build, cache):
    p = Pipeline()
    build(spark, p)
    report = p.report(distinct=False, cache_shared=cache)
    for s in p.steps:
        want = facts(s.df, False)
        assert (report.facts[s.id].rows, report.facts[s.id].nulls, report.facts[s.id].dtypes) == (want.rows, want.nulls, want.dtypes), (s.id, s.op)


def test_distinct_values_are_exact(spark):
    p = Pipeline()
    chain(spark, p)
    for i, f in p.report(distinct=True).facts.items():
        assert f.n_unique == facts(p.steps[i].df, True).n_unique


def test_one_run_for_a_chain(spark):
    """A chain without joins or groups is counted by its own run alone, and settings are as they were."""
    p = Pipeline()
    chain(spark, p)
    runs = Runs(p, False, True)
    assert runs.results == [p.steps[-1].id] and len(runs.watch) < len(p.steps)
    seen = runs.run()
    assert set(seen) == {s.id for s in p.steps} and set(runs.seconds) == {p.steps[-1].id}
    assert spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) is None


def test_repeated_stages_are_counted_anew(spark, monkeypatch):
    """Numbers of a run whose stage was repeated are not used."""
    p = Pipeline()
    out = chain(spark, p)
    run = Runs._run
    monkeypatch.setattr(Runs, "_run", lambda self, i: (run(self, i), self.repeated.add(i)))
    assert Runs(p, False, True).run() == {}
    assert p.report().facts[out.step.id].rows == out.df.count()


def test_joins_behind_a_filter_of_a_join(spark):
    p = Pipeline()
    joined(spark, p)
    last = p.steps[-1]
    assert stops_early(p) == {last.inputs[1][0], p.steps[last.inputs[1][0]].inputs[0][0]}


def test_caches_are_released(spark):
    p = Pipeline()
    a = source(spark, p)
    a.agg(["k"], n=F.count("v"))
    a.filter("id / 0 > 1").sort_values("id")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        p.report()
    assert not spark._jsparkSession.sharedState().cacheManager().cachedData().nonEmpty()


# ---------------------------------------------------------------- positions and lost rows


def test_positions(spark):
    df = spark.range(5000).selectExpr("id", "IF(id % 11 = 0, NULL, (id * 7919) % 997) AS v", "id AS `a.b`").repartition(6)
    got = sorted((r["position"], r["id"]) for r in positions(df, ["v", F.col("`a.b`").desc()]).collect())
    rows = sorted(((r["v"] is None, r["v"] or 0, -r["id"], r["id"]) for r in df.collect()))
    assert got == [(i, r[-1]) for i, r in enumerate(rows)]
    assert sorted(r["id"] for r in slice_rows(df, ["v", F.col("`a.b`").desc()], 4990, 6000).collect()) == sorted(r[-1] for r in rows[4990:])
    assert positions(df.where("false"), ["v"]).count() == 0


def test_deep_rows_are_dealt_by_range(spark, monkeypatch):
    """No task holds more than its partition's share: the plan has a range exchange and no limit."""
    monkeypatch.setattr(positions_module, "SHALLOW", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones would
    p = Pipeline()
    a = p.source(spark.range(120_000).selectExpr("id", "(id * 7919) % 120000 AS v"))
    deep = a.loc(100_000, 100_010, ["v"])
    assert [r["v"] for r in deep.df.orderBy("v").collect()] == list(range(100_000, 100_010))
    assert "Limit" not in deep.df._jdf.queryExecution().executedPlan().toString()
    rows = positions(a.df, ["v"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 30_000


def test_examples_of_loc(spark):
    p = Pipeline()
    a = p.source(spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (3, None), (3, None), (4, "z")], "id long, name string"))
    part = a.loc(0, 4, ["id"])
    report = p.report()
    assert [tuple(r) for r in report.examples(part.step, "dropped", ["id"]).collect()] == [(3, None), (4, "z")]
    (found,) = [f for f in report.findings if f.kind == "row_loss"]
    assert found.message.startswith("2 of 6 rows are dropped") and found.example == "dropped"
    own = p.add("mine", "keeps some", a.df.where("id <> 3"), [(a, "input")])
    assert p.report().examples(own.step, "dropped", ["id"]).count() == 3


def test_lost_rows_of_hot_rows(spark):
    before = spark.range(900).selectExpr("IF(id % 3 = 0, 0, id) AS id", "IF(id % 3 = 0, NULL, map('a', id)) AS m", "CAST('NaN' AS DOUBLE) AS f")
    after = before.where("id > 450").union(before.where("id = 0").limit(100))
    lost = filters.lost_rows(before, after)
    assert lost.count() == 900 - after.count() and lost.where("id = 0").count() == 200
    assert filters.lost_rows(before, after, 5).count() == 5
    assert filters.lost_counts(before, before).count() == 0


def test_lineage_through_operators(spark):
    a = spark.createDataFrame([(1, [1, 2], "x")], "k long, list array<long>, s string")
    b = spark.createDataFrame([(1, "y")], "k long, s string")
    from pyspark.sql import Window

    df = a.join(b, "k").select(a["k"], F.explode("list").alias("item"), b["s"].alias("other"), a["s"])
    df = df.withColumn("n", F.sum("item").over(Window.partitionBy("other"))).unpivot(["k"], ["other", "s"], "name", "value").withColumn("v2", F.upper("value"))
    assert catalyst.origins(df, [a, b]) == {"k": [(0, "k")], "name": [], "value": [(0, "s"), (1, "s")], "v2": [(0, "s"), (1, "s")]}
    python = a.select("k", "s").mapInPandas(lambda x: x, "k2 long")
    assert catalyst.origins(python, [a]) == {"k2": [(0, "k"), (0, "s")]}


def test_null_origin_messages(spark):
    p = Pipeline()
    a, b = p.source(spark.createDataFrame([(1, "x"), (2, "y")], "k long, s string")), p.source(spark.createDataFrame([(1, 5)], "k long, n long"))
    a.merge(b, on=["k"], how="left")
    a.concat(b)
    a.map("s", {"x": 1})
    told = {f.step: f.message for f in p.report().findings if f.kind == "null_origin"}
    assert "without a match" in told[2] and "not every input" in told[3] and "expression gives null" in told[4]


def test_cross_join_counts(spark):
    p = Pipeline()
    a = p.source(spark.range(3).toDF("a")).merge(p.source(spark.range(4).toDF("b")), how="cross")
    d = p.report().facts[a.step.id].details
    assert (d["rows_left"], d["rows_right"], d["rows_out"], d["explosion_factor"]) == (3, 4, 12, 4.0)


def test_repeated_parts(spark):
    df = spark.range(10).toDF("x")
    part = df.where("x > 3").groupBy("x").count()
    renamed = df.withColumnRenamed("x", "y").where("y > 3").groupBy("y").count()
    found = catalyst.repeated({0: part.where("count > 1"), 1: part.orderBy("x"), 2: df.where("x > 4")})
    assert [users for _, users in found] == [[0, 1]]
    assert isinstance(renamed.toPandas(), pd.DataFrame)
