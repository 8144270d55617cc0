import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import groups, joins
from plumbline.plans.pipeline import Pipeline
from plumbline.plans.report import diff
from plumbline.sources.readers import Datasets, read, read_feather, variable_name
from plumbline.streaming.batches import profile_stream


@pytest.fixture(scope="module")
def revenue(spark):
    """Orders of users, of which user 4 is there twice, user 6 has no country and 7 to 9 are unknown."""
    p = Pipeline()
    orders = p.source(spark.createDataFrame([(i, u, float(i), "paid" if i % 4 else "open") for i, u in enumerate([1, 2, 4, 3, 1, 6, 7, 8, 2, 9, 1, 5])], "order_id long, user_id long, amount double, status string")).named("orders")
    users = p.source(spark.createDataFrame([(1, "US"), (2, "CA"), (3, "MX"), (4, "US"), (4, "US"), (5, "US"), (6, None)], "user_id long, country string")).named("users")
    paid = orders.filter(F.col("status") == "paid").named("paid")
    enriched = paid.merge(users, on=["user_id"], how="left").named("enriched")
    out = enriched.agg(["country"], revenue=F.sum("amount"), orders=F.count(F.lit(1))).named("by_country")
    return p, enriched, out, p.report(distinct=True)


def test_join_facts(revenue):
    p, enriched, _, report = revenue
    d = report.facts[enriched.step.id].details
    assert (d["cardinality"], d["suggested_validate"], d["validate_passes"], d["left_only"]) == ("1:m", "m:1", False, 3)
    assert d["rows_left"] == 9 and d["rows_out"] == 10 and d["explosion_factor"] == 1.1111
    assert [(s.op, s.category) for s in p.steps][2:] == [("filter", "filter"), ("merge", "join"), ("groupby", "aggregate")]
    assert report.facts[2].details == {"rows_in": 12, "rows_out": 9, "rows_dropped": 3, "pct_kept": 75.0}


def test_findings_and_examples(revenue):
    p, enriched, _, report = revenue
    kinds = {(f.kind, f.severity, f.step) for f in report.findings}
    assert {("row_loss", "info", 2), ("row_explosion", "warning", 3), ("join", "info", 3), ("null_origin", "warning", 3)} <= kinds
    rows = report.examples(enriched.step, "unmatched_left", ["order_id"]).collect()
    assert [r["user_id"] for r in rows] == [7, 8, 9] or {r["user_id"] for r in rows} == {7, 9, 8}
    assert report.examples(enriched.step, "duplicate_keys_right", ["user_id"]).count() == 2
    assert report.examples(enriched.step, "nulls", ["order_id"], column="country").count() == 4
    assert report.examples(p.steps[2], "dropped", ["order_id"]).count() == 3
    assert "warning: step 3" in report.text() and json.loads(report.to_json())["steps"][3]["op"] == "merge"


def test_checks_run_as_they_say(revenue):
    p, _, _, report = revenue
    frames = {s.name or f"step_{s.id}": s.df for s in p.steps}
    assert {c.kind for c in report.checks} >= {"unique_keys", "row_count", "not_null", "not_empty", "schema", "unique"}
    for c in report.checks:
        try:
            exec(c.code, dict(frames))  # noqa: S102
            passed = True
        except AssertionError:
            passed = False
        assert passed == c.passes, c.code
    assert report.checks_script().count("\n") == len(report.checks)


def test_hints(spark, sf):
    p = Pipeline()
    orders = p.source(spark.read.parquet(f"{sf}/orders.parquet"), "orders", "read_parquet")
    customers = p.source(spark.read.parquet(f"{sf}/customer.parquet"), "customer", "read_parquet")
    again = p.source(spark.read.parquet(f"{sf}/customer.parquet"), "customer", "read_parquet")
    joined = orders.merge(customers, left_on=["o_custkey"], right_on=["c_custkey"], how="left")
    joined.filter(F.col("c_acctbal") > 5000).select("o_orderkey", "o_totalprice").sort_values("o_orderkey").agg([], total=F.sum("o_totalprice"))
    again.select("c_name").apply(lambda batches: batches, "c_name string")
    hints = {(h.kind, h.status) for h in p.report().hints}
    assert {("join_narrowed", "actionable"), ("useless_sort", "actionable"), ("row_apply", "actionable"), ("duplicate_read", "actionable"), ("unused_columns", "auto")} <= hints


def test_unused_columns_of_a_wide_table(spark):
    p = Pipeline()
    wide = p.source(spark.createDataFrame([tuple(range(60))], [f"c{i}" for i in range(60)]))
    wide.filter("c59 > 1").select(*[f"c{i}" for i in range(55)])
    (hint,) = [h for h in p.report().hints if h.kind == "unused_columns"]
    assert hint.message.endswith("reads c55, c56, c57, c58")


def test_shared_sources_keep_their_files(spark, sf):
    p = Pipeline()
    one, two = (p.source(spark.read.parquet(f"{sf}/nation.parquet"), "nation", "read_parquet") for _ in range(2))
    for n in (one, two):
        n.select("n_name").merge(n.select("n_name", "n_regionkey"), on=["n_name"])
    r = p.report()
    assert [r.facts[s.step.id].details["files"] for s in (one, two)] == [1, 1] and "duplicate_read" in {h.kind for h in r.hints}
    assert p.steps[0].site.split(":")[0].endswith("test_report.py") and "bytes" in r.to_json()


@pytest.mark.parametrize(
    "how, condition, expected",
    [
        ("inner", "country = 'US'", True),
        ("left", "country = 'US'", False),
        ("left", "amount > 20", True),
        ("inner", "amount > 20 AND country = 'US'", False),
        ("inner", "amount > 1", False),
        ("outer", "amount > 20", False),
        ("inner", "user_id = 1", True),
        ("left", "user_id = 1", True),
    ],
)
def test_filter_before_join(spark, how, condition, expected):
    p = Pipeline()
    orders = p.source(spark.createDataFrame([(1, 10.0), (2, 20.0), (1, 30.0), (3, 40.0)], "user_id long, amount double"))
    users = p.source(spark.createDataFrame([(1, "US"), (2, "MX"), (3, "CA")], "user_id long, country string"))
    orders.merge(users, on=["user_id"], how=how).filter(condition)
    assert ("filter_before_join" in {h.kind for h in p.report().hints}) is expected


@pytest.mark.parametrize(
    "build, expected",
    [
        (lambda o: o.sort_values("amount").filter("amount > 20"), {"filter_earlier"}),
        (lambda o: o.assign(big=F.col("amount") * 2).filter("big > 40"), set()),
        (lambda o: o.assign(big=F.col("amount") * 2).filter("amount > 20"), {"filter_earlier"}),
        (lambda o: o.fillna({"amount": 0.0}).filter("amount > 20"), set()),
        (lambda o: o.sort_values("amount").agg(["user_id"], total=F.sum("amount")), {"useless_sort"}),
        (lambda o: o.sort_values("amount").agg(["user_id"], top=F.first("amount")), set()),
        (lambda o: o.sort_values("amount").agg(["user_id"], top=F.last("amount")), set()),
        (lambda o: o.sort_values("amount").sort_values("user_id"), {"useless_sort"}),
    ],
)
def test_order_hints(spark, build, expected):
    p = Pipeline()
    build(p.source(spark.createDataFrame([(1, 10.0), (2, 20.0), (1, 30.0), (3, 40.0)], "user_id long, amount double")))
    assert {h.kind for h in p.report().hints} - {"unused_columns"} == expected


def test_intended_types_are_no_drift(spark):
    p = Pipeline()
    a = p.source(spark.createDataFrame([(1, "x")], "a long, b string"))
    a.assign(a=F.col("a").cast("string")).map("b", {"x": 1}).astype({"b": "string"}).fillna({"b": "0"})
    assert not [f for f in p.report().findings if f.kind == "dtype_drift"]
    b = a.isin("b", ["x"], "is_x").running(["b"], ["a"], n=F.count(F.lit(1))).rank(["b"], "a", "r").get_dummies("b", ["x"])
    assert [s.category for s in p.steps[-4:]] == ["mutate", "mutate", "mutate", "reshape"] and b.df.count() == 1
    assert a.describe(["a"]).step.category == a.crosstab("a", "b", ["x"]).step.category == "aggregate" and a.concat_columns(a.rename({"b": "c"}), ["a"]).df.columns == ["a", "b", "c"]
    with pytest.raises(ValueError, match="no examples"):
        p.report().examples(a.head(1, ["a"]).step, "dropped", ["a"])


def test_diff(spark):
    p = Pipeline()
    a = p.source(spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "a long, b long, c string"))
    b = a.rename({"a": "id"}).fillna({"b": 0}).astype({"c": "binary"})
    report = p.report()
    d = diff(report, a.step.id, b.step.id)
    assert d["relation"] == "ancestor" and d["path"] == [0, 1, 2, 3] and d["rows"] == (2, 2)
    assert d["columns"] == {"id": "renamed from a", "b": "changed", "c": "changed"}
    assert diff(report, 3, 0)["relation"] == "descendant"


def test_types_suffixes_and_steps(spark):
    p = Pipeline(max_steps=5)
    a = p.source(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k long, v long"))
    b = p.source(spark.createDataFrame([(1.0, 1), (3.0, 2), (None, 3)], "k double, v long"))
    m = a.merge(b, on=["k"])
    report = p.report()
    assert sorted(m.df.columns) == ["k", "v_x", "v_y"]
    assert any("keys differ in type" in f.message for f in report.findings) and any("suffixes" in f.message for f in report.findings) and any("null keys" in f.message for f in report.findings)
    for _ in range(9):
        a = a.filter("v > 0")
    assert len(p.steps) == 5 and p.warnings
    with pytest.raises(ValueError, match="repeat"):
        p.source(spark.sql("SELECT 1 AS x, 2 AS x"))


def test_reshape(spark):
    p = Pipeline()
    wide = p.source(spark.createDataFrame([("a", 10, 20, None), ("b", 90, 95, 99.0), ("c", 100, 5, 91.0)], "store string, jan long, feb long, mar double"))
    long = wide.assign(jan=F.col("jan").cast("double"), feb=F.col("feb").cast("double")).melt(["store"], var_name="month", value_name="sales")
    kept = long.dropna(["sales"])
    assert (long.df.count(), kept.df.count(), kept.filter("sales >= 90").df.count()) == (9, 8, 5)
    assert not [f for f in p.report().findings if f.kind == "null_origin" and f.step == long.step.id]
    with pytest.raises(Exception, match="several values"):
        wide.concat(wide).pivot(["store"], "store", ["a"], "jan").df.collect()


def test_group_stats_of_nothing(spark):
    none = spark.createDataFrame([], "k long")
    assert groups.size_histogram(none, ["k"]).count() == 0
    row = joins.join_stats(none, none, ["k"]).first()
    assert row["rows_out"] == 0 and row["explosion_factor"] is None


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    for fmt, write in {"csv": lambda p: df.write.option("header", True).csv(p), "tsv": lambda p: df.write.options(header=True, sep="\t").csv(p), "jsonl": lambda p: df.write.json(p), "parquet": lambda p: df.write.parquet(p), "orc": lambda p: df.write.orc(p)}.items():
        write(path := str(tmp_path / f"t.{fmt}"))
        got = read(spark, path)
        assert got.count() == 2 and got.where("b IS NULL").count() == 1, fmt
    (tmp_path / "one.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert read(spark, str(tmp_path / "one.json")).count() == 2
    from pyarrow import Table, feather

    feather.write_feather(Table.from_pylist([{"a": 1}, {"a": 2}]), tmp_path / "t.feather")
    assert read_feather(spark, str(tmp_path / "t.feather")).count() == 2
    sets = Datasets(spark)
    assert sets.add(str(tmp_path / "t.parquet"), "mine") == "mine" and sets.referenced("SELECT * FROM mine") == ["mine"] and sets.get("mine").count() == 2
    golden = {"orders": "orders", "Q3 Sales-2024": "q3_sales_2024", "2024_orders": "data_2024_orders", "class": "class_df", "pd": "pd_df", "sum": "sum_df", "---": "data"}
    assert {s: variable_name(s) for s in golden} == golden
    for name, text, n in [("lines.json", '{"a": 1}\n{"a": 2}\n{"a": 3}\n', 3), ("object.json", '{\n"a": 1\n}', 1), ("t.txt", "a,b\n1,2\n", 1)]:
        (tmp_path / name).write_text(text)
        assert read(spark, str(tmp_path / name)).count() == n and read(spark, str(tmp_path / name)).columns[0] == "a", name
    with pytest.raises(ValueError, match="no reader"):
        read(spark, str(tmp_path / "t.xyz"))


def test_stream_profile(spark, sf, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    profile_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["column"]: r["rows"] for r in rows}["event_id"] == 1000
