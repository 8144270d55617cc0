"""Exact percentiles against Spark's own, which holds the values of a group in one task."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import reshape

NAN, INF = float("nan"), float("inf")
_RNG = np.random.default_rng(5)
#: An outlier beside values that differ in their last bits only, within one bucket of the first two histograms.
NESTED = [1.0, 1.0001, *(1.00005 + 2.0**-52 * _RNG.integers(0, 10**6, 300)).tolist()]
VALUES = {
    "ordinary": _RNG.normal(0, 1000, 500).round(2).tolist(),
    "spread": (10.0 ** _RNG.uniform(-300, 300, 300) * _RNG.choice([-1, 1], 300)).tolist(),
    "nested": NESTED,
    "odd": [NAN, INF, -INF, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, None, 2.0, 2.0],
    "one": [3.5, None],
    "none": [None, None],
}
FRACTIONS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.995, 1.0)


def same(a, b) -> bool:
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-14, abs_tol=1e-320)))


@pytest.mark.parametrize("keys", [[], ["k"], ["k.x", "f"]])
def test_describe_is_exact_without_values_in_one_task(spark, keys):
    rows = [(name if name != "one" else None, NAN if i % 2 else None, None if v is None else int(min(max(v, -1e15), 1e15)) if v == v else 7, v) for name, vs in VALUES.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, f double, n long, v double").repartition(5)
    df, by = (df.withColumnRenamed("k", "k.x"), ["`k.x`", "f"]) if "f" in keys else (df, keys)
    found = reshape.describe(df, ["v", "n"], by, FRACTIONS)
    whats = [f"p{100 * p:g}" for p in FRACTIONS]
    plain = df.groupBy(*by).agg(*[F.percentile(c, F.lit(p)).alias(f"{c}_{w}") for c in ("v", "n") for p, w in zip(FRACTIONS, whats, strict=True)], F.count("v").alias("v_count"), F.max("n").alias("n_max"))
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString().replace("plumbline", "")
    assert found.columns[: len(keys)] == keys and found.columns[len(keys)] == "v_count" and found.columns[-1] == "n_max"
    index = lambda frame: {tuple(str(x) for x in r[: len(keys)]): r.asDict() for r in frame.collect()}
    a, b = index(found), index(plain)
    assert a.keys() == b.keys()
    for k, row in b.items():
        assert all(same(a[k][c], x) for c, x in list(row.items())[len(keys) :]), (k, a[k], row)


def test_describe_of_no_rows_and_no_percentiles(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert [r.asDict() for r in reshape.describe(df, ["v"]).collect()] == [{"v_count": 0, "v_mean": None, "v_std": None, "v_min": None, "v_p25": None, "v_p50": None, "v_p75": None, "v_max": None}]
    assert reshape.describe(df, ["v"], ["k"]).collect() == []
    assert reshape.describe(df, ["v"], percentiles=()).columns == ["v_count", "v_mean", "v_std", "v_min", "v_max"]
