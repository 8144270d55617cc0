"""One query for each operator, with its SQL. Each runs over whole tables through the package's operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import mode_first, nunique, to_datetime, to_numeric
from plumbline.operators import filters, groups, joins, positions, profile, reshape
from plumbline.operators.apply import apply_groups, combine_groups
from plumbline.plans import catalyst
from plumbline.plans.contract import Contract, violating_rows, violations
from plumbline.plans.pipeline import Frame, Pipeline
from plumbline.plans.report import diff, diff_text
from plumbline.sources.catalog import Catalog
from plumbline.sources.readers import Datasets, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Nulls in orders: the tables hold none.
WITH_NULLS = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"
STATUS_NULLS = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.pipeline = spark, sf_dir, Pipeline()

    def __getattr__(self, name: str) -> Frame:
        return self.pipeline.source(self.spark.read.parquet(f"{self.dir}/{name}.parquet"), name, "read_parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], Frame | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(Tables(spark, sf_dir))
            return out.df if isinstance(out, Frame) else out

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


def nulled(t: Tables) -> Frame:
    return t.orders.select("o_orderkey", "o_custkey", F.expr(WITH_NULLS).alias("price"), F.expr(STATUS_NULLS).alias("status"))


NULLED = f"(SELECT o_orderkey, o_custkey, {WITH_NULLS} AS price, {STATUS_NULLS} AS status FROM orders)"

# ---------------------------------------------------------------- profiles

_TYPES = {"bigint": "bigint", "double": "double", "string": "string"}
_profile_sql = lambda table, columns: " UNION ALL ".join(f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS null_count, 0::BIGINT AS nan_count, count(DISTINCT {c}) AS n_unique FROM {table} t" for i, (c, t) in enumerate(columns))

query("profile_orders", _profile_sql("orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]))(lambda t: profile.profile(t.orders.df))
query("profile_nulls", _profile_sql(NULLED, [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("price", "double"), ("status", "string")]))(lambda t: profile.profile(nulled(t).df))
query("profile_lineitem", _profile_sql("lineitem", [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]))(lambda t: profile.profile(t.lineitem.df))
query("sample_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")(lambda t: profile.sample_rows(t.orders.df.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]))

# ---------------------------------------------------------------- columns and rows

query("select_cols", "SELECT c_custkey, c_name FROM customer")(lambda t: t.customer.select("c_custkey", "c_name"))
query("drop_rename", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")(lambda t: t.customer.drop("c_nationkey", "c_mktsegment").rename({"c_custkey": "id", "c_name": "name"}))
query("select_dtypes", "SELECT p_name, p_brand, p_type FROM part")(lambda t: t.part.select_dtypes("string"))
query("filter_columns", "SELECT o_orderkey, o_custkey FROM orders")(lambda t: t.orders.filter_columns("key"))
query("filter_mask", "SELECT * FROM orders WHERE o_totalprice > 100000")(lambda t: t.orders.filter(F.col("o_totalprice") > 100000))
query("filter_query", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000")(lambda t: t.orders.filter("o_orderstatus = 'F' AND o_totalprice < 50000"))
query("filter_null_mask", f"SELECT * FROM {NULLED} t WHERE price > 50000")(lambda t: nulled(t).filter(F.col("price") > 50000))
query("dropna_subset", f"SELECT * FROM {NULLED} t WHERE price IS NOT NULL")(lambda t: nulled(t).dropna(["price"]))
query("dropna_all", f"SELECT * FROM {NULLED} t WHERE price IS NOT NULL OR status IS NOT NULL")(lambda t: nulled(t).dropna(["price", "status"], how="all"))
query("drop_duplicates_first", "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")(lambda t: t.orders.drop_duplicates(["o_custkey"], ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice"))
query("isin", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS wanted FROM customer")(lambda t: t.customer.assign(wanted=F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "wanted"))
query("head", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 10")(lambda t: t.events.select("event_id", "user_id").head(10, ["event_id"]))
query("tail", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 10")(lambda t: t.events.select("event_id", "user_id").tail(10, ["event_id"]))
query("loc_positional", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")(lambda t: t.orders.select("o_orderkey", "o_custkey").loc(5, 15, ["o_orderkey"]))
query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda t: t.orders.select("o_orderkey", "o_totalprice").nlargest(25, "o_totalprice", ["o_orderkey"]))
query("bottom_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")(lambda t: t.orders.select("o_orderkey", "o_totalprice").nsmallest(25, "o_totalprice", ["o_orderkey"]))
query("sample_fraction")(lambda t: t.orders.sample(0.1, 7).select("o_orderkey"))
query("reindex_left", "SELECT c.c_custkey, n.user_id IS NOT NULL AS found FROM customer c LEFT JOIN (SELECT DISTINCT user_id FROM events) n ON c.c_custkey = n.user_id")(lambda t: t.events.select(F.col("user_id").alias("c_custkey"), "user_id").drop_duplicates(["c_custkey"], ["user_id"]).reindex(t.customer.df, ["c_custkey"]).select("c_custkey", F.col("user_id").isNotNull().alias("found")))
query("sort_values", "SELECT o_orderkey, price FROM (SELECT o_orderkey, " + WITH_NULLS + " AS price FROM orders) ORDER BY price ASC NULLS LAST, o_orderkey")(lambda t: nulled(t).select("o_orderkey", "price").sort_values("price", "o_orderkey"))

# ---------------------------------------------------------------- joins

ON = "FROM customer c {} JOIN events e ON c.c_custkey = e.user_id"
for how in ("inner", "left", "right", "outer"):
    sql_how = {"outer": "FULL"}.get(how, how.upper())
    query(f"merge_{how}", f"SELECT c_custkey, c_name, event_id, user_id {ON.format(sql_how)}")(
        lambda t, how=how: t.customer.select("c_custkey", "c_name").merge(t.events.select("event_id", "user_id"), left_on=["c_custkey"], right_on=["user_id"], how=how)
    )
query("merge_cross", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")(lambda t: t.region.select("r_regionkey").merge(t.nation.select("n_nationkey"), how="cross"))
query("merge_natural", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")(lambda t: t.documents.select("doc_id", "lang").merge(t.labels.select("doc_id", "quality")))
query("merge_suffixes", "SELECT a.o_orderkey, a.o_custkey AS o_custkey_x, b.o_custkey AS o_custkey_y FROM orders a JOIN orders b USING (o_orderkey)")(lambda t: t.orders.select("o_orderkey", "o_custkey").merge(t.orders.select("o_orderkey", "o_custkey"), on=["o_orderkey"]))
query("merge_null_safe", f"SELECT o_orderkey, a.status, b.n FROM {NULLED} a JOIN (SELECT status, count(*) AS n FROM {NULLED} t GROUP BY 1) b ON a.status IS NOT DISTINCT FROM b.status")(
    lambda t: nulled(t).select("o_orderkey", "status").merge(nulled(t).agg(["status"], n=F.count(F.lit(1))), on=["status"], null_safe=True).select("o_orderkey", "status", "n")
)
query("semi_matched", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")(lambda t: t.customer.merge(t.events, left_on=["c_custkey"], right_on=["user_id"], how="semi").select("c_custkey"))
query("anti_unmatched", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")(lambda t: t.customer.merge(t.events, left_on=["c_custkey"], right_on=["user_id"], how="anti").select("c_custkey"))
query("concat_missing_cols", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")(
    lambda t: t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).concat(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("segment")))
)
query("concat_axis1", "SELECT doc_id, d.lang, l.toxic FROM documents d FULL JOIN labels l USING (doc_id)")(lambda t: joins.concat_columns(t.documents.df.select("doc_id", "lang"), t.labels.df.select("doc_id", "toxic"), ["doc_id"]))

# ---------------------------------------------------------------- aggregates

query("group_named_agg", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")(
    lambda t: t.lineitem.filter("l_shipdate <= timestamp_ntz'1998-09-02'").agg(["l_returnflag", "l_linestatus"], sum_qty=F.round(F.sum("l_quantity"), 2), revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), avg_disc=F.round(F.avg("l_discount"), 6), n=F.count(F.lit(1)))
)
query("group_min_max_count", f"SELECT o_custkey, min(price) AS lo, max(price) AS hi, count(price) AS n FROM {NULLED} t GROUP BY o_custkey")(lambda t: nulled(t).agg(["o_custkey"], lo=F.min("price"), hi=F.max("price"), n=F.count("price")))
query("group_dropna", f"SELECT status, count(*) AS n FROM {NULLED} t WHERE status IS NOT NULL GROUP BY status")(lambda t: nulled(t).agg(["status"], dropna=True, n=F.count(F.lit(1))))
query("group_keepna", f"SELECT status, count(*) AS n FROM {NULLED} t GROUP BY status")(lambda t: nulled(t).agg(["status"], n=F.count(F.lit(1))))
query("group_median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY 1")(lambda t: t.orders.describe(["o_totalprice"], ["o_orderpriority"], (0.5,)).df.select("o_orderpriority", F.round("o_totalprice_p50", 4).alias("mid")))
query("group_nunique", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")(lambda t: t.orders.agg(["o_orderstatus"], customers=F.count_distinct("o_custkey")))
query("group_first_last", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")(lambda t: t.orders.agg(["o_custkey"], first_price=mode_first("o_totalprice", "o_orderkey"), last_price=mode_first("o_totalprice", "o_orderkey", last=True)))
query("group_std_var", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")(lambda t: t.lineitem.agg(["l_returnflag"], std=F.round(F.stddev_samp("l_quantity"), 6), var=F.round(F.var_samp("l_quantity"), 6)))
query("group_prod", "SELECT n_regionkey, product(1 + n_nationkey) AS prod FROM nation GROUP BY 1")(lambda t: t.nation.agg(["n_regionkey"], prod=F.product(F.col("n_nationkey") + 1)))
query("group_size", "SELECT user_id, count(*) AS size FROM events GROUP BY 1")(lambda t: groups.group_sizes(t.events.df, ["user_id"]))
query("group_transform", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")(lambda t: t.orders.transform(["o_custkey"], most=F.max("o_totalprice")).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("most"), 6).alias("share")))
query("group_filter", "SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 12")(lambda t: t.orders.transform(["o_custkey"], n=F.count(F.lit(1))).filter("n > 12").select("o_orderkey"))
query("per_group_head", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")(lambda t: filters.numbered(t.orders.df, ["o_custkey"], ["o_orderkey"]).where("__n <= 3").select("o_custkey", "o_orderkey"))
query("per_group_tail", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 2")(lambda t: filters.numbered(t.orders.df, ["o_custkey"], [F.col("o_orderkey").desc()]).where("__n <= 2").select("o_custkey", "o_orderkey"))
query("group_cumsum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS total FROM events")(lambda t: groups.running(t.events.df, ["user_id"], ["event_id"], total=F.sum("value")).select("event_id", F.round("total", 3).alias("total")))
query("group_cumcount", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events")(lambda t: groups.running(t.events.df, ["user_id"], ["event_id"], n=F.count(F.lit(1))).select("event_id", (F.col("n") - 1).alias("n")))
for method, sql in {"average": "(2 * rank() OVER w + count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0::DOUBLE", "min": "rank() OVER w", "dense": "dense_rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1"}.items():
    kind = {"average": "DOUBLE", "max": "BIGINT"}.get(method, "INTEGER")
    query(f"group_rank_{method}", f"SELECT o_orderkey, ({sql})::{kind} AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")(lambda t, method=method: groups.rank(t.orders.df, ["o_custkey"], "o_orderpriority", "r", method).select("o_orderkey", "r"))
query("group_idxmax", "SELECT user_id, event_id AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")(lambda t: t.events.agg(["user_id"], at=F.max_by("event_id", F.struct("value", -F.col("event_id")))))
query("group_idxmin", "SELECT user_id, event_id AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n = 1")(lambda t: t.events.agg(["user_id"], at=F.min_by("event_id", F.struct("value", "event_id"))))
query("group_rank_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS r FROM orders")(lambda t: t.orders.rank(["o_custkey"], "o_orderkey", "r", "first").select("o_orderkey", "r"))
query("group_value_counts", "SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL")(lambda t: t.events.agg(["user_id", "event_type"], count=F.count(F.lit(1))))
query("group_describe", "SELECT l_returnflag, count(l_quantity) AS l_quantity_count, round(avg(l_quantity), 6) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, quantile_cont(l_quantity, 0.25) AS l_quantity_p25, quantile_cont(l_quantity, 0.5) AS l_quantity_p50, quantile_cont(l_quantity, 0.75) AS l_quantity_p75, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY 1")(
    lambda t: reshape.describe(t.lineitem.df, ["l_quantity"], ["l_returnflag"]).withColumn("l_quantity_mean", F.round("l_quantity_mean", 6)).drop("l_quantity_std")
)
query("agg_global", "SELECT count(*) AS n, round(avg(c_acctbal), 4) AS balance, count(DISTINCT c_mktsegment) AS segments FROM customer")(lambda t: t.customer.agg([], n=F.count(F.lit(1)), balance=F.round(F.avg("c_acctbal"), 4), segments=F.count_distinct("c_mktsegment")))
query("value_counts", f"SELECT status, count(*) AS count FROM {NULLED} t WHERE status IS NOT NULL GROUP BY 1")(lambda t: nulled(t).value_counts("status"))
query("value_counts_normalize", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 9) AS proportion FROM events GROUP BY 1")(lambda t: reshape.value_counts(t.events.df, "event_type", normalize=True).withColumn("proportion", F.round("proportion", 9)))
query("describe", "SELECT count(o_totalprice) AS o_totalprice_count, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, min(o_totalprice) AS o_totalprice_min, round(quantile_cont(o_totalprice, 0.25), 4) AS o_totalprice_p25, round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice_p50, round(quantile_cont(o_totalprice, 0.75), 4) AS o_totalprice_p75, max(o_totalprice) AS o_totalprice_max FROM orders")(
    lambda t: reshape.describe(t.orders.df, ["o_totalprice"]).select(*[F.round(f"o_totalprice_{k}", 4).alias(f"o_totalprice_{k}") if k not in ("count", "min", "max") else F.col(f"o_totalprice_{k}") for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")])
)
STATUSES, TYPES = ["F", "O", "P"], ["click", "error", "purchase", "signup", "view"]
query("pivot_table", "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS \"{s}\"" for s in STATUSES) + " FROM orders GROUP BY 1")(lambda t: t.orders.pivot_table(["o_orderpriority"], "o_orderstatus", STATUSES, F.round(F.sum("o_totalprice"), 2)))
query("crosstab", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS \"{s}\"" for s in TYPES) + " FROM events GROUP BY 1")(lambda t: reshape.crosstab(t.events.df, "user_id", "event_type", TYPES))

# ---------------------------------------------------------------- shapes and values

query("melt", "SELECT p_partkey, 'p_retailprice' AS variable, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::DOUBLE FROM part")(lambda t: t.part.select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")).melt(["p_partkey"]))
query("pivot", "SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1")(lambda t: t.labels.melt(["doc_id"]).pivot(["doc_id"], "variable", ["quality", "toxic"], "value"))
query("explode_embedding", "SELECT vec_id, count(*) AS n, round(sum(x), 3) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")(lambda t: t.embeddings.explode("embedding").agg(["vec_id"], n=F.count(F.lit(1)), total=F.round(F.sum(F.col("embedding").cast("double")), 3)))
query("get_dummies", "SELECT event_id, " + ", ".join(f"(event_type = '{s}')::INTEGER AS event_type_{s}" for s in TYPES) + " FROM events")(lambda t: reshape.get_dummies(t.events.df.select("event_id", "event_type"), "event_type", TYPES))
query("assign", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")(lambda t: t.lineitem.assign(net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_orderkey", "l_linenumber", "net"))
query("astype", "SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, CAST(o_orderkey AS DOUBLE) AS as_double FROM orders")(lambda t: t.orders.assign(as_double=F.col("o_orderkey")).astype({"o_custkey": "string", "as_double": "double"}).select("o_orderkey", "o_custkey", "as_double"))
query("to_numeric_coerce", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand, TRY_CAST(p_name AS DOUBLE) AS name FROM part")(lambda t: t.part.assign(brand=to_numeric(F.replace("p_brand", F.lit("Brand#"), F.lit("")), coerce=True), name=to_numeric("p_name", coerce=True)).select("p_partkey", "brand", "name"))
query("to_datetime_coerce", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS at FROM orders")(lambda t: t.orders.assign(at=to_datetime(F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.col("o_orderdate").cast("string")), coerce=True)).select("o_orderkey", "at"))
query("fillna_after_left_join", "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")(lambda t: t.documents.select("doc_id").merge(t.labels.select("doc_id", "toxic"), how="left").fillna({"toxic": -1}))
query("where_mask", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")(lambda t: t.orders.where("o_totalprice", F.col("o_totalprice") > 1000).mask("o_orderstatus", F.col("o_orderstatus") == "F", "done").select("o_orderkey", "o_totalprice", "o_orderstatus"))
query("replace_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")(lambda t: t.orders.replace("o_orderstatus", {"F": "final", "O": "open"}).select("o_orderkey", "o_orderstatus"))
query("map_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS o_orderstatus FROM orders")(lambda t: t.orders.map("o_orderstatus", {"F": 1, "O": 2}).select("o_orderkey", "o_orderstatus"))

# ---------------------------------------------------------------- what steps do


def _join_sql(left: str, lk: str, right: str, rk: str, how: str) -> str:
    extra = {"inner": "0", "left": "sum(CASE WHEN nr IS NULL OR k IS NULL THEN nl ELSE 0 END)"}[how]
    return f"""
    WITH a AS (SELECT {lk} AS k, count(*) AS nl FROM {left} t GROUP BY 1), b AS (SELECT {rk} AS k, count(*) AS nr FROM {right} t GROUP BY 1),
    j AS (SELECT coalesce(a.k, b.k) AS k, nl, nr FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k),
    s AS (SELECT sum(nl)::BIGINT AS rows_left, sum(nr)::BIGINT AS rows_right,
      coalesce(sum(nl * nr) FILTER (k IS NOT NULL), 0)::BIGINT AS rows_inner, coalesce(sum(nl) FILTER (nr IS NOT NULL AND k IS NOT NULL), 0)::BIGINT AS left_matched,
      coalesce(sum(nr) FILTER (nl IS NOT NULL AND k IS NOT NULL), 0)::BIGINT AS right_matched, coalesce(sum(nl - 1), 0)::BIGINT AS left_duplicate_keys, coalesce(sum(nr - 1), 0)::BIGINT AS right_duplicate_keys,
      coalesce(sum(nl) FILTER (k IS NULL), 0)::BIGINT AS left_null_keys, coalesce(sum(nr) FILTER (k IS NULL), 0)::BIGINT AS right_null_keys, coalesce({extra}, 0)::BIGINT AS extra FROM j)
    SELECT rows_left, rows_right, left_matched, right_matched, left_duplicate_keys, right_duplicate_keys, left_null_keys, right_null_keys, rows_left - left_matched AS left_only, rows_right - right_matched AS right_only,
      rows_inner + extra AS rows_out, round((rows_inner + extra) / rows_left, 4) AS explosion_factor,
      (CASE WHEN left_duplicate_keys = 0 THEN '1' ELSE 'm' END) || ':' || (CASE WHEN right_duplicate_keys = 0 THEN '1' ELSE 'm' END) AS cardinality, 'm:1' AS suggested_validate, right_duplicate_keys = 0 AS validate_passes FROM s"""


for name, (lt, lk, rt, rk, how) in {
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey", "inner"),
    "customer_orders": ("customer", "c_custkey", "orders", "o_custkey", "left"),
    "documents_labels": ("documents", "doc_id", "labels", "doc_id", "left"),
    "orders_events": ("orders", "o_custkey", "events", "user_id", "inner"),
    "lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey", "left"),
}.items():
    query(f"join_stats_{name}", _join_sql(lt, lk, rt, rk, how))(lambda t, lt=lt, lk=lk, rt=rt, rk=rk, how=how: joins.join_stats(getattr(t, lt).df, getattr(t, rt).df, [lk], [rk], how))
query("join_stats_null_keys", _join_sql(NULLED, "status", "(SELECT DISTINCT status FROM " + NULLED + " u)", "status", "left"))(lambda t: joins.join_stats(nulled(t).df, nulled(t).df.select("status").distinct(), ["status"], how="left"))
query("filter_stats", "SELECT *, rows_in - rows_out AS rows_dropped, round(100.0::DOUBLE * rows_out / rows_in, 2) AS pct_kept FROM (SELECT count(*) AS rows_in, count(*) FILTER (o_totalprice > 100000) AS rows_out FROM orders)")(lambda t: filters.filter_stats(t.orders.df, F.col("o_totalprice") > 100000))
query("group_size_stats", "SELECT count(*) AS n_groups, min(n) AS size_min, median(n) AS size_median, max(n) AS size_max FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")(lambda t: groups.group_stats(t.orders.df, ["o_custkey"]))
query("group_size_histogram", "WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), e AS (SELECT min(n) AS lo, max(n) AS hi, least(10, max(n) - min(n) + 1) AS b FROM s), c AS (SELECT lo, hi, b, least(b - 1, greatest(0, ceil((n - lo) * b / greatest(hi - lo, 1)) - 1))::INTEGER AS bin FROM s, e) SELECT bin, round(lo + bin * (hi - lo) / b, 2) AS bin_start, round(lo + (bin + 1) * (hi - lo) / b, 2) AS bin_end, count(*) AS n_groups FROM c GROUP BY bin, lo, hi, b")(lambda t: groups.size_histogram(t.orders.df, ["o_custkey"]))
query("unmatched_left", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: joins.unmatched(t.documents.df, t.labels.df, ["doc_id"]).select("doc_id"))
query("duplicate_key_rows", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)")(lambda t: joins.duplicate_key_rows(t.events.df, ["user_id"]).select("event_id", "user_id"))
query("null_key_rows", f"SELECT o_orderkey FROM {NULLED} t WHERE status IS NULL")(lambda t: joins.null_key_rows(nulled(t).df, ["status"]).select("o_orderkey"))
query("dropped_rows_filter", f"SELECT o_orderkey FROM {NULLED} t WHERE NOT coalesce(price > 50000, false)")(lambda t: filters.dropped_rows(nulled(t).df, F.col("price") > 50000).select("o_orderkey"))
query("dropped_rows_dropna", f"SELECT o_orderkey FROM {NULLED} t WHERE price IS NULL OR status IS NULL")(lambda t: filters.missing_rows(nulled(t).df, ["price", "status"]).select("o_orderkey"))
query("dropped_rows_dedupe", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")(lambda t: filters.duplicates(t.orders.df, ["o_custkey"], ["o_orderkey"]).select("o_orderkey"))


def revenue(t: Tables) -> Frame:
    """Documents with their labels by language: the flagship pipeline."""
    docs = t.documents.select("doc_id", "lang", "n_chars").named("docs")
    long = docs.filter(F.col("n_chars") > 500).named("long")
    both = long.merge(t.labels.select("doc_id", "toxic").named("labels"), on=["doc_id"], how="left").named("both")
    return both.agg(["lang"], n=F.count(F.lit(1)), labelled=F.count("toxic"), toxic=F.sum("toxic")).named("by_lang")


query("pipeline_by_lang", "SELECT lang, count(*) AS n, count(toxic) AS labelled, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 500 GROUP BY 1")(revenue)
query("row_flow", "SELECT 1::INTEGER AS id, 'select' AS op, (SELECT count(*) FROM documents) AS rows UNION ALL SELECT 2, 'filter', (SELECT count(*) FROM documents WHERE n_chars > 500) UNION ALL SELECT 0, 'read_parquet', (SELECT count(*) FROM documents) UNION ALL SELECT 3, 'read_parquet', (SELECT count(*) FROM labels) UNION ALL SELECT 4, 'select', (SELECT count(*) FROM labels) UNION ALL SELECT 5, 'merge', (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 500) UNION ALL SELECT 6, 'groupby', (SELECT count(DISTINCT lang) FROM documents WHERE n_chars > 500)")(
    lambda t: revenue(t).pipeline.report().as_dataframes(t.spark)["steps"].select("id", "op", "rows")
)
query("null_origin_by_step", "SELECT 5::INTEGER AS step, 'toxic' AS \"column\", 'null_origin' AS kind")(lambda t: revenue(t).pipeline.report().as_dataframes(t.spark)["findings"].where("kind = 'null_origin'").select("step", "column", "kind"))
query("findings")(lambda t: revenue(t).pipeline.report().as_dataframes(t.spark)["findings"])

# ---------------------------------------------------------------- more verbs

query("column", "SELECT c_name FROM customer")(lambda t: t.customer.column("c_name"))
query("to_frame", "SELECT c_mktsegment AS segment FROM customer")(lambda t: t.customer.column("c_mktsegment").to_frame("segment"))
query("rename_axis", "SELECT c_custkey AS id, c_name FROM customer")(lambda t: t.customer.select("c_custkey", "c_name").rename_axis({"c_custkey": "id"}))
query("set_index", "SELECT n_name, n_nationkey, n_regionkey FROM nation")(lambda t: t.nation.set_index("n_name"))
query("reset_index", "SELECT n_name, n_nationkey FROM nation")(lambda t: t.nation.select("n_nationkey", "n_name").set_index("n_name").reset_index())
query("copy", "SELECT * FROM supplier")(lambda t: t.supplier.copy())
query("filter_items", "SELECT p_partkey, p_size FROM part")(lambda t: t.part.filter_columns(items=["p_partkey", "p_size", "absent"]))
query("filter_regex", "SELECT o_orderdate, o_orderpriority, o_orderstatus FROM orders")(lambda t: t.orders.filter_columns(regex="(date|y|status)$").drop("o_orderkey", "o_custkey"))
query("sort_index", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC")(lambda t: t.orders.select("o_custkey", "o_orderkey").sort_index("o_custkey", "o_orderkey", ascending=False))
query("sort_mixed", "SELECT o_orderkey, status FROM (SELECT * FROM " + NULLED + " t ORDER BY status DESC NULLS LAST, o_orderkey LIMIT 50)")(lambda t: nulled(t).select("o_orderkey", "status").sort_values("status", "o_orderkey", ascending=[False, True]).df.limit(50))
query("dropna_thresh", f"SELECT o_orderkey FROM {NULLED} t WHERE (price IS NOT NULL)::INTEGER + (status IS NOT NULL)::INTEGER >= 1")(lambda t: nulled(t).dropna(["price", "status"], thresh=1).select("o_orderkey"))
query("dropped_rows_thresh", f"SELECT o_orderkey FROM {NULLED} t WHERE (price IS NOT NULL)::INTEGER + (status IS NOT NULL)::INTEGER < 2")(lambda t: filters.missing_rows(nulled(t).df, ["price", "status"], thresh=2).select("o_orderkey"))
query("drop_duplicates_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda t: t.orders.drop_duplicates(["o_custkey"], ["o_orderkey"], keep="last").select("o_custkey", "o_orderkey"))
query("drop_duplicates_none", "SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2 HAVING count(*) = 1")(lambda t: t.orders.drop_duplicates(["o_custkey", "o_orderdate"], ["o_orderkey"], keep="none").select("o_custkey", "o_orderdate", "o_orderkey"))
query("dropped_rows_dedupe_none", "SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n > 1")(lambda t: filters.duplicates(t.orders.df, ["o_custkey", "o_orderdate"], ["o_orderkey"], "none").select("o_orderkey"))
query("map_function", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")(lambda t: t.customer.select("c_custkey", "c_name").map("c_name", F.upper))
query("isin_verb", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS closed FROM orders")(lambda t: t.orders.isin("o_orderstatus", ["F", "P"], "closed").select("o_orderkey", "closed"))
query("convert_dtypes", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS l_quantity, l_discount FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").convert_dtypes())
query("join_verb", "SELECT c.c_custkey, c_name, n FROM customer c LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) o USING (c_custkey)")(
    lambda t: t.customer.select("c_custkey", "c_name").join(t.orders.rename({"o_custkey": "c_custkey"}).agg(["c_custkey"], n=F.count(F.lit(1))), on=["c_custkey"])
)
query("concat_columns_verb", "SELECT doc_id, d.n_chars, l.quality FROM documents d FULL JOIN labels l USING (doc_id)")(lambda t: t.documents.select("doc_id", "n_chars").concat_columns(t.labels.select("doc_id", "quality"), ["doc_id"]))
query("stack", f"SELECT o_orderkey, 'price' AS variable, price AS value FROM {NULLED} t WHERE price IS NOT NULL UNION ALL SELECT o_orderkey, 'customer', o_custkey::DOUBLE FROM orders")(
    lambda t: nulled(t).select("o_orderkey", "price", F.col("o_custkey").cast("double").alias("customer")).stack(["o_orderkey"])
)
STATES = ["F", "O", "P"]
query("unstack", "SELECT o_custkey, " + ", ".join(f"sum(o_totalprice) FILTER (o_orderstatus = '{s}') IS NOT NULL AS \"{s}\"" for s in STATES) + " FROM orders GROUP BY 1")(
    lambda t: t.orders.agg(["o_custkey", "o_orderstatus"], any=F.lit(True) & (F.count(F.lit(1)) > 0)).unstack(["o_custkey"], "o_orderstatus", STATES, "any").fillna({s: False for s in STATES})
)
query("transpose", "SELECT 'n' AS variable, " + ", ".join(f"(count(*) FILTER (o_orderstatus = '{s}'))::DOUBLE AS \"{s}\"" for s in STATES) + " FROM orders UNION ALL SELECT 'top', " + ", ".join(f"max(o_totalprice) FILTER (o_orderstatus = '{s}')" for s in STATES) + " FROM orders")(
    lambda t: t.orders.agg(["o_orderstatus"], n=F.count(F.lit(1)).cast("double"), top=F.max("o_totalprice")).transpose("o_orderstatus", STATES)
)
query("describe_verb", "SELECT event_type, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY 1")(lambda t: t.events.describe(["value"], ["event_type"]).select("event_type", "value_count", "value_min", "value_max"))
query("approximate_distinct", "SELECT 'o_custkey' AS \"column\", true AS near")(
    lambda t: profile.profile(t.orders.df.select("o_custkey"), approximate=True).join(t.orders.df.agg(F.count_distinct("o_custkey").alias("exact"))).select("column", (F.abs(F.col("n_unique") / F.col("exact") - 1) < 0.2).alias("near"))
)

# ---------------------------------------------------------------- reports of pipelines


def _reported(build: Callable[[Tables], Frame], what: str) -> Callable[[Tables], DataFrame]:
    """The report's table `what` of the pipeline that build records."""
    columns = {"findings": ("step", "kind", "severity", "column"), "checks": ("step", "kind", "passes"), "hints": ("step", "kind", "status")}[what]
    return lambda t: build(t).pipeline.report().as_dataframes(t.spark)[what].select(*columns)


def _inner(t: Tables) -> Frame:
    return t.customer.select("c_custkey", "c_name").merge(t.events.select("event_id", "user_id"), left_on=["c_custkey"], right_on=["user_id"])


def _many(t: Tables) -> Frame:
    return t.nation.select("n_nationkey", "n_regionkey").merge(t.nation.select("n_nationkey", "n_regionkey"), on=["n_regionkey"])


def _null_keys(t: Tables) -> Frame:
    return nulled(t).select("o_orderkey", "status").merge(nulled(t).agg(["status"], n=F.count(F.lit(1))), on=["status"], how="left")


def _types(t: Tables) -> Frame:
    texts = t.customer.select("c_custkey", "c_name").astype({"c_custkey": "string"})
    return t.orders.select("o_orderkey", "o_custkey").merge(texts, left_on=["o_custkey"], right_on=["c_custkey"]).where("c_name", F.lit(True))


def _nothing(t: Tables) -> Frame:
    return t.orders.select("o_orderkey", "o_totalprice").filter("o_totalprice < 0")


def _late_filter(t: Tables) -> Frame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").merge(t.customer.select("c_custkey", "c_name"), left_on=["o_custkey"], right_on=["c_custkey"]).filter("o_totalprice > 100000")


_finding = lambda step, kind, severity, column="NULL", where="true": f"SELECT {step}::INTEGER AS step, '{kind}' AS kind, '{severity}' AS severity, {column}::VARCHAR AS \"column\" WHERE {where}"
_all = " UNION ALL ".join
query("findings_inner_join", _all([
    _finding(4, "row_explosion", "warning", where="(SELECT count(*) FROM customer JOIN events ON c_custkey = user_id) > (SELECT count(*) FROM customer)"),
    _finding(4, "row_loss", "warning", where="(SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) > 0"),
]))(_reported(_inner, "findings"))
query("findings_many_to_many", _all([
    _finding(4, "join", "error", where="(SELECT count(*) > count(DISTINCT n_regionkey) FROM nation)"),
    _finding(4, "row_explosion", "warning", where="(SELECT count(*) FROM nation a JOIN nation b USING (n_regionkey)) > (SELECT count(*) FROM nation)"),
    _finding(4, "join", "info"),
]))(_reported(_many, "findings"))
query("findings_null_keys", _all([
    _finding(1, "null_origin", "warning", "'price'", f"(SELECT count(*) > count(price) FROM {NULLED} t)"),
    _finding(1, "null_origin", "warning", "'status'", f"(SELECT count(*) > count(status) FROM {NULLED} t)"),
    _finding(6, "null_origin", "warning", "'n'", f"(SELECT count(*) > count(status) FROM {NULLED} t)"),
    _finding(6, "join", "info", where=f"(SELECT count(*) > count(status) FROM {NULLED} t)"),
    _finding(6, "join", "warning", where=f"(SELECT count(*) > count(status) FROM {NULLED} t)"),
]))(_reported(_null_keys, "findings"))
query("findings_key_types", _all([
    _finding(5, "join", "warning", "'o_custkey'"),
    _finding(5, "row_loss", "warning", where="(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) > 0"),
]))(_reported(_types, "findings"))
query("findings_empty_result", _finding(2, "row_loss", "error", where="(SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0"))(_reported(_nothing, "findings"))
query("findings_filter_loss", "SELECT 2::INTEGER AS step, 'row_loss' AS kind, CASE WHEN 2 * lost >= n THEN 'warning' ELSE 'info' END AS severity, NULL::VARCHAR AS \"column\" FROM (SELECT count(*) AS n, count(*) FILTER (o_totalprice >= 150000) AS lost FROM orders) WHERE lost > 0")(
    _reported(lambda t: t.orders.select("o_orderkey", "o_totalprice").filter("o_totalprice < 150000"), "findings")
)
query("checks_of_pipeline", _all([
    "SELECT 2::INTEGER AS step, 'not_empty' AS kind, (SELECT count(*) FROM documents WHERE n_chars > 500) > 0 AS passes",
    "SELECT 5, 'unique_keys', (SELECT count(*) = count(DISTINCT doc_id) FROM labels)",
    "SELECT 5, 'not_null', true WHERE (SELECT count(*) FROM documents WHERE n_chars > 500 AND doc_id IS NULL) = 0",
    "SELECT 5, 'not_null', true WHERE (SELECT count(*) FROM labels WHERE doc_id IS NULL) = 0",
    "SELECT 5, 'row_count', (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 500) = (SELECT count(*) FROM documents WHERE n_chars > 500)",
    "SELECT 5, 'not_null', false WHERE (SELECT count(*) FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)) > 0",
    "SELECT 6, 'schema', true",
    "SELECT 6, 'dtype', false",  # toxic is an int before the aggregate and a long after it
]))(_reported(lambda t: revenue(t), "checks"))
query("hints_filter_before_join", "SELECT 5::INTEGER AS step, 'filter_before_join' AS kind, 'auto' AS status WHERE (SELECT count(*) FILTER (o_totalprice > 100000) FROM orders) <= 0.9 * (SELECT count(*) FROM orders)")(
    lambda t: _reported(_late_filter, "hints")(t).where("kind <> 'unused_columns'")
)
query("examples_nulls", "SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars > 500 AND toxic IS NULL ORDER BY doc_id LIMIT 5")(
    lambda t: (lambda r: r.null_examples(r.pipeline.steps[5], ["doc_id"])["toxic"].select("doc_id"))(revenue(t).pipeline.report())
)
query("examples_of_findings", "SELECT doc_id FROM documents WHERE NOT coalesce(n_chars > 500, false) ORDER BY doc_id LIMIT 5")(
    lambda t: (lambda r: r.example_of(next(f for f in r.findings if f.kind == "row_loss"), ["doc_id"]).select("doc_id"))(revenue(t).pipeline.report())
)
query("step_facts", "SELECT 2::INTEGER AS step, 'rows_dropped' AS fact, (SELECT count(*) FROM documents WHERE NOT coalesce(n_chars > 500, false)) AS value UNION ALL SELECT 5, 'left_only', (SELECT count(*) FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL SELECT 6, 'n_groups', (SELECT count(DISTINCT lang) FROM documents WHERE n_chars > 500)")(
    lambda t: (lambda r: t.spark.createDataFrame([(i, k, r.facts[i].details[k]) for i, k in ((2, "rows_dropped"), (5, "left_only"), (6, "n_groups"))], "step int, fact string, value long"))(revenue(t).pipeline.report())
)
query("concat_facts", "SELECT 0::INTEGER AS input, count(*) AS rows FROM customer UNION ALL SELECT 1, count(*) FROM supplier")(
    lambda t: (lambda f: t.spark.createDataFrame([*enumerate(f.pipeline.report().facts[f.step.id].details["rows_per_input"])], "input int, rows long"))(t.customer.column("c_name").to_frame("name").concat(t.supplier.column("s_name").to_frame("name")))
)


def _differences(t: Tables) -> DataFrame:
    end = nulled(t).rename({"status": "state"}).fillna({"price": 0.0})
    d = diff(end.pipeline.report(), 1, end.step.id)
    return t.spark.createDataFrame([(c, how, *d["rows"]) for c, how in d["columns"].items()], "column string, change string, rows_before long, rows_after long")


query("step_diff", f"SELECT c AS \"column\", h AS change, n AS rows_before, n AS rows_after FROM (VALUES ('o_orderkey', 'same'), ('o_custkey', 'same'), ('state', 'renamed from status')) v(c, h), (SELECT count(*) AS n FROM orders) UNION ALL SELECT 'price', CASE WHEN count(*) > count(price) THEN 'changed' ELSE 'same' END, count(*), count(*) FROM {NULLED} t")(_differences)


# ---------------------------------------------------------------- nulls, positions, groups

query("isin_nulls", f"SELECT o_orderkey, coalesce(status IN ('F', 'P'), false) AS closed FROM {NULLED} t")(lambda t: nulled(t).isin("status", ["F", "P"], "closed").select("o_orderkey", "closed"))
query("crosstab_nulls", "SELECT status, " + ", ".join(f"count(*) FILTER (band = {b}) AS \"{b}\"" for b in range(3)) + f" FROM (SELECT status, CASE WHEN price IS NOT NULL THEN o_custkey % 3 END AS band FROM {NULLED} t) WHERE status IS NOT NULL AND band IS NOT NULL GROUP BY 1")(
    lambda t: nulled(t).assign(band=F.when(F.col("price").isNotNull(), F.col("o_custkey") % 3)).crosstab("status", "band", [0, 1, 2])
)
query("head_nulls", f"SELECT o_orderkey, price FROM {NULLED} t ORDER BY price ASC NULLS LAST, o_orderkey LIMIT 10")(lambda t: nulled(t).select("o_orderkey", "price").head(10, ["price", "o_orderkey"]))
for method, sql in {"average": "((2 * rank() OVER w + count(*) OVER (PARTITION BY o_custkey, price) - 1) / 2.0)::DOUBLE", "min": "rank() OVER w::INTEGER", "max": "(rank() OVER w + count(*) OVER (PARTITION BY o_custkey, price) - 1)::BIGINT", "dense": "dense_rank() OVER w::INTEGER", "first": "row_number() OVER w::INTEGER"}.items():
    expression = sql.replace("rank() OVER w::INTEGER", "(rank() OVER w)::INTEGER").replace("dense_(rank() OVER w)::INTEGER", "(dense_rank() OVER w)::INTEGER").replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")
    query(f"group_rank_nulls_{method}", f"SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN {expression} END AS r FROM (SELECT o_orderkey, o_custkey, round(price / 20000) AS price FROM {NULLED} t) WINDOW w AS (PARTITION BY o_custkey ORDER BY price ASC NULLS LAST{', o_orderkey' if method == 'first' else ''})")(
        lambda t, method=method: (
            nulled(t).assign(price=F.round(F.col("price") / 20000)).assign(by=F.when(F.col("price").isNotNull(), F.struct("price", "o_orderkey") if method == "first" else F.col("price"))).rank(["o_custkey"], "by", "r", method).select("o_orderkey", "r")
        )
    )
query("loc_deep", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 20 OFFSET 12345")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").loc(12345, 12365, ["l_orderkey", "l_linenumber", "l_partkey"])
)
query("row_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")(
    lambda t: positions.positions(t.orders.df.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "position")
)
query("loc_labels", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")(lambda t: t.orders.loc_labels("o_orderkey", 100, 900, ["o_orderkey", "o_totalprice"]))
query("filter_groups", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 200000)")(
    lambda t: t.orders.filter_groups(["o_custkey"], (F.count(F.lit(1)) > 12) & (F.max("o_totalprice") > 200000)).select("o_orderkey")
)
query("group_head_verb", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price NULLS LAST, o_orderkey) AS n FROM {NULLED} t) WHERE n <= 2")(lambda t: nulled(t).group_head(["o_custkey"], 2, ["price", "o_orderkey"]).select("o_custkey", "o_orderkey"))
query("sample_n", "SELECT 100::BIGINT AS n, 100::BIGINT AS different, 0::BIGINT AS others")(
    lambda t: t.orders.sample(n=100, seed=3).df.join(t.orders.df.select(F.col("o_orderkey").alias("known")), F.col("o_orderkey") == F.col("known"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"), F.count_if(F.col("known").isNull()).alias("others"))
)

# ---------------------------------------------------------------- reports in one run, lineage, lost rows


def _chain(t: Tables) -> Frame:
    """Twelve steps over the line items, three of which drop rows."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").filter("l_quantity > 5")
    rows = rows.assign(net=F.col("l_extendedprice") * (1 - F.col("l_discount"))).where("l_discount", F.col("l_discount") > 0.02).rename({"l_returnflag": "flag"})
    rows = rows.fillna({"l_discount": 0.0}).filter(F.col("flag") != "R").astype({"l_quantity": "long"}).isin("flag", ["A"], "returned")
    return rows.mask("net", F.col("net") > 50000).dropna(["net"])


_STEPS = [("read_parquet", "true", 11), ("select", "true", 6), ("filter", "q", 6), ("assign", "q", 7), ("where", "q", 7), ("rename", "q", 7), ("fillna", "q", 7), ("filter", "q AND r", 7), ("astype", "q AND r", 7), ("isin", "q AND r", 8), ("mask", "q AND r", 8), ("dropna", "q AND r AND p", 8)]
_NULLS = {4: "count(*) FILTER (q AND l_discount <= 0.02)", 5: "count(*) FILTER (q AND l_discount <= 0.02)", 10: "count(*) FILTER (q AND r AND NOT p)"}
query("report_one_pass", "WITH l AS (SELECT *, l_quantity > 5 AS q, l_returnflag <> 'R' AS r, l_extendedprice * (1 - l_discount) <= 50000 AS p FROM lineitem) " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS id, '{'query' if op == 'filter' and i == 2 else op}' AS op, count(*) FILTER ({kept}) AS rows, {columns}::BIGINT AS columns, {_NULLS.get(i, '0::BIGINT')} AS nulls FROM l" for i, (op, kept, columns) in enumerate(_STEPS)))(
    lambda t: (lambda p, r: t.spark.createDataFrame([(s.id, s.op, r.facts[s.id].rows, len(s.df.columns), sum(r.facts[s.id].nulls.values())) for s in p.steps], "id int, op string, rows long, columns long, nulls long"))(*(lambda f: (f.pipeline, f.pipeline.report()))(_chain(t)))
)


def _wide_renames(t: Tables) -> DataFrame:
    """Of sixty columns, which are which after a rename, some computed ones, and a swap of two names."""
    wide = t.nation.select(*[(F.col("n_nationkey") + i).alias(f"c{i}") for i in range(60)])
    end = wide.rename({"c40": "forty", "c7": "the 7th.one", "c1": "c2", "c2": "c1"}).assign(c50=F.col("c50") + 1)
    found = catalyst.renames(wide.df, end.df)
    return t.spark.createDataFrame(sorted(found.items()), "now string, before string").join(t.nation.agg([], n=F.count(F.lit(1))).df)


query("renames_by_lineage", "SELECT now, before, (SELECT count(*) FROM nation) AS n FROM (VALUES ('forty', 'c40'), ('the 7th.one', 'c7'), ('c2', 'c1'), ('c1', 'c2')) v(now, before)")(_wide_renames)


def _two_sources(t: Tables) -> Frame:
    """Two sources with the same names of columns, of which one's notes are read."""
    left = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("notes"), F.col("o_totalprice").alias("amount"))
    right = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("notes"), F.col("c_acctbal").alias("amount"))
    own = Pipeline()
    a, b = own.source(left.df, "left"), own.source(right.df, "right")
    return a.merge(b, on=["id"]).select("notes_x", "amount_y")


query("unused_by_lineage", "SELECT * FROM (VALUES ('left', 'amount'), ('right', 'notes')) v(source, \"column\") WHERE (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) >= 0")(
    lambda t: (lambda f: t.spark.createDataFrame([(s.label, c) for s in f.pipeline.steps if s.op == "source" for c in catalyst.unused_columns(f.pipeline, s)], "source string, column string"))(_two_sources(t))
)
query("column_origins", "SELECT * FROM (VALUES ('revenue', 'orders', 'o_totalprice'), ('revenue', 'customer', 'c_acctbal'), ('who', 'customer', 'c_name'), ('who', 'orders', 'o_orderstatus')) v(\"column\", source, origin)")(
    lambda t: (lambda o, c: t.spark.createDataFrame([
        (name, ("orders", "customer")[n], origin)
        for name, made in catalyst.origins(
            o.merge(c, left_on=["o_custkey"], right_on=["c_custkey"]).assign(x=F.col("o_totalprice") + F.col("c_acctbal")).select("x", F.col("c_name").alias("who")).concat(o.select(F.col("o_totalprice").alias("x"), F.col("o_orderstatus").alias("who"))).agg(["who"], revenue=F.sum("x")).df,
            [o.df, c.df],
        ).items()
        for n, origin in made
    ], "column string, source string, origin string"))(t.orders, t.customer)
)
query("null_origin_after_rename", f"SELECT 1::INTEGER AS step, c AS \"column\" FROM (VALUES ('price'), ('status')) v(c) WHERE (SELECT count(*) > count(price) FROM {NULLED} t)")(
    lambda t: nulled(t).rename({"price": "paid", "status": "state"}).assign(twice=F.lit(1)).rename({"paid": "amount"}).pipeline.report().as_dataframes(t.spark)["findings"].where("kind = 'null_origin'").select("step", "column")
)
query("lost_rows", "SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1")(
    lambda t: filters.lost_rows(t.orders.df.select("o_custkey", "o_orderstatus"), t.orders.df.select("o_custkey", "o_orderstatus").distinct())
)
query("lost_counts", "SELECT sum(n - 1)::BIGINT AS total, max(n - 1) AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) WHERE n > 1")(
    lambda t: filters.lost_counts(t.orders.df.select("o_custkey", "o_orderstatus"), t.orders.df.select("o_custkey", "o_orderstatus").distinct()).agg(F.sum("lost").alias("total"), F.max("lost").alias("most"))
)
query("examples_of_groups", "SELECT n, n = least(5, lost) AS shown FROM (SELECT least(5, count(*)) AS n, count(*) AS lost FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12))")(
    lambda t: (lambda f: (lambda r: r.examples(f.step, "dropped", ["o_orderkey"]).join(f.df.select(F.col("o_orderkey").alias("kept")), F.col("o_orderkey") == F.col("kept"), "left").agg(F.count(F.lit(1)).alias("n"), (F.count("kept") == 0).alias("shown")))(f.pipeline.report()))(
        t.orders.filter_groups(["o_custkey"], F.count(F.lit(1)) > 12)
    )
)


# ---------------------------------------------------------------- functions of groups, contracts, sketches, repeated work


def longest_run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a group and its longest run of one event type, over any number of batches."""
    last, run, most, n = None, 0, 0, 0
    for batch in batches:
        n += len(batch)
        for kind in batch["event_type"]:
            run = run + 1 if kind == last else 1
            last, most = kind, max(most, run)
    yield pd.DataFrame({"n": [n], "longest": [most]})


def three_largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    best = pd.Series([], dtype="float64")
    for batch in batches:
        best = pd.concat([best, batch["value"]]).nlargest(3)
    yield pd.DataFrame({"value": best})


query("apply_groups", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events), r AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id, event_type, island) SELECT user_id, sum(n)::BIGINT AS n, max(n) AS longest FROM r GROUP BY 1")(
    lambda t: apply_groups(t.events.df.select("user_id", "event_type", "event_id"), ["user_id"], longest_run, "n long, longest long", ["event_id"])
)
query("combine_groups", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 3")(
    lambda t: combine_groups(t.events.df.select("event_type", "value").where("value IS NOT NULL"), ["event_type"], three_largest, "value double", three_largest)
)
_CONTRACT = Contract(
    types={"o_orderkey": "bigint", "price": "double", "status": "int", "absent": "string"},
    not_null=("o_orderkey", "price"),
    unique=(("o_orderkey",), ("o_custkey", "status")),
    values={"cheap": "price < 200000", "known": "status IN ('F', 'O')"},
    least_rows=10**9,
    most_rows=10,
)
query("contract_violations", f"WITH t AS (SELECT * FROM {NULLED} u) SELECT * FROM (VALUES ('column', 'o_orderkey', 0::BIGINT), ('column', 'price', 0), ('column', 'status', 0), ('column', 'absent', 1), ('type', 'o_orderkey bigint', 0), ('type', 'price double', 0), ('type', 'status int', 1)) v(rule, subject, violations) UNION ALL SELECT 'rows', 'at least 1000000000', 1000000000 - count(*) FROM t UNION ALL SELECT 'rows', 'at most 10', count(*) - 10 FROM t UNION ALL SELECT 'not_null', 'o_orderkey', count(*) - count(o_orderkey) FROM t UNION ALL SELECT 'not_null', 'price', count(*) - count(price) FROM t UNION ALL SELECT 'values', 'cheap', count(*) FILTER (NOT coalesce(price < 200000, false)) FROM t UNION ALL SELECT 'values', 'known', count(*) FILTER (NOT coalesce(status IN ('F', 'O'), false)) FROM t UNION ALL SELECT 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM t UNION ALL SELECT 'unique', 'o_custkey, status', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY o_custkey, status)")(
    lambda t: violations(nulled(t).df, _CONTRACT)
)
query("contract_rows", f"WITH t AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, status) AS n FROM {NULLED} u), b AS (SELECT o_orderkey, price IS NULL AS x, NOT coalesce(price < 200000, false) AS y, NOT coalesce(status IN ('F', 'O'), false) AS z, n > 1 AS u FROM t) SELECT o_orderkey, concat_ws('; ', CASE WHEN x THEN 'not_null price' END, CASE WHEN y THEN 'values cheap' END, CASE WHEN z THEN 'values known' END, CASE WHEN u THEN 'unique o_custkey, status' END) AS broken FROM b WHERE x OR y OR z OR u")(
    lambda t: violating_rows(nulled(t).df, _CONTRACT).select("o_orderkey", F.array_join("broken", "; ").alias("broken"))
)
query("sketches_united", f"SELECT c AS \"column\", n AS rows, null_count, true AS near FROM (SELECT 'o_orderkey' AS c, count(*) AS n, 0::BIGINT AS null_count FROM orders UNION ALL SELECT 'o_custkey', count(*), 0 FROM orders UNION ALL SELECT 'price', count(*), count(*) - count(price) FROM {NULLED} t UNION ALL SELECT 'status', count(*), count(*) - count(status) FROM {NULLED} t)")(
    lambda t: (lambda df: profile.united(profile.sketches(df.where("o_orderkey % 3 = 0")).union(profile.sketches(df.where("o_orderkey % 3 > 0"))))
        .join(profile.profile(df).select("column", F.col("n_unique").alias("exact")), "column")
        .select("column", "rows", "null_count", (F.abs(F.col("n_unique") - F.col("exact")) <= 4 * profile.SKETCH_ERROR * F.col("exact") + 1).alias("near")))(nulled(t).df)
)


def _twice(t: Tables) -> Frame:
    """Two results of one join that is written out twice, over sources read by hand."""
    own = Pipeline()
    read = lambda name: own.source(t.spark.read.parquet(f"{t.dir}/{name}.parquet"), name)
    both = lambda: read("orders").merge(read("customer"), left_on=["o_custkey"], right_on=["c_custkey"])
    both().agg(["c_mktsegment"], n=F.count(F.lit(1)))
    return both().agg(["o_orderstatus"], top=F.max("o_totalprice"))


query("hints_repeated_work", "SELECT 2::INTEGER AS step, 'repeated_work' AS kind, 'actionable' AS status, 'step_2.cache()' AS suggestion UNION ALL SELECT 4, 'duplicate_read', 'actionable', 'the frame of step 0' UNION ALL SELECT 5, 'duplicate_read', 'actionable', 'the frame of step 1' WHERE (SELECT count(*) FROM orders) > 0")(
    lambda t: _twice(t).pipeline.report().as_dataframes(t.spark)["hints"].where("kind <> 'unused_columns'").select("step", "kind", "status", "suggestion")
)
query("finding_names_condition", "SELECT 1::INTEGER AS step, true AS condition, true AS place WHERE (SELECT count(*) FROM orders WHERE o_totalprice <= 100000) > 0")(
    lambda t: t.orders.filter(F.col("o_totalprice") > 100000).pipeline.report().as_dataframes(t.spark)["findings"].where("kind = 'row_loss'").select("step", F.col("message").contains("o_totalprice > ").alias("condition"), F.col("message").contains("queries.py:").alias("place"))
)

# ---------------------------------------------------------------- values looked up, more options of verbs

query("pivot_table_looked_up", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in STATUSES) + " FROM orders GROUP BY 1")(
    lambda t: t.orders.pivot_table(["o_orderpriority"], "o_orderstatus", None, F.count(F.lit(1))).fillna({s: 0 for s in STATUSES})
)
query("crosstab_looked_up", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS \"{s}\"" for s in TYPES) + " FROM events GROUP BY 1")(lambda t: t.events.crosstab("user_id", "event_type"))
query("get_dummies_looked_up", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INTEGER AS o_orderstatus_{s}" for s in STATUSES) + " FROM orders")(lambda t: t.orders.select("o_orderkey", "o_orderstatus").get_dummies("o_orderstatus"))
query("describe_percentiles", "SELECT count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.995), 4) AS p99_5 FROM orders")(
    lambda t: t.orders.describe(["o_totalprice"], percentiles=(0.1, 0.995)).df.select(F.col("o_totalprice_count").alias("n"), F.round("o_totalprice_p10", 4).alias("p10"), F.round("`o_totalprice_p99.5`", 4).alias("p99_5"))
)
query("nunique_keepna", f"SELECT o_custkey, count(DISTINCT status) + (count(*) > count(status))::BIGINT AS kinds FROM {NULLED} t GROUP BY 1")(lambda t: nulled(t).agg(["o_custkey"], kinds=nunique("status", dropna=False)))
query("cumcount_descending", "SELECT event_id, (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS n FROM events")(lambda t: t.events.cumcount(["user_id"], ["event_id"], "n", ascending=False).select("event_id", "n"))
query("value_counts_sorted", f"SELECT o_custkey, count FROM (SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)")(lambda t: t.orders.value_counts("o_custkey", sort=True).df.limit(20))
query("group_tail_verb", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS FIRST, o_orderkey DESC) AS n FROM {NULLED} t) WHERE n <= 2")(lambda t: nulled(t).group_tail(["o_custkey"], 2, ["price", "o_orderkey"]).select("o_custkey", "o_orderkey"))
for most in (True, False):
    query(f"idx{'max' if most else 'min'}_verb", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY price {'DESC' if most else ''}, o_orderkey) AS n FROM {NULLED} t WHERE price IS NOT NULL) WHERE n = 1")(
        lambda t, most=most: nulled(t).idx(["o_custkey"], "o_orderkey", "price", most)
    )
query("size_verb", f"SELECT status, count(*) AS size FROM {NULLED} t WHERE status IS NOT NULL GROUP BY 1")(lambda t: nulled(t).size(["status"], dropna=True))
query("find_group_loss", "SELECT 1::INTEGER AS step, 'row_loss' AS kind, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)) AS lost WHERE (SELECT count(*) FROM orders) > 0")(
    lambda t: t.orders.filter_groups(["o_custkey"], F.count(F.lit(1)) > 12).pipeline.report().as_dataframes(t.spark)["findings"].where("kind = 'row_loss'").select("step", "kind", F.regexp_extract("message", "^(\\d+) of", 1).cast("long").alias("lost"))
)

# ---------------------------------------------------------------- readers and the catalog, on files written of the tables


def _scratch(t: Tables) -> str:
    """A new folder where the session keeps its checkpoints; in a local session without one, on this machine."""
    found = t.spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (t.spark.sparkContext.master.startswith("local") and not t.spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='plumbline-')).rstrip('/')}/plumbline/files-{uuid.uuid4().hex}"


_PRICED = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_priced = lambda t: t.orders.df.select("o_orderkey", "o_orderstatus", "o_totalprice")


def _read_back(suffix: str, write: Callable[[DataFrame, str], None]) -> Callable[[Tables], DataFrame]:
    def build(t: Tables) -> DataFrame:
        path = f"{_scratch(t)}/orders.{suffix}"
        write(_priced(t), path)
        return read(t.spark, path, schema="o_orderkey long, o_orderstatus string, o_totalprice double").select("o_orderkey", "o_orderstatus", "o_totalprice")

    return build


query("read_csv", _PRICED)(_read_back("csv", lambda df, path: df.write.option("header", True).csv(path)))
query("read_table", _PRICED)(_read_back("tsv", lambda df, path: df.write.options(header=True, sep="\t").csv(path)))
query("read_json", _PRICED)(_read_back("jsonl", lambda df, path: df.write.json(path)))
query("read_orc", _PRICED)(_read_back("orc", lambda df, path: df.write.orc(path)))


def _catalog(t: Tables) -> Catalog:
    """A catalog of orders as CSV, replaced once, and customers."""
    scratch = _scratch(t)
    out = Catalog(t.spark, f"{scratch}/catalog", most_bytes=1 << 40)
    _priced(t).limit(0).write.option("header", True).csv(f"{scratch}/old/my orders.csv")
    _priced(t).write.option("header", True).csv(f"{scratch}/new/my orders.csv")
    t.customer.df.select("c_custkey", "c_name").write.parquet(f"{scratch}/customers.parquet")
    out.put(f"{scratch}/old/my orders.csv")
    out.put(f"{scratch}/new/my orders.csv", replace=True)
    out.put(f"{scratch}/customers.parquet", "customers")
    return out


query("catalog_get", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")(
    lambda t: _catalog(t).get("my_orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
)
query("catalog_list", "SELECT 'customers' AS name, 2::BIGINT AS columns, count(*) AS rows FROM customer UNION ALL SELECT 'my_orders', 3, count(*) FROM orders")(
    lambda t: (lambda c: c.list().select("name", F.size("columns").cast("long").alias("columns")).join(
        c.get("customers").agg(F.lit("customers").alias("name"), F.count(F.lit(1)).alias("rows")).union(c.get("my_orders").agg(F.lit("my_orders"), F.count(F.lit(1)))), "name"))(_catalog(t))
)
query("catalog_sql", "WITH s AS (SELECT DISTINCT o_orderstatus AS kind FROM orders) SELECT kind, (SELECT count(*) FROM customer) AS customers FROM s")(
    lambda t: _catalog(t).sql("WITH s AS (SELECT DISTINCT o_orderstatus AS kind FROM my_orders /* not nation */) SELECT kind, (SELECT count(*) FROM customers) AS customers FROM s")
)


def _referenced(t: Tables) -> DataFrame:
    sets = Datasets(t.spark)
    for name in ("orders", "customer", "nation"):
        sets.add(f"{t.dir}/{name}.parquet", f"set_{name}", "parquet")
    named = sets.referenced("WITH set_nation AS (SELECT 1 AS x) SELECT 'set_customer' AS set_customer FROM Set_Orders o JOIN set_nation ON true -- set_customer")
    return t.spark.createDataFrame([(n,) for n in named], "name string").crossJoin(sets.get("set_orders").agg(F.count(F.lit(1)).alias("rows")))


query("referenced_names", "SELECT 'set_orders' AS name, count(*) AS rows FROM orders")(_referenced)

# ---------------------------------------------------------------- hints, changes and texts of reports


def _hints_of(build: Callable[[Tables], Frame], kind: str) -> Callable[[Tables], DataFrame]:
    return lambda t: build(t).pipeline.report().as_dataframes(t.spark)["hints"].where(F.col("kind") == kind).select("step", "status", "suggestion")


query("hints_filter_earlier", "SELECT 3::INTEGER AS step, 'auto' AS status, 'filter o_totalprice > 100000, then assign [''tax'']' AS suggestion WHERE (SELECT count(*) FILTER (o_totalprice > 100000) FROM orders) <= 0.9 * (SELECT count(*) FROM orders)")(
    _hints_of(lambda t: t.orders.select("o_orderkey", "o_totalprice").assign(tax=F.col("o_orderkey") * 2).filter("o_totalprice > 100000"), "filter_earlier")
)
query("hints_unused_columns", "SELECT 0::INTEGER AS step, 'auto' AS status, 'select(''c_custkey'', ''c_acctbal'')' AS suggestion WHERE (SELECT count(*) FROM customer) > 0")(
    _hints_of(lambda t: t.customer.filter("c_acctbal > 0").agg([], n=F.count("c_custkey")), "unused_columns")
)
query("hints_useless_sort", "SELECT 1::INTEGER AS step, 'auto' AS status, 'sort (''o_orderkey'',)' AS suggestion WHERE (SELECT count(*) FROM orders) > 0")(
    _hints_of(lambda t: t.orders.sort_values("o_totalprice").sort_values("o_orderkey"), "useless_sort")
)


def _doubled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"o_orderkey": batch["o_orderkey"], "twice": batch["o_totalprice"] * 2})


query("apply", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")(lambda t: t.orders.select("o_orderkey", "o_totalprice").apply(_doubled, "o_orderkey long, twice double"))
query("hints_row_apply", "SELECT 2::INTEGER AS step, 'actionable' AS status, 'assign() with functions of pyspark.sql' AS suggestion WHERE (SELECT count(*) FROM orders) > 0")(
    _hints_of(lambda t: t.orders.select("o_orderkey", "o_totalprice").apply(_doubled, "o_orderkey long, twice double"), "row_apply")
)
query("hints_duplicate_read", "SELECT 2::INTEGER AS step, 'actionable' AS status, 'the frame of step 0' AS suggestion WHERE (SELECT count(*) FROM nation) > 0")(
    _hints_of(lambda t: t.nation.select("n_nationkey").merge(t.nation.select("n_nationkey", "n_name"), on=["n_nationkey"]), "duplicate_read")
)


def _mine(t: Tables) -> Frame:
    """A step that the package has no verb for, which keeps some rows."""
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return t.pipeline.add("my_filter", "the dear ones", orders.df.where("o_totalprice > 300000"), [(orders, "input")]).named("dear")


query("unknown_step", "SELECT id, category, name, rows FROM (SELECT 0::INTEGER AS id, 'source' AS category, NULL::VARCHAR AS name, count(*) AS rows FROM orders UNION ALL SELECT 1, 'projection', NULL, count(*) FROM orders UNION ALL SELECT 2, 'other', 'dear', count(*) FILTER (o_totalprice > 300000) FROM orders)")(
    lambda t: _mine(t).pipeline.report().as_dataframes(t.spark)["steps"].select("id", "category", "name", "rows")
)
query("examples_of_unknown_step", "SELECT least(5, count(*)) AS n, 0::BIGINT AS kept FROM orders WHERE NOT coalesce(o_totalprice > 300000, false)")(
    lambda t: (lambda f: f.pipeline.report().examples(f.step, "dropped", ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("kept")))(_mine(t))
)


def _schema_change(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    made = t.pipeline.add("shape", "", orders.df.selectExpr("CAST(o_orderkey AS STRING) AS o_orderkey", "o_totalprice", "o_totalprice * 0.1 AS tax"), [(orders, "input")])
    c = made.pipeline.report().schema_change(made.step)
    rows = [(kind, x) for kind, key in (("added", "added"), ("removed", "removed"), ("changed", "dtype_changed")) for x in c[key]]
    return t.spark.createDataFrame(rows, "change string, column string")


query("schema_change", "SELECT * FROM (VALUES ('added', 'tax'), ('removed', 'o_orderstatus'), ('changed', 'o_orderkey')) v(change, \"column\") WHERE (SELECT count(*) FROM orders) > 0")(_schema_change)
query("diff_text", "SELECT 'ancestor, over steps 0 > 1' AS line UNION ALL SELECT 'rows: ' || n || ' to ' || k || ' (' || (k - n) || ')' FROM (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS k FROM orders) UNION ALL SELECT 'all columns are the same'")(
    lambda t: (lambda f: t.spark.createDataFrame([(line,) for line in diff_text(diff(f.pipeline.report(), 0, f.step.id)).split("\n")], "line string"))(t.orders.filter("o_totalprice > 100000"))
)
query("checks_script", "SELECT 'assert not dear.isEmpty()  # ' || CASE WHEN count(*) > 0 THEN 'passes' ELSE 'FAILS' END || ': rows are left' AS line FROM orders WHERE o_totalprice > 100000")(
    lambda t: (lambda f: t.spark.createDataFrame([(line,) for line in f.pipeline.report().checks_script().splitlines() if "isEmpty" in line], "line string"))(t.orders.filter("o_totalprice > 100000").named("dear"))
)
query("report_times", "SELECT 'orders' AS label, true AS measured, true AS sized FROM orders LIMIT 1")(
    lambda t: (lambda r: t.spark.createDataFrame([("orders", all(f.seconds >= 0 for f in r.facts.values()) and max(f.seconds for f in r.facts.values()) > 0, all(f.bytes > 0 for f in r.facts.values()))], "label string, measured boolean, sized boolean"))(t.orders.filter("o_totalprice > 100000").pipeline.report())
)
query("finding_names_expression", "SELECT 1::INTEGER AS step, 'part' AS \"column\", true AS expression, true AS place WHERE (SELECT count(*) FROM orders WHERE o_totalprice <= 100000) > 0")(
    lambda t: t.orders.assign(part=F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 2)).pipeline.report().as_dataframes(t.spark)["findings"]
    .select("step", "column", F.col("message").contains("part is CASE WHEN (o_totalprice > ").alias("expression"), F.col("message").contains("queries.py:").alias("place"))
)
