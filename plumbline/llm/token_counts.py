"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer totals, quantiles and truncated totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import pick
from plumbline.llm.tokens import encoder


def encoded_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """One row (length) for each row of docs: tokens of its whole text; null or empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame({"length": np.fromiter((len(ids) for ids in encode(batch["text"])), np.int64, len(batch))})

    return pick(docs, text=text_col).mapInPandas(count, "length long")


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Per distinct length: documents, and for a context limit of that length the sums over all documents.

    Columns: length, n_docs, n_tokens (of these documents), docs_at_least and tokens_at_least (suffix sums, this
    length included), truncated_tokens (the sum over all documents of min(tokens, length)), docs_below. The
    documents are summed before the shuffle; what remains is one row for each distinct length, at most as many as
    the longest document has tokens. Of an empty table, no rows; repeated rows count each.
    """
    sums = encoded_lengths(docs, tokenizer_path, text_col).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    sums = sums.withColumn("n_tokens", F.col("n_docs") * F.col("length"))
    suffix = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sums.withColumn("docs_at_least", F.sum("n_docs").over(suffix)).withColumn("tokens_at_least", F.sum("n_tokens").over(suffix))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("all_docs", F.sum("n_docs").over(every)).withColumn("all_tokens", F.sum("n_tokens").over(every))
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, tokens kept when every document is cut there, tokens lost."""
    spark = histogram.sparkSession
    kept: list[Column] = [F.coalesce(F.sum(F.col("n_docs") * F.least("length", F.lit(n))), F.lit(0)).alias(f"k{n}") for n in limits]
    over: list[Column] = [F.coalesce(F.sum(F.when(F.col("length") > n, F.col("n_docs"))), F.lit(0)).alias(f"o{n}") for n in limits]
    row = histogram.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), *kept, *over).first()
    return spark.createDataFrame([(n, row[f"o{n}"], row[f"k{n}"], row["all"] - row[f"k{n}"]) for n in limits], "context_limit long, docs_over long, tokens_kept long, tokens_lost long")


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents does not exceed; None of an empty table."""
    row = histogram.where(F.col("docs_below") + F.col("n_docs") >= F.ceil(F.lit(q) * (F.col("docs_below") + F.col("docs_at_least")))).agg(F.min("length")).first()
    return row[0]
