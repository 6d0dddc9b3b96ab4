"""Exact token counts from a histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def token_lengths(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens)`` of every whole text, however long; a null text is empty and has 0 tokens; null ids stay; repeated
    rows each count; an empty table gives no rows; other columns are left out, so their names can't clash."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path, pattern).encode_ordinary
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                n = [len(encode(x)) if x else 0 for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_tokens, n_docs)``: documents by exact length. Its rows are bounded by the longest text, not by the
    documents; null lengths are left out, equal ones are one row, and an empty table gives none."""
    return lengths.where(F.col(length_col).isNotNull()).groupBy(*by, F.col(length_col).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every length that occurs, exact totals at a context limit of that length.

    Adds ``docs_longer`` (documents over the limit), ``tokens_longer`` (their tokens), ``truncated_tokens`` (tokens kept
    when every document is cut at the limit), ``docs_up_to`` and ``total_docs`` / ``total_tokens``. Any other limit L is
    answered from the row of the largest length not over L: ``tokens up to it + L * docs_longer``.
    """
    above = Window.partitionBy(*by).orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = histogram.select(
        *by, "n_tokens", "n_docs",
        F.coalesce(F.sum("n_docs").over(above), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(tokens).over(above), F.lit(0)).alias("tokens_longer"),
        F.sum("n_docs").over(whole).alias("total_docs"), F.sum(tokens).over(whole).alias("total_tokens"),
    )
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return out.withColumn("truncated_tokens", kept).withColumn("docs_up_to", F.col("total_docs") - F.col("docs_longer"))


def truncated_totals(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, context_limit, kept_tokens, cut_docs, cut_tokens)`` for the stated limits, from the suffix sums."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    tokens = F.col("n_tokens") * F.col("n_docs")
    over = F.col("n_tokens") > F.col("context_limit")
    return (
        sums.crossJoin(F.broadcast(asked)).groupBy(*by, "context_limit")
        .agg(F.sum(F.when(over, F.col("context_limit") * F.col("n_docs")).otherwise(tokens)).alias("kept_tokens"),
             F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("cut_docs"),
             F.sum(F.when(over, tokens - F.col("context_limit") * F.col("n_docs")).otherwise(0)).alias("cut_tokens"))
    )


def quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, share, n_tokens)``: the least length that at least ``share`` of the documents don't exceed."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    reached = F.col("docs_up_to") >= F.col("share") * F.col("total_docs")
    return sums.crossJoin(F.broadcast(asked)).where(reached).groupBy(*by, "share").agg(F.min("n_tokens").alias("n_tokens"))
