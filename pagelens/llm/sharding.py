"""Shards of near equal bytes by sampled splitters."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Expected keys in a sample for each range; the driver holds no more of the corpus than this.
KEYS_PER_RANGE = 16
#: Ranges that a shard's bytes are dealt over: more rows give more, so that a task's rows don't grow, up to a bound of what the
#: driver holds.
RANGES_PER_SHARD, MOST_RANGES, ROWS_PER_RANGE = 32, 2048, 500_000
#: A range is overfull with so many times its share of bytes.
OVERFULL = 2.5
#: How far a shard's bytes may be from the mean, as a share of it. A group of equal texts is parted only where keeping it whole
#: could break that: where the group alone is larger.
TOLERANCE = 0.1


def _draw(rows: DataFrame, total: int, keys: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to size; the draw depends on the id and key alone, so it repeats."""
    chance = F.pmod(F.xxhash64("key", "mark", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(chance < F.col("size") * F.lit(keys / total)).select("key", "mark")
    return sorted((r.key, r.mark) for r in drawn.collect())


def _splitters(drawn: list[tuple[int, int]], ranges: int, hot: set[int]) -> set[tuple[int, int]]:
    """Quantiles of the drawn keys. Only hot keys are parted; other splitters lie before their whole key."""
    at = {drawn[i * len(drawn) // ranges] for i in range(1, ranges)} if drawn else set()
    return {(k, m if k in hot else -(2**63)) for k, m in at}


def _range_of(splitters: list[tuple[int, int]], hot: set[int]) -> Column:
    """Number of splitters not above (key, mark), by bisection; only those of hot keys have marks."""
    keys, marks = (np.array([s[i] for s in splitters], np.int64) for i in (0, 1))
    parted = sorted(hot & set(keys.tolist()))

    def find(key: pd.Series, mark: pd.Series) -> pd.Series:
        k, m = key.to_numpy(), mark.to_numpy()
        out = np.searchsorted(keys, k, "right")
        for h in parted:
            if (own := k == h).any():
                a, z = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
                out[own] = a + np.searchsorted(marks[a:z], m[own], "right")
        return pd.Series(out.astype(np.int32))

    return F.pandas_udf(find, "int")("key", "mark")


def assign(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keys_per_range: int = KEYS_PER_RANGE, tolerance: float = TOLERANCE) -> DataFrame:
    """A shard and a slot for every row, shards being ranges of a text's key with near equal bytes.

    The key is a hash of the text, so equal texts lie side by side. Keys are drawn with a chance in proportion to size,
    their quantiles part the rows into ranges, ranges that turn out overfull are subdivided by draws of their own until none is
    left that can be parted, and the exact bytes of the ranges say where each shard begins. A row or group of equal texts lies where its
    middle does, so a shard begins and ends at most half a group from where it would, and a shard's bytes are within
    ``tolerance`` of the mean, or one row. Equal texts share a shard, save groups larger than that, which are parted row by row.

    Returns ``(id, size, text_crc32, law, shard, slot, grown_shard)``. A null text has size 1 and no bytes; texts of any length
    count whole; null ids and repeated rows are rows like others, each with its slot; ties of key are broken by the id; an
    empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"), F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(id_col), F.lit(3))).alias("mark"),
    ))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    kind = df.schema[id_col].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"`{id_col}` {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    ranges = shards * min(MOST_RANGES, max(RANGES_PER_SHARD, -(-count // (shards * ROWS_PER_RANGE))))
    # at most shards / tolerance keys can be so large
    large = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") > total * tolerance / shards))
    hot = {r.key for r in large.select("key").collect()}
    splitters = sorted(_splitters(_draw(rows, total, keys_per_range * ranges), ranges, hot))
    done: set[tuple] = set()
    while True:
        dealt = rows.withColumn("range", _range_of(splitters, hot))
        sums = {r.range: (r.bytes, r.n) for r in dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        # what a range lies between names it; one whose own draw gave no splitter within it is a single key, or a few rows
        ends = lambda k: (splitters[k - 1] if k else None, splitters[k] if k < len(splitters) else None)  # noqa: B023, E731
        over = [k for k, (size, n) in sums.items() if size > OVERFULL * total / ranges and n > 64 and ends(k) not in done]
        if not over:
            break
        done |= {ends(k) for k in over}
        drawn = _draw(dealt.where(F.col("range").isin(over)), sum(sums[k][0] for k in over), keys_per_range * 4 * len(over))
        splitters = sorted({*splitters, *_splitters(drawn, 4 * len(over), hot)})
    offsets, size, n = [], 0, 0
    for k in sorted(sums):
        offsets.append((k, size, n))
        size, n = size + sums[k][0], n + sums[k][1]
    order = Window.partitionBy("range").orderBy("key", "crc", "mark", "id")
    group = Window.partitionBy("range", "key", "crc")
    placed = dealt.select("*", (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"), F.row_number().over(order).alias("nth"))
    whole = F.min("before").over(group) + F.sum("size").over(group) / 2
    middle = F.col("before") + F.col("size") / 2
    placed = placed.withColumn("middle", F.when(F.col("key").isin(sorted(hot)), middle).otherwise(whole) if hot else whole)
    placed = placed.join(F.broadcast(spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")), "range")
    spot = F.floor((F.col("middle") + F.col("bytes_before")) / F.lit(float(total)) * shards).cast("int")
    placed = cut(placed.select("id", "size", "crc", F.least(spot, F.lit(shards - 1)).alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, folder: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of ``df`` as Parquet under ``folder/shard=N``, in slot order; returns :func:`assign` of them.

    Every row is written once, with a null id or a repeated one too: rows are numbered in a copy, and joined by number.
    """
    numbered = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    marked = numbered.select("__row", F.col(text_col).alias("__text"))
    placed = cut(assign(marked, shards, "__row", "__text"))
    rows = numbered.drop(*[c for c in ("shard", "slot") if c in df.columns]).join(placed.select("__row", "shard", "slot"), "__row")
    rows.repartitionByRange(max(shards, rows.sparkSession.sparkContext.defaultParallelism), "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot", "__row").write.partitionBy("shard").parquet(folder)
    return numbered.select("__row", F.col(id_col)).join(placed, "__row").drop("__row")


def shard_of(value: tuple[int, int], splitters: list[tuple[int, int]]) -> int:
    """The range of one key, for tests and lookups."""
    return bisect_right(splitters, value)
