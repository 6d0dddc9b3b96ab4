"""What the training-data operators share: the shared folder, checkpoints, joins with hot keys and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session whose executors live in
    the driver's own machine gets a new local folder; on a cluster that is an error, as executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            folder = got.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor repeats nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys with more rows than this, or than one ten-thousandth of all rows, are hot: at most so many can be.
HOT_ROWS, HOT_KEYS = 2000, 10_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str | list[str], many: str, total: int, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and in ``many`` how many of the ``total`` rows have it.

    Facts of hot keys are broadcast, so their rows stay where they are. There are HOT_KEYS of them at most, whatever the
    data: each has over ``total / HOT_KEYS`` of the rows. The rest is shuffled and merged, where no key has more rows than that;
    Spark's own choice, a broadcast of up to 10 MB for each of many joins, fills a small driver. ``how`` is inner or left;
    keys of up to ``least`` rows are never hot; ``many`` stays in the result.
    """
    bound = max(least, -(-total // HOT_KEYS))
    hot = facts.where(F.col(many) > bound)
    if total <= bound or hot.isEmpty():
        return rows.join(facts.hint("merge"), key, how)
    cool = rows.join(F.broadcast(hot.drop(*(set(facts.columns) - set([key] if isinstance(key, str) else key)))), key, "left_anti").join(facts.where(F.col(many) <= bound).hint("merge"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cool)


#: Edges that a task of a round holds, about; a small graph needs no more tasks than its edges fill.
EDGES_PER_TASK = 50_000
#: Edges of one node that a task takes whatever the graph's size; nodes with more are hubs.
HUB_EDGES = 200_000


def _state(e: DataFrame) -> tuple:
    """Number of edges and a sum over them that changes when they do."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node that has an edge, save the roots.

    ``root`` is the smallest node id that links reach. Large-star and small-star rounds alternate
    (Kiveris et al., 2014) until the edges stop changing; each round is written to the shared folder. Loops,
    repeated edges and nulls have no effect. A hub is never one task's rows: the minimum of its neighbours is partially
    aggregated, and joined by :func:`with_facts`.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, _state(e)
    while now != before:
        tasks = -(-now[0] // EDGES_PER_TASK) or 1
        few = lambda df: df.coalesce(tasks)  # noqa: B023, E731
        keep = cut if 2 * now[0] > HUB_EDGES else lambda df: df  # fewer edges have no hub to look for
        e = few(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(few(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))))
        large = few(with_facts(both, least, "u", "n", 2 * now[0], least=HUB_EDGES)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(few(large.where("u <> v").distinct()))
        down = keep(few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))))
        small = few(with_facts(large, down, "u", "n", now[0], least=HUB_EDGES)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(few(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()))
        before, now = now, _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """:func:`stars` with a row for each root too."""
    e = stars(edges)
    return e.unionByName(e.select(F.col("root").alias("node"), "root").distinct())
