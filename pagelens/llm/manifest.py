"""Merkle manifest of a table: leaf digests, subroots by group, a root, and a proof for every row, by lag and lead columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_facts

#: Consecutive nodes that become one, and nodes that a window holds, a multiple of it.
FAN, WINDOW_NODES = 8, 512


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, put together; digests count as their hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*columns: Column) -> Column:
    """Digest of a row: each column ``-`` if null, else its UTF-8 byte count, ``:`` and its value; integers are decimal."""
    texts = [c.cast("string") for c in columns]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` give, from the leaf's level up."""
    return F.aggregate(path, start, lambda h, level: digest(level["left"], h, level["right"]))


def siblings(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _places(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number in ``order`` from 0. Rows are dealt by ranges and numbered there; the driver
    sees a count per partition. Rows equal in ``order`` must be alike; ``__tie`` only parts a large run of them."""
    tied = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    ranged = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect()):
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("place", F.col("__before") + within).drop("__part", "__before", "__at")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(k, i, n, h)``, the ``n`` nodes of each ``k`` numbered ``i``, level by level up to one node a key.

    Each level adds ``left`` and ``right``, the siblings' digests put together, from lag and lead columns of fixed offsets
    that are masked by slot and run length; rows of slot 0 hash the parents. A node that is its key's last has no siblings.
    """
    out = []
    while True:
        window = Window.partitionBy("k", F.floor(F.col("i") / WINDOW_NODES)).orderBy("i")
        slot = F.col("i") % FAN
        run = F.least(F.lit(FAN), F.col("n") - F.col("i") + slot)
        left = F.concat_ws("", *(F.when(slot >= j, F.lag("h", j).over(window)) for j in range(FAN - 1, 0, -1)))
        right = F.concat_ws("", *(F.when(slot + j < run, F.lead("h", j).over(window)) for j in range(1, FAN)))
        level = cut(nodes.select("*", left.alias("left"), right.alias("right")))
        out.append(level)
        if level.where("n > 1").isEmpty():
            return out
        up = level.where((F.col("n") > 1) & (slot == 0))
        nodes = up.select("k", F.floor(F.col("i") / FAN).alias("i"), F.ceil(F.col("n") / FAN).alias("n"), digest(F.col("h"), F.col("right")).alias("h"))


def _tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of all nodes ``(k, i, path)`` to the top of their key's tree, and the tops ``(k, h)``."""
    levels = _levels(nodes)
    tops = levels[0].where("n = 1").select("k", "h")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1").select("k", "h"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = None
    for level in reversed(levels):
        own = level.where("n = 1").select("k", "i", none.alias("path"))
        if paths is not None:
            here = level.where("n > 1").select("k", "i", F.floor(F.col("i") / FAN).alias("up"), F.array(F.struct("left", "right")).alias("here"))
            above = here.join(paths.withColumnRenamed("i", "up").hint("merge"), ["k", "up"])
            own = own.unionByName(above.select("k", "i", F.concat("here", "path").alias("path")))
        paths = own
    return paths, tops


def prove(rows: DataFrame, leaf_col: str = "leaf", group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``path``: siblings of each level from the leaf to its group's subroot and on to the root.

    Leaves of a group ascend by id, nulls first, then by digest; rows equal in both are interchangeable. Every ``FAN``
    consecutive nodes become one, the last run having fewer, until one is left; subroots, ordered by group (null first, by
    bytes), likewise give the root. No group is one task's rows: leaves are dealt by ranges, windows hold ``WINDOW_NODES``
    nodes. Null groups are a group of their own; an empty table gives no rows. The other columns of ``rows`` stay, save such as have
    one of the three names.
    """
    rows = rows.drop("subroot", "root", "path")
    keyed = rows.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("")))
    placed = _places(keyed, ["__k", id_col, leaf_col])
    groups = cut(placed.groupBy("__k").agg(F.min("place").alias("__first"), F.count("*").alias("__n")))
    total = groups.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    leaves = cut(with_facts(placed, groups, "__k", "__n", total).withColumn("__i", F.col("place") - F.col("__first")).drop("place", "__first"))
    paths, tops = _tree(leaves.select(F.col("__k").alias("k"), F.col("__i").alias("i"), F.col("__n").alias("n"), F.col(leaf_col).alias("h")))
    tops = _places(tops, ["k"])
    above, root = _tree(tops.select(F.lit("").alias("k"), F.col("place").alias("i"), F.lit(groups.count()).cast("long").alias("n"), "h"))
    top = root.select(F.col("h").alias("root")).withColumn("one", F.lit(1))
    up = tops.join(above.select(F.col("i").alias("place"), F.col("path").alias("__above")).hint("merge"), "place").withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    facts = cut(up.select(F.col("k").alias("__k"), F.col("h").alias("subroot"), "root", "__above").join(groups.drop("__first"), "__k"))
    out = leaves.join(paths.select(F.col("k").alias("__k"), F.col("i").alias("__i"), "path").hint("merge"), ["__k", "__i"])
    out = with_facts(out.drop("__n"), facts, "__k", "__n", total)
    return out.withColumn("path", F.concat("path", "__above")).select(*rows.columns, "subroot", "root", "path")


def verify(rows: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``rows`` of :func:`prove` with ``folded_root``, recomputed from ``leaf_col``, and whether it is the root."""
    return rows.withColumn("folded_root", fold(F.col(leaf_col), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
