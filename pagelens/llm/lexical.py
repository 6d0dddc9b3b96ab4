"""Ranked lexical search of many queries at once: shared term sets are found among the queries, and each is scored once a document."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .words import NOT_WORD, text_slices, tidy, word_numbers

#: Documents that an item's ranking keeps.
TOP = 50
#: Pairs of item and term that one pass over the index takes; an item with more is a pass of its own.
PASS_TERMS = 100_000
#: A term of a query is paired with so many that follow it in the common order, to find shared sets.
REACH = 8
#: Bytes of a task's table of accumulators.
TABLE_BYTES = 48 << 20
#: Bits of the map of the items' terms, which is of one size whatever the items; a term of no item that meets one is indexed for nothing.
MAP_BITS = 1 << 23
#: Part of a document's length in its weight, in hundredths.
LENGTH_SHARE = 50
NULL_ID = -(2**63)


def _terms(df: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None) -> DataFrame:
    """A row per row of ``df``: id, number of terms, and the distinct terms, as sorted 64-bit numbers, with their counts; only
    such as meet ``bits``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_slices(b.column(1)):
                words, bounds = word_numbers(data, offsets, NOT_WORD, lower=True)
                terms, counts = [], []
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = words[a:z]
                    if bits is not None:
                        at = own % np.uint64(MAP_BITS)
                        own = own[bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
                    t, c = np.unique(own, return_counts=True)
                    terms.append(t.tobytes())
                    counts.append(c.astype("<u4").tobytes())
                n = pa.array(np.diff(bounds).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(terms)), n, pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "terms", "counts"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, n long, terms binary, counts binary")


def _each_term(rows: DataFrame) -> DataFrame:
    """``(id, term)`` for each distinct term of the rows of :func:`_terms`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [np.frombuffer(t, np.int64) for t in b.column(1).to_pylist()]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([*terms, np.zeros(0, np.int64)]))], names=["id", "term"])

    return rows.select("id", "terms").mapInArrow(run, "id long, term long")


def _bits(terms: DataFrame) -> np.ndarray:
    """The map of the terms: MAP_BITS bits, as rows of built-in bitmaps of 4,096 bytes each."""
    at = F.pmod("term", F.lit(MAP_BITS))
    got = terms.select(at.alias("at")).distinct().groupBy(F.floor(F.col("at") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(MAP_BITS >> 3, np.uint8)
    for r in got.collect():
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


class Sharing:
    """How items share term sets: a graph of sums whose leaves are terms.

    Terms that the same items hold are one set. Then the pair of sets that most items hold together, among neighbours in the common
    order of sets, becomes a set of its own, until no pair is held by two items; what is left of an item is added up
    in that order. Each set's sum is worked out once a document, whatever number of items hold it.
    """

    def __init__(self, items: dict[int | None, set[int]]):
        holders = defaultdict(list)
        for k, (_, terms) in enumerate(sorted(items.items(), key=lambda x: (x[0] is not None, x[0]))):
            for t in terms:
                holders[t].append(k)
        self.items = sorted(items, key=lambda x: (x is not None, x))
        self.terms = np.array(sorted(holders), np.int64)
        number = {t: i for i, t in enumerate(self.terms.tolist())}
        alike = defaultdict(list)
        for t in self.terms.tolist():
            alike[tuple(holders[t])].append(number[t])
        self.sums: list[tuple[int, int]] = []
        lists: list[list[int]] = [[] for _ in self.items]
        # sets of most items first, so that what many items share stands together
        for held, own in sorted(alike.items(), key=lambda x: (-len(x[0]), x[1])):
            node = self._chain(own)
            for k in held:
                lists[k].append(node)
        self._share(lists)
        self.roots = [self._chain(x) if x else -1 for x in lists]
        self._by_depth()

    def _sum(self, a: int, b: int) -> int:
        self.sums.append((a, b))
        return len(self.terms) + len(self.sums) - 1

    def _chain(self, nodes: list[int]) -> int:
        while len(nodes) > 1:  # as a balanced tree, so that depth stays small
            nodes = [self._sum(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def _share(self, lists: list[list[int]]) -> None:
        near = lambda x: {(min(a, b), max(a, b)) for i, a in enumerate(x) for b in x[i + 1 : i + 1 + REACH]}
        where = defaultdict(set)
        for k, x in enumerate(lists):
            for p in near(x):
                where[p].add(k)
        queue = [(-len(w), p) for p, w in where.items() if len(w) > 1]
        heapify(queue)
        while queue:
            many, (a, b) = heappop(queue)
            held = where.get((a, b), set())
            if len(held) < 2:
                continue
            if -many != len(held):
                heappush(queue, (-len(held), (a, b)))
                continue
            node, touched = self._sum(a, b), Counter()
            for k in sorted(held):
                before = near(lists[k])
                at = lists[k].index(a), lists[k].index(b)
                lists[k][min(at)] = node
                del lists[k][max(at)]
                after = near(lists[k])
                for p in before - after:
                    where[p].discard(k)
                for p in after - before:
                    where[p].add(k)
                    touched[p] += 1
            for p in touched:
                if len(where[p]) > 1:
                    heappush(queue, (-len(where[p]), p))

    def _by_depth(self) -> None:
        """Number the sums by depth, as arrays: all sums of one depth are added at once."""
        depth = [0] * len(self.terms)
        for a, b in self.sums:
            depth.append(1 + max(depth[a], depth[b]))
        order = sorted(range(len(self.sums)), key=lambda s: depth[len(self.terms) + s])
        number = np.arange(len(depth))
        for new, s in enumerate(order):
            number[len(self.terms) + s] = len(self.terms) + new
        pairs = np.array([self.sums[s] for s in order], np.int64).reshape(-1, 2)
        self.left, self.right = number[pairs[:, 0]], number[pairs[:, 1]]
        deep = np.array([depth[len(self.terms) + s] for s in order], np.int64)
        self.steps = np.searchsorted(deep, np.arange(1, (deep.max() if len(deep) else 0) + 2)).tolist()
        self.roots = np.array([number[r] if r >= 0 else -1 for r in self.roots], np.int64)
        self.nodes = len(depth)

    def add_up(self, table: np.ndarray) -> np.ndarray:
        """Fill in the sums of ``table (node, document)``, whose first rows are the terms', and give the items' rows."""
        n = len(self.terms)
        for a, z in zip(self.steps, self.steps[1:]):
            table[n + a : n + z] = table[self.left[a:z]] + table[self.right[a:z]]
        return table[self.roots]


def _score(index: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best ``top`` documents of each item in each task, by number of the item."""
    terms, nodes = sharing.terms.view(np.uint64), sharing.nodes
    order = np.argsort(terms)
    ordered = terms[order]
    wide = max(1, min(512, TABLE_BYTES // (8 * max(1, nodes))))
    asked = np.flatnonzero(sharing.roots >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, 3), np.int64)  # item, score, id
        fresh: list[np.ndarray] = []
        least = np.ones(len(sharing.items), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, wide):
                rows = b.slice(at, wide)
                ids = rows.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                length = rows.column(1).to_numpy()
                held = rows.column(2).to_pylist()
                term = np.frombuffer(b"".join(held), np.uint64)
                count = np.frombuffer(b"".join(rows.column(3).to_pylist()), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(len(held)), [len(h) // 8 for h in held])
                spot = np.minimum(np.searchsorted(ordered, term), len(ordered) - 1)
                found = ordered[spot] == term
                spot, count, doc = order[spot[found]], count[found], doc[found]
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // n_terms
                table = np.zeros((nodes, len(held)), np.int64)
                table[spot, doc] = weights[spot] * (1_000_000_000 * count // (1000 * count + 20 * m[doc]))
                scores = sharing.add_up(table)
                item, doc = np.nonzero(scores[asked] >= least[asked][:, None])
                item = asked[item]
                fresh.append(np.column_stack([item, scores[item, doc], ids[doc]]))
                if sum(map(len, fresh)) > 4 * top * len(asked) + 10_000:
                    best, fresh = _keep([best, *fresh], top), []
                    full = np.flatnonzero(np.bincount(best[:, 0], minlength=len(least)) == top)
                    lows = np.full(len(least), np.iinfo(np.int64).max)
                    np.minimum.at(lows, best[:, 0], best[:, 1])
                    least[full] = lows[full]
        best = _keep([best, *fresh], top)
        yield pa.RecordBatch.from_arrays([pa.array(best[:, k]) for k in range(3)], names=["item", "score", "id"])

    return index.mapInArrow(tidy(run), "item long, score long, id long")


def _keep(rows: list[np.ndarray], top: int) -> np.ndarray:
    """Each item's ``top`` rows, highest score first, equal ones by id."""
    r = np.concatenate(rows)
    r = r[np.lexsort((r[:, 2], -r[:, 1], r[:, 0]))]
    first = np.searchsorted(r[:, 0], r[:, 0])
    return r[np.arange(len(r)) - first < top]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` highest-scoring documents of each item: ``(item_col long, rank int, id_col long, score long)``.

    The texts are read once: each document leaves its length and the counts of its terms that meet the fixed-size map of the
    items' terms, and these rows are written. Document frequencies are counted there; then each pass takes
    items with ``PASS_TERMS`` terms together, finds the term sets that they share, and scores every document: a set's sum is worked out once
    a document and goes into every item that holds the set. Tasks keep the best of each item, which are ranked
    over all in two steps, so no task gets more than its share of the candidates.

    Ids are long. Null or empty texts have no terms: such documents are in no ranking, such items in no result. Rows that repeat an
    item's id add their terms to it; null item ids are one item. Documents that repeat an id are ranked each for itself, and a null id
    counts as the smallest. Empty tables give no rows; other columns are left out. Terms are compared by 64-bit numbers.
    """
    spark = docs.sparkSession
    wanted = cut(_each_term(_terms(items, item_col, item_text, None)).distinct())
    schema = f"`{item_col}` long, rank int, `{id_col}` long, score long"
    if wanted.isEmpty():
        return spark.createDataFrame([], schema)
    index = cut(_terms(docs, id_col, text_col, _bits(wanted)))
    n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = _each_term(index).groupBy("term").agg(F.count("*").alias("df"))
    # each item's terms that some document has; items are dealt into passes by their numbers of terms
    wanted = cut(wanted.join(known.hint("merge"), "term"))
    out = None
    for ids in _passes(wanted):
        own = defaultdict(set)
        freq = {}
        rows = wanted.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "pick long")), F.col("id").eqNullSafe(F.col("pick")))
        for r in rows.collect():
            own[r.id].add(r.term)
            freq[r.term] = r.df
        sharing = Sharing(own)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * freq[t] + 1))) for t in sharing.terms.tolist()], np.int64)
        found = _score(index, sharing, weights, n_docs, n_terms, top)
        names = F.broadcast(spark.createDataFrame(list(enumerate(sharing.items)), f"item long, `{item_col}` long"))
        found = found.withColumn("part", F.spark_partition_id() % 64)
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        some = found.withColumn("rank", rank("item", "part")).where(F.col("rank") <= top)
        ranked = some.withColumn("rank", rank("item")).where(F.col("rank") <= top).join(names, "item")
        ranked = ranked.select(item_col, "rank", F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], schema)


def _passes(wanted: DataFrame) -> Iterator[list[int | None]]:
    """Ids of the items of each pass: about ``PASS_TERMS`` terms together. Rows of ``(id, number of terms)`` come one partition at a time."""
    held, size = [], 0
    for r in wanted.groupBy("id").count().toLocalIterator():
        if held and size + r["count"] > PASS_TERMS:
            yield held
            held, size = [], 0
        held.append(r.id)
        size += r["count"]
    if held:
        yield held
