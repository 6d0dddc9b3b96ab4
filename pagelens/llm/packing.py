"""Packing of whole documents into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import cut
from .words import text_slices, tidy

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 2048, 0
#: Pieces that one population packs, about; more pieces make more blocks.
BLOCK_PIECES = 4096
#: Populations of a block, solutions in each, times that elites migrate, and children between two migrations.
ISLANDS, SOLUTIONS, MIGRATIONS, CHILDREN = 3, 6, 3, 48
#: Sequences with this share of their tokens free are dissolved, and dealt again with those of other blocks.
ILL_FILLED = 1 / 64
#: Different words whose ids a worker keeps, for all its tasks, and bytes of a text whose words it holds at a time.
KEPT_WORDS, PART_BYTES = 500_000, 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Words of printable ASCII and Latin-1 letters, which normalisation only lower-cases, and the file's own pattern on these.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Merged(dict):
    """Ids of parts of words, merged by the tokenizer's model when first asked for."""

    def __init__(self, model):
        self.merge, self.as_chars = model.tokenize, {i: c for i, c in enumerate(byte_characters()) if i > 126}

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.as_chars)
        got = self[part] = b"".join([t.id.to_bytes(4, "little") for t in self.merge(shown)])
        return got


class WordIds:
    """Ids of whole texts by a tokenizer file that drops white space, from the ids of their words.

    No token crosses white space, so words between ASCII white space are encoded once and kept. Plain words are parted by the
    file's pattern and each part merged by its model; others, and such as may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts = _Merged(self.whole.model)

    def _learn(self, words: set[bytes]) -> None:
        for kept in (self.words, self.parts):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        other, part = [], self.parts.__getitem__
        for w in words.difference(self.words):
            text = w.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                self.words[w] = b"".join(map(part, _PARTS.findall(text.lower())))
            else:
                other.append(w)
        for at in range(0, len(other), 1000):
            some = other[at : at + 1000]
            for w, e in zip(some, self.whole.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.words[w] = np.array(e.ids, "<u4").tobytes()

    def _long(self, raw: bytes) -> bytes:
        out, at = [], 0
        while at < len(raw):
            end = _BLANK.search(raw, at + PART_BYTES)
            to = end.start() if end else len(raw)
            out += self.encode([raw[at:to]])
            at = to + 1
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, which are a few MB together or one of them longer, as little-endian unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > PART_BYTES and _BLANK.search(texts[0], PART_BYTES):
            return [self._long(texts[0])]
        split = [t.split() for t in texts]
        self._learn(set().union(*split))
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in split]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    """One per worker process."""
    return WordIds(path)


def pieces(df: DataFrame, path: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Each document's ids with ``END`` after them, in pieces of ``most`` tokens of which the last may be shorter.

    Returns ``(id_col, piece int, start long, length long, ids_crc32 long[, ids binary])``; ids are little-endian unsigned 32-bit
    integers. A null or empty text is one piece of ``END`` alone; a special token's string in a text is that token; null ids and
    repeated rows are documents like others; an empty table gives no rows; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _word_ids(path)
        for b in batches:
            for first, data, offsets in text_slices(b.column(1)):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                texts = [data[a:z].tobytes() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                for i, raw in enumerate(t.encode(texts)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * most)):
                        one = raw[at : at + 4 * most]
                        row.append(first + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if ids:
                            held.append(one)
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(held, pa.binary())] * ids, names=names)

    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def best_fit(lengths: np.ndarray, order: np.ndarray, group: np.ndarray, space: list[int], most: int) -> int:
    """Put the items of ``order`` one by one where least space is left, opening groups as needed; sets their ``group``.

    ``space`` is what each group has free; returns how many groups there are then. Groups with equal space are on one
    stack, and the bits of a number say which spaces occur.
    """
    stacks: list[list[int]] = [[] for _ in range(most + 1)]
    spaces, opened = 0, len(space)
    for g, s in enumerate(space):
        if s:
            stacks[s].append(g)
            spaces |= 1 << s
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = spaces >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            g = stacks[s].pop()
            if not stacks[s]:
                spaces ^= 1 << s
        else:
            s, g, opened = most, opened, opened + 1
        group[i] = g
        if s > n:
            stacks[s - n].append(g)
            spaces |= 1 << s - n
    return opened


class Population:
    """Solutions of one block on one island: which group each item is in, best first.

    A solution is better with fewer groups, then with a larger sum of squared fills, as that leaves free space together.
    """

    def __init__(self, lengths: np.ndarray, most: int, seed: int):
        self.lengths, self.most, self.rng = lengths, most, np.random.default_rng(seed)
        self.least = -(-int(lengths.sum()) // most)
        self.solutions: list[tuple[tuple[int, int], np.ndarray]] = []

    def fills(self, group: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=self.lengths).astype(np.int64)

    def add(self, group: np.ndarray) -> None:
        """Take a solution in unless an equal one is there; the worst goes when there are too many."""
        fills = self.fills(group)
        worth = (len(fills), -int((fills * fills).sum()))
        if all(worth != w for w, _ in self.solutions):
            self.solutions = sorted([*self.solutions, (worth, group)], key=lambda s: s[0])[:SOLUTIONS]

    def found(self) -> None:
        """First solutions: best fit by falling length, then with lengths blurred."""
        for k in range(SOLUTIONS):
            order = np.argsort(-self.lengths * (self.rng.uniform(0.85, 1.15, len(self.lengths)) if k else 1), kind="stable")
            group = np.zeros(len(order), np.int32)
            best_fit(self.lengths, order, group, [], self.most)
            self.add(group)

    def cross(self, into: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Whole well-filled groups of ``source`` put into ``into``: groups there that hold one of their items are dissolved, as are a
        few of the worst filled, and what loses its place is put back by best fit."""
        fills = self.fills(source)
        well = (fills >= np.median(fills)) & (self.rng.random(len(fills)) < self.rng.uniform(0.05, 0.4))
        moved = well[source]
        own = self.fills(into)
        gone = np.zeros(len(own), bool)
        gone[into[moved]] = True
        gone[np.argsort(own, kind="stable")[: 1 + self.rng.integers(4)]] = True
        stay, lost = ~gone[into] & ~moved, np.flatnonzero(gone[into] & ~moved)
        group = np.zeros(len(into), np.int32)
        group[stay] = (np.cumsum(~gone) - 1)[into[stay]]
        group[moved] = (np.cumsum(well) - 1 + (~gone).sum())[source[moved]]
        space = self.most - np.concatenate([own[~gone], fills[well]])
        best_fit(self.lengths, lost[np.argsort(-self.lengths[lost], kind="stable")], group, space.tolist(), self.most)
        return group

    def evolve(self) -> None:
        for _ in range(CHILDREN):
            if len(self.solutions) < 2 or self.solutions[0][0][0] == self.least:
                return
            a, b = self.rng.choice(len(self.solutions), 2, replace=False)
            self.add(self.cross(self.solutions[min(a, b)][1], self.solutions[max(a, b)][1]))
            self.add(self.cross(self.solutions[max(a, b)][1], self.solutions[min(a, b)][1]))


_STATE = "block long, island int, items array<struct<n:long,length:int>>, held array<binary>, elite binary, bins long, least long, squares long"


def _evolve(state: DataFrame, most: int, step: int) -> DataFrame:
    """One round of every island: its solutions and the elite that came in, evolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                block, island, items, held, came = row.columns
                lengths = np.asarray(items.flatten().field("length")).astype(np.int64)
                p = Population(lengths, most, hash((block[0].as_py(), island[0].as_py(), step)) % 2**63)
                for raw in [*(held[0].as_py() or []), *([came[0].as_py()] if came[0].is_valid else [])]:
                    p.add(np.frombuffer(raw, np.int32))
                if not p.solutions:
                    p.found()
                p.evolve()
                (bins, squares), best = p.solutions[0]
                out = [[g.tobytes() for _, g in p.solutions]], [best.tobytes()], [bins], [p.least], [-squares]
                kinds = pa.list_(pa.binary()), pa.binary(), pa.int64(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([block, island, items, *map(pa.array, out, kinds)], names=["block", "island", "items", "held", "elite", "bins", "least", "squares"])

    return state.select("block", "island", "items", "held", "came").mapInArrow(tidy(run), _STATE)


def _spread(best: DataFrame, most: int) -> DataFrame:
    """A row per item of each block's best solution: its sequence, named by the smallest number in it, its place and the fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                flat = b.column(0).slice(r, 1).flatten()
                n, lengths = np.asarray(flat.field("n")), np.asarray(flat.field("length")).astype(np.int64)
                group = np.frombuffer(b.column(1)[r].as_py(), np.int32)
                order = np.lexsort((n, group))
                first = np.concatenate(([True], group[order][1:] != group[order][:-1]))
                before = np.cumsum(lengths[order]) - lengths[order]
                run_of = np.cumsum(first) - 1
                cols = n[order], n[order][first][run_of], before - before[first][run_of], np.bincount(group, weights=lengths).astype(np.int64)[group[order]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(lengths[order].astype(np.int32))], names=["n", "sequence_id", "offset", "fill", "length"])

    return best.select("items", "elite").mapInArrow(tidy(run), "n long, sequence_id long, offset long, fill long, length int")


def _solve(items: DataFrame, count: int, most: int, level: int) -> DataFrame:
    """Pack ``items (n, length)`` block by block; each block's islands evolve and pass their elites round a ring."""
    blocks = max(1, -(-count // BLOCK_PIECES))
    dealt = items.groupBy(F.pmod(F.xxhash64("n", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "length"))).alias("items"))
    islands = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items", F.lit(None).cast("array<binary>").alias("held"), F.lit(None).cast("binary").alias("came"))
    tasks = min(blocks * ISLANDS, max(items.sparkSession.sparkContext.defaultParallelism, blocks * ISLANDS // 16))
    state = cut(_evolve(islands.repartition(tasks, "block", "island"), most, 0))
    ring = Window.partitionBy("block").orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for step in range(1, MIGRATIONS + 1):
        if state.where("bins > least").isEmpty():
            break
        # a block that has a solution with the least number of sequences rests
        moved = state.withColumn("came", F.coalesce(F.lag("elite").over(ring), F.last("elite").over(whole)))
        state = cut(_evolve(moved.repartition(tasks, "block", "island"), most, step))
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "elite"), F.struct("bins", -F.col("squares"), "island")).alias("b")).select("b.*")
    return cut(_spread(best, most))


def pack(lengths: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Places for rows ``(n long, length)`` with different ``n``, in as few sequences of ``most`` as can be found.

    Returns ``(n, sequence_id, offset)``. A row of length ``most`` is a sequence of its own. The others are dealt by a hash of ``n``
    over blocks of about ``BLOCK_PIECES``, and each block is packed by a grouping genetic algorithm: islands breed
    solutions by injecting whole well-filled groups, and elites migrate. Ill-filled sequences of all blocks are dissolved and
    dealt again while at most half of the rows are left, so a task never holds more than a block and the free space of a block
    isn't lost. Rows longer than ``most``, or shorter than one, are an error of the caller.
    """
    items = lengths.where(F.col("length") < most).select("n", F.col("length").cast("int").alias("length"))
    out = lengths.where(F.col("length") >= most).select("n", F.col("n").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    count, level = items.count(), 0
    while count:
        placed = _solve(items, count, most, level)
        ill = F.col("fill") < most - most * ILL_FILLED
        rest = placed.where(ill).count() if count > BLOCK_PIECES else 0
        if not 0 < rest <= count // 2:
            out = out.unionByName(placed.select("n", "sequence_id", "offset"))
            break
        out = out.unionByName(placed.where(~ill).select("n", "sequence_id", "offset"))
        items, count, level = placed.where(ill).select("n", "length"), rest, level + 1
    return out


def pack_documents(df: DataFrame, path: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """:func:`pieces` of all documents with the sequence that each is in and its place there.

    Adds ``(sequence_id long, offset long)``; places of a sequence have no gaps. Pieces are numbered in a written copy, so repeated
    and null ids each keep their rows. An empty table gives no rows.
    """
    numbered = cut(pieces(df, path, most, id_col, text_col, ids).withColumn("__n", F.monotonically_increasing_id()))
    placed = pack(numbered.select(F.col("__n").alias("n"), "length"), most)
    return numbered.join(placed.withColumnRenamed("n", "__n").hint("merge"), "__n").drop("__n")


def sequences(df: DataFrame, path: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, length, ids binary, parts)``, ids as in :func:`pieces` and ``parts`` an
    array of ``(offset, length, id_col, piece)``, so that attention can be kept within documents."""
    rows = pack_documents(df, path, most, id_col, text_col, ids=True)
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", id_col, "piece", "ids")))
    grouped = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return grouped.select("sequence_id", "length", joined.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))
