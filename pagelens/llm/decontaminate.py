"""Benchmark decontamination: BM25 over test items with block-max bounds, then exact overlap of question and answer.

Test items are the indexed side, since they are few; every passage of every training text is a query. Question and answer
of an item are parts of their own, and one longer than ``SEGMENT_WORDS`` is several; either retrieves the item. A score is
divided by what the part would score against itself, so one threshold holds for all. Parts lie in blocks; for each term and
block the index has the highest score the term can give there, and where its postings of that block lie. A passage's sum of
the terms' highest scores anywhere says whether it can reach the threshold at all; if so, its sums block by block say in
which blocks, and only the postings of its terms in those are read: WAND's pruning, done for all passages of a batch at
once. No passage is left out: a bound never falls below the score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_WORD, shingle_numbers, text_slices, tidy, word_numbers

K1, B = 1.2, 0.75
#: Half a passage; passages begin every so many words and overlap by half.
CELL_WORDS = 32
#: Words of an indexed part at most, and words of an answer at least to be one; a shorter one is found with its question.
SEGMENT_WORDS, ANSWER_WORDS = 48, 5
#: Share of a part's score against itself that a passage must reach.
THRESHOLD = 0.5
#: Items of one index, which is sent to every task; more items are searched in several passes.
INDEX_ITEMS = 2000
BLOCKS = 64


def numbers_of(texts: list[str]) -> list[np.ndarray]:
    """Word numbers of each text as the search reads them: lower case, runs of ASCII letters, digits and longer characters."""
    out: list[np.ndarray] = []
    for _, data, offsets in text_slices(pc.utf8_lower(pa.array(texts, pa.string()))):
        words, bounds = word_numbers(data, offsets, NOT_WORD, lower=False)
        out += [words[a:z] for a, z in zip(bounds[:-1], bounds[1:])]
    return out


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; one sentence alone is the question."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text.strip(), "")


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    return next(iter(shingle_numbers(words, np.array([0, len(words)]), k)))


def needed(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Shingle length of a part of an item, five or all of its words, and its shingles."""
    k = max(1, min(5, len(words)))
    return k, shingles(words, k)


class ItemIndex:
    """Postings and block bounds of up to INDEX_ITEMS test items."""

    def __init__(self, items: list[tuple[int, str]]):
        parts: list[np.ndarray] = []
        self.item: list[int] = []
        self.ids = [i for i, _ in items]
        self.needed: list[list[tuple[int, np.ndarray]]] = []
        for n, (_, text) in enumerate(items):
            both = numbers_of(list(question_and_answer(text)))
            self.needed.append([needed(x) for x in both])
            for words in both[: 2 if len(both[1]) >= ANSWER_WORDS else 1]:
                for x in np.array_split(words, max(1, -(-len(words) // SEGMENT_WORDS))):
                    if len(x):
                        parts.append(x)
                        self.item.append(n)
        mean = sum(map(len, parts)) / max(1, len(parts))
        held = Counter(t for x in parts for t in set(x.tolist()))
        self.terms = np.array(sorted(held), np.uint64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for p, x in enumerate(parts):
            own = {}
            for t, tf in Counter(x.tolist()).items():
                idf = math.log(1 + (len(parts) - held[t] + 0.5) / (held[t] + 0.5))
                own[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
            total = sum(own.values())
            for t, score in own.items():
                postings[place[t]].append((p, score / total))
        self.size = -(-max(1, len(parts)) // BLOCKS)
        self.bounds = np.zeros((len(self.terms) + 1, BLOCKS), np.float32)
        # postings of a term by block: those of term t and block b lie from start[t, b] to start[t, b + 1]
        self.start, self.part, self.score = np.zeros((len(self.terms) + 1, BLOCKS + 1), np.int64), [], []
        for t in range(len(self.terms)):
            blocks = np.array([p // self.size for p, _ in postings[t]])
            self.start[t] = len(self.part) + np.searchsorted(blocks, np.arange(BLOCKS + 1))
            for p, score in postings[t]:
                b = p // self.size
                self.bounds[t, b] = max(self.bounds[t, b], np.nextafter(np.float32(score), np.float32(2)))
                self.part.append(p)
                self.score.append(score)
        self.part, self.score = np.array(self.part, np.int64), np.array(self.score)
        self.most = self.bounds.max(axis=1)
        #: postings read so far, and those that the terms of the asked passages have in all
        self.read = self.held = 0
        self.item = np.array(self.item, np.int64)
        self.table = np.full(1 << 18, len(self.terms), np.int32)
        self.table[(self.terms >> np.uint64(46)).astype(np.int64)] = np.arange(len(self.terms))
        #: terms that share a slot with another one are looked up by bisection
        self.crowded = np.bincount((self.terms >> np.uint64(46)).astype(np.int64), minlength=1 << 18) > 1

    def term_of(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's term; one more than the last for words that no item has."""
        if not len(self.terms):
            return np.zeros(len(words), np.int64)
        slot = (words >> np.uint64(46)).astype(np.int64)
        at = self.table[slot].astype(np.int64)
        wrong = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] != words)
        at[wrong] = len(self.terms)
        if len(again := np.flatnonzero(wrong & self.crowded[slot])):
            found = np.minimum(np.searchsorted(self.terms, words[again]), len(self.terms) - 1)
            at[again] = np.where(self.terms[found] == words[again], found, len(self.terms))
        return at

    def search(self, words: np.ndarray, bounds: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
        """Best score of each (row, item) of which some passage reaches the threshold."""
        none = len(self.terms)
        term = self.term_of(words)
        known = np.flatnonzero(term < none)
        row = np.searchsorted(bounds, known, "right") - 1
        cells = -(-np.diff(bounds) // CELL_WORDS)
        base = np.concatenate(([0], np.cumsum(cells + 1)))  # an empty cell parts one row's passages from the next
        cell = base[row] + (known - bounds[row]) // CELL_WORDS
        term = term[known]
        if not len(cell):
            return {}
        # a term counts once in a cell
        key = np.sort(cell * (none + 1) + term)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        cell, term = key // (none + 1), key % (none + 1)
        edges = np.flatnonzero(np.diff(cell, prepend=-1))
        highest = np.zeros(base[-1] + 1, np.float32)
        highest[cell[edges]] = np.add.reduceat(self.most[term], edges)
        least = threshold * (1 - 1e-4)
        asked = np.flatnonzero(highest[:-1] + highest[1:] >= least)
        # sums block by block, of the cells of these passages alone
        need = np.zeros(base[-1] + 1, bool)
        need[asked] = need[asked + 1] = True
        cell, term = cell[need[cell]], term[need[cell]]
        edges = np.flatnonzero(np.diff(cell, prepend=-1))
        sums = np.zeros((base[-1] + 1, BLOCKS), np.float32)
        for a in range(0, len(edges), 20_000):
            z = edges[a + 20_000] if a + 20_000 < len(edges) else len(term)
            sums[cell[edges[a : a + 20_000]]] = np.add.reduceat(self.bounds[term[edges[a] : z]], edges[a : a + 20_000] - edges[a], axis=0)
        open_ = sums[asked] + sums[asked + 1] >= least
        some_open = open_.any(axis=1)
        asked, open_ = asked[some_open], open_[some_open]
        out: dict[tuple[int, int], float] = {}
        for at in range(0, len(asked), 2000):
            some = asked[at : at + 2000]
            low, high = np.searchsorted(cell, [some, some + 2])
            each = np.repeat(np.arange(len(some)), high - low)
            each, own = np.divmod(np.unique(each * (none + 1) + term[_runs(low, high)]), none + 1)
            self.held += int((self.start[own, -1] - self.start[own, 0]).sum())
            # each open block of a passage with each of its terms
            first = np.searchsorted(each, np.arange(len(some) + 1))
            which, block = np.nonzero(open_[at : at + 2000])
            n = np.diff(first)[which]
            t, block, each = own[_runs(first[which], first[which + 1])], np.repeat(block, n), np.repeat(which, n)
            a, z = self.start[t, block], self.start[t, block + 1]
            at_posting = _runs(a, z)
            self.read += len(at_posting)
            each = np.repeat(each, z - a)
            part = self.part[at_posting]
            score = np.bincount(each * len(self.item) + part, self.score[at_posting], minlength=0)
            hit = np.flatnonzero(score >= threshold)
            rows = np.searchsorted(base, some[hit // len(self.item)], "right") - 1
            for r, i, s in zip(rows.tolist(), self.item[hit % len(self.item)].tolist(), score[hit].tolist()):
                out[r, i] = max(s, out.get((r, i), 0.0))
        return out


def _runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each low up to its high, one run after the other."""
    n = high - low
    return np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def overlaps(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, share: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Test items that training texts hold: one row per (document row, item).

    Retrieved are the items of which a part scores at least ``threshold`` of its own score in a passage of the text; kept are
    those of which at least ``share`` hundredths of the distinct 5-word shingles of the question are in the text, and of those
    of the answer. Texts of any length are read whole; a score of just the threshold, or just the share, counts.
    Returns ``(id, item, score, question_shingles, question_found, answer_shingles, answer_found)``; a part of fewer than five
    words is one shingle of its own length. Null or empty texts and items without words match nothing; null ids are kept as
    they are; repeated rows each give their rows; no items or no texts give no rows; other columns are left out.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, question_shingles long, question_found long, answer_shingles long, answer_found long"
    listed = items.select(F.col(item_col).alias("item"), F.coalesce(item_text, F.lit("")).alias("t"))
    count = listed.count()
    passes = max(1, -(-count // INDEX_ITEMS))
    out = None
    for k in range(passes):
        own = listed.where(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == k) if passes > 1 else listed
        found = _pass(docs, sorted(map(tuple, own.collect()), key=str), threshold, share, id_col, text_col, item_col, schema)
        out = found if out is None else out.unionByName(found)
    return out


_held: dict[str, ItemIndex] = {}


def _index(name: str, items: list[tuple[int, str]]) -> ItemIndex:
    """The index of one pass, built once in each worker process."""
    if name not in _held:
        _held.clear()
        _held[name] = ItemIndex(items)
    return _held[name]


def _pass(docs: DataFrame, items: list[tuple[int, str]], threshold: float, share: int, id_col: str, text_col: str, item_col: str, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent.value)
        ids = pa.array([i for i, _ in sent.value])
        for b in batches:
            lower = pc.utf8_lower(b.column(1))
            for at, data, offsets in text_slices(lower):
                words, bounds = word_numbers(data, offsets, NOT_WORD, lower=False)
                found = index.search(words, bounds, threshold)
                rows = []
                sets: dict[tuple[int, int], np.ndarray] = {}
                for (r, i), score in sorted(found.items()):
                    hits = []
                    for k, x in index.needed[i]:
                        if (r, k) not in sets:
                            sets = {at_k: s for at_k, s in sets.items() if at_k[0] == r}
                            sets[r, k] = shingles(words[bounds[r] : bounds[r + 1]], k)
                        own = sets[r, k]
                        hits.append(int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum()) if len(own) else 0)
                    (_, q), (_, a) = index.needed[i]
                    if len(q) + len(a) and all(100 * h >= share * len(x) for h, x in zip(hits, (q, a))):
                        rows.append((at + r, i, score, len(q), hits[0], len(a), hits[1]))
                if rows:
                    c = list(zip(*rows))
                    cols = [b.column(0).take(pa.array(c[0])), ids.take(pa.array(c[1])), pa.array(c[2], pa.float64()), *(pa.array(x, pa.int64()) for x in c[3:])]
                    yield pa.RecordBatch.from_arrays(cols, names=[id_col, item_col, "score", "question_shingles", "question_found", "answer_shingles", "answer_found"])

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no test item, all columns kept. Rows that share the id of one that does go with it;
    rows with a null id stay."""
    bad = overlaps(docs, items, id_col=id_col, text_col=text_col).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti")
