"""Document quality by hierarchical empirical Bayes.

A document's own evidence joins two log-likelihood ratios, of binned text features and of its words, each counted over labelled
rows; how much either counts is fitted on rows that had no part in the counts. The expected share of good documents of
each host, and of each path on it, comes from the evidence of all other documents there; hosts with few documents are drawn
toward the global share and paths toward their host, as strongly as the spread between hosts (or paths) says. The posterior
joins the document's evidence with its path's share, in which it has no part itself, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_facts
from .words import NOT_WORD, text_slices, tidy, word_numbers

# Classes of bytes that features are shares of.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bang": b"!?", "bar": b"|", "mark": b"#$%&*^~@=<>{}[]\\_",
    "point": b".,;:", "quote": b"\"'()", "line": b"\n", "blank": b" \t\r\x0b\x0c",
}
FEATURES = [*_CLASSES, "word length", "new words", "new lines", "longest word", "length"]
#: Bounds of a share's bins; the other features' bounds follow.
_SHARES = [0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4]
_BOUNDS = {"word length": [2, 3, 4, 5, 6, 7, 8, 10, 15], "new words": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95], "new lines": [0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999], "longest word": [5, 10, 15, 20, 25, 30, 40, 80, 200], "length": [20, 60, 150, 400, 1000, 3000, 10000, 30000, 100000]}
#: Added to each count of a bin; keeps unseen bins from deciding alone.
SMOOTH = 5.0
#: Words fall into this many slots by their number.
SLOTS = 1 << 15
#: Labelled rows that evidence is fitted on, at most: those whose ids have the smallest hashes.
FIT_ROWS = 20_000
#: Strength by which fitted weights are held back, so that labels that words tell apart fully don't drive them off.
RIDGE = 1.0


def features(text: bytes) -> list[float]:
    """Values of FEATURES for one text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    n = max(1, len(text))
    out = [counts[list(c)].sum() / n for c in _CLASSES.values()]
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    return [*out, sum(map(len, words)) / w, len(set(words)) / w, len(set(lines)) / max(1, len(lines)), max(map(len, words), default=0), len(text)]


def _binned(values: np.ndarray) -> np.ndarray:
    return np.stack([np.digitize(values[:, i], _BOUNDS.get(f, _SHARES)) for i, f in enumerate(FEATURES)], axis=1)


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of the different words of each text."""
    words, bounds = word_numbers(data, offsets, NOT_WORD, lower=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return np.divmod(np.unique(row * SLOTS + (words >> np.uint64(49)).astype(np.int64)), SLOTS)


def _bins_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw, ends = data.tobytes(), offsets.tolist()
    return _binned(np.array([features(raw[a:z]) for a, z in zip(ends, ends[1:])]))


class Evidence:
    """Log-likelihood ratios by feature and bin and by slot, from counts ``[2, features, bins]``, ``[2, slots]`` and rows."""

    def __init__(self, bins: np.ndarray, slots: np.ndarray, rows: np.ndarray):
        both = (bins.sum(axis=0) + 1) / (bins.sum(axis=0) + 1).sum(axis=1, keepdims=True)
        share = (bins + SMOOTH * both) / (bins.sum(axis=2, keepdims=True) + SMOOTH)
        self.bins = np.log(share[1] / share[0])
        # words are drawn toward their share in all rows
        every = (slots.sum(axis=0) + 1) / (rows.sum() + 2)
        seen = (slots + SMOOTH * every) / (rows[:, None] + SMOOTH)
        self.words = np.log(seen[1] / seen[0])

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the evidence of its features, summed, and that of its words, over the root of their number."""
        row, slot = _slots(data, offsets)
        n = len(offsets) - 1
        words = np.bincount(row, self.words[slot], minlength=n) / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
        bins = _bins_of(data, offsets)
        return np.stack([self.bins[np.arange(len(FEATURES)), bins].sum(axis=1), words], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and weights of a logistic regression by Newton steps; weights are held back by RIDGE, and not below 0."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    hold = np.diag([0.0] + [RIDGE] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold + 1e-9 * np.eye(len(w)), z.T @ (y - p) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([w[:1], np.maximum(0, w[1:] / scale)])


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[Evidence, np.ndarray, float] | None:
    """Evidence, the weights of its two parts with the intercept before them, and the share of good rows, from at most
    FIT_ROWS labelled rows, one an id; None without labels of both kinds.

    Rows fall into two halves by their ids. What one half counts is held against the labels of the other, and the weights are
    fitted to that; the counts returned are of both. The driver gets counts of slots and two numbers of each labelled row.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select(F.col("doc_id").alias("__id"), (F.col("quality") > 0).cast("int").alias("__good"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("__half"))
    rows = cut(docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text")).join(F.broadcast(known), F.col("__own") == F.col("__id")).groupBy("__id", "__good", "__half").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).drop("__id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, SLOTS + len(FEATURES) * 10 + 1), np.int64)
        for b in batches:
            kind = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            for at, data, offsets in text_slices(b.column(2)):
                own = kind[at : at + len(offsets) - 1]
                row, slot = _slots(data, offsets)
                np.add.at(total, (own[row], slot), 1)
                np.add.at(total, (own[:, None], SLOTS + np.arange(len(FEATURES)) * 10 + _bins_of(data, offsets)), 1)
                np.add.at(total, (own, -1), 1)
        kind, what = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(what, pa.int32()), pa.array(total[kind, what], pa.int64())], names=["kind", "what", "n"])

    counts = np.zeros((2, 2, SLOTS + len(FEATURES) * 10 + 1))  # good, half
    for r in rows.mapInArrow(tidy(count), "kind int, what int, n long").groupBy("kind", "what").agg(F.sum("n").alias("n")).collect():
        counts[r.kind // 2, r.kind % 2, r.what] = r.n
    if not counts[:, :, -1].sum(axis=1).all():
        return None
    made = lambda c: Evidence(c[:, SLOTS:-1].reshape(2, len(FEATURES), 10), c[:, :SLOTS], c[:, -1])
    halves = [made(counts[:, 1]), made(counts[:, 0])]  # each half by what the other counts

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = b.column(1).to_numpy()
            for at, data, offsets in text_slices(b.column(2)):
                of = np.where(half[at : at + len(offsets) - 1, None] == 0, halves[0].of(data, offsets), halves[1].of(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(of)), pa.array(of[:, 0]), pa.array(of[:, 1])], names=["good", "a", "b"])

    held = rows.mapInArrow(tidy(hold), "good int, a double, b double").toPandas().sort_values(["good", "a", "b"]).to_numpy(float)
    share = float(held[:, 0].mean())
    return made(counts.sum(axis=1)), _logistic(held[:, 1:], held[:, 0]), share


def document_evidence(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column, fitted: tuple[Evidence, np.ndarray, float] | None) -> DataFrame:
    """``(id, host, path, evidence)`` of every row: log odds of its being good, without the share of good rows; a null text
    is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column(3)):
                n = len(offsets) - 1
                got = np.zeros(n)
                if fitted:
                    known, w, share = fitted
                    got = known.of(data, offsets) @ w[1:] + w[0] - np.log(share / (1 - share))
                yield pa.RecordBatch.from_arrays([*b.slice(at, n).columns[:3], pa.array(got, pa.float64())], names=["id", "host", "path", "evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"id {kind}, host string, path string, evidence double")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Documents that the prior counts for: by moments of the groups' shares about ``mean``, within 1 and 1000."""
    w = F.least(F.col("n"), F.lit(1000))
    spread = F.sum(w * (F.col("good") / F.col("n") - mean) ** 2) / F.sum(w)
    noise = F.sum(w * mean * (1 - mean) / F.col("n")) / F.sum(w)
    v, e, s = groups.where("n > 1").agg(spread, noise, F.avg(mean * (1 - mean))).first()
    if v is None or v <= (e or 0):
        return 1000.0
    return float(min(1000.0, max(1.0, s / (v - e) - 1)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """Posterior chance of good quality of every row.

    ``labels(doc_id, quality)`` may cover any part of the rows; a row counts as bad if any of its labels is 0. Returns
    ``(id, evidence, host_share, path_share, score, kept)``, one row per input row, ``kept`` being score >= threshold; the
    shares are those of the other rows. ``host`` defaults to ``source`` up to its first slash and ``path`` to ``source`` and
    ``lang``; nulls count as one empty host or path. A null text is the empty text, and texts of any length are read whole;
    null ids and repeated rows are scored like others; without labels of both kinds every row scores 0.5 and is kept; an empty
    table gives no rows; other columns are left out.
    """
    host = F.substring_index("source", "/", 1) if host is None else host
    path = F.concat_ws(" ", "source", "lang") if path is None else path
    empty = F.lit("")
    fitted = fit_evidence(docs, labels.select("doc_id", "quality"), id_col, text_col)
    prior = fitted[2] if fitted else 0.5
    scored = cut(document_evidence(docs, id_col, text_col, F.coalesce(host, empty), F.coalesce(path, empty), fitted).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(prior / (1 - prior))))))))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.count("*").alias("m"))
    hosts = cut(hosts)
    total, good, many = hosts.agg(F.sum("host_n"), F.sum("host_good"), F.sum("m")).first()
    mean = F.lit(float(good / total) if total else 0.5)
    of_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), mean)
    paths = with_facts(paths, hosts, "host", "m", many or 0)
    of_path = _strength(paths, (F.col("host_good") + of_host * mean) / (F.col("host_n") + of_host))
    # the row itself is left out of both
    host_share = (F.col("host_good") - F.col("p") + of_host * mean) / (F.col("host_n") - 1 + of_host)
    path_share = (F.col("good") - F.col("p") + of_path * F.col("host_share")) / (F.col("n") - 1 + of_path)
    share = F.least(F.greatest("path_share", F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(share / (1 - share)))))
    out = with_facts(scored, cut(paths.drop("m")), ["host", "path"], "n", total or 0).withColumn("host_share", host_share).withColumn("path_share", path_share)
    return out.select(F.col("id").alias(id_col), "evidence", "host_share", "path_share", score.alias("score")).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **named) -> DataFrame:
    """Rows of ``docs`` that are kept, all columns. A row goes if any row of its id is rejected; null ids stay."""
    bad = classify(docs, labels, id_col, **named).where("not kept").select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti")
