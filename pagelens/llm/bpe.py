"""Byte-level BPE: encoding to token ids with offsets, and decoding, over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import tidy

#: Pieces whose ids a task keeps; others are encoded again in each run of texts.
KEPT_PIECES = 400_000
#: Characters of text worked on at a time, so that lists of pieces stay small; a longer text is taken in parts.
RUN_CHARS = 2_000_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each longer token: what is left when its bytes are merged by the lower ranks only."""
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            low, i = min(found)
            if low >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


class ByteBpe:
    """A rank file as a tokenizer of the tokenizers library; ids and decoding follow the ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Tokenizer, models

        ranks = read_ranks(ranks_path)
        self.char = byte_characters()
        self.byte_of = {c: i for i, c in enumerate(self.char)}
        self.as_chars = bytes(range(256)).decode("latin-1").maketrans(dict(enumerate(self.char)))
        vocab = {self._chars(t): i for t, i in ranks.items()}
        merges = [(self._chars(a), self._chars(b)) for a, b in merges_of(ranks)]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        # from ids back to bytes through the byte table alone
        shown = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.token_bytes = {i: bytes(self.byte_of[c] for c in t) for i, t in shown.items()}
        self.token_sizes = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, t in self.token_bytes.items():
            self.token_sizes[i] = len(t)
        self.pieces = regex.compile(white_space(pattern), regex.V1)
        self.known: dict[str, bytes] = {}

    def _chars(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.as_chars)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        merge = self.tokenizer.model.tokenize  # the pattern has split already; each piece is merged by itself
        return {p: np.array([x.id for x in merge(self._chars(p.encode()))], "<u4").tobytes() for p in new}

    def split(self, text: str) -> list[str]:
        return self.pieces.findall(text)

    def encode_runs(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= RUN_CHARS):
                size += len(texts[to])
                to += 1
            split = [self.split(t) for t in texts[at:to]]
            fresh = self._learn([p for p in set().union(*split) if p not in self.known])
            if len(self.known) + len(fresh) <= KEPT_PIECES:
                self.known.update(fresh)
                look = self.known.__getitem__
            else:
                look = lambda p, fresh=fresh: self.known.get(p) or fresh[p]
            for pieces in split:
                yield b"".join(map(look, pieces))
            at = to

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; a character split between tokens is whole again, since bytes are joined before decoding."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """For each id the characters of ``text`` that its bytes touch, end exclusive; parts of a split character
        all give that character."""
        return list(map(tuple, self.offset_array(text.encode(), ids).tolist()))

    def offset_array(self, raw: bytes, ids: np.ndarray) -> np.ndarray:
        """Starts and ends of :meth:`offsets` as rows of 32-bit integers."""
        number = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.token_sizes[ids], dtype=np.int64)
        starts = ends - self.token_sizes[ids]
        return np.column_stack([number[starts], number[ends - 1] + 1]).astype("<i4").reshape(-1, 2)


def white_space(pattern: str) -> str:
    """``pattern`` with \\s as the Unicode property White_Space, as the Rust engines read it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


@lru_cache(maxsize=2)
def tokenizer_for(ranks_path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Returns ``(id_col, ids array<int>[, offsets array<struct<start,end>>])``, one row per input row; other columns are
    left out, so their names cannot clash. A null text is the empty text and has no ids; a null id stays null; repeated
    rows are each encoded; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", offsets array<struct<start:int,end:int>>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(ranks_path, pattern)
        t.known = {}
        for b in batches:
            for rows in _row_runs(b):
                texts = [x or "" for x in rows.column(1).to_pylist()]
                ids = [np.frombuffer(x, "<u4") for x in t.encode_runs(texts)]
                cols = [rows.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if offsets:
                    spans = [[{"start": a, "end": z} for a, z in t.offsets(s, x)] for s, x in zip(texts, ids)]
                    cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "offsets"][: len(cols)])
        t.known = {}

    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes and text of token ids: ``(id_col, decoded binary, text string)``; null ids give empty bytes, bytes that are
    not UTF-8 (ids cut inside a character) give U+FFFD in the text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(ranks_path, pattern)
        for b in batches:
            raw = [t.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            text = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), text], names=[id_col, "decoded", "text"])

    return df.select(id_col, ids_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, decoded binary, text string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, keep: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again, in one pass, keeping digests instead of ids.

    Returns ``(id_col, n_tokens, ids_sha256, decoded_sha256[, offsets_sha256])``; nulls, repeats and empty tables as in
    :func:`encode`. ``offsets_sha256`` is the digest of the characters that each id touches, start and end as little-endian
    32-bit integers. With ``keep`` all columns of ``df`` stay, save such as have one of these names.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["offsets_sha256"] * offsets]
    own = [c for c in df.columns if c not in names] if keep else [id_col]
    sent = own if keep else [*own, F.col(text_col).alias("__text")]
    at = own.index(text_col) if keep else 1  # the text is sent once
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own] + ["n_tokens long"] + [f"{c} string" for c in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(ranks_path, pattern)
        t.known = {}
        for b in batches:
            for rows in _row_runs(b):
                texts = [x or "" for x in rows.column(at).to_pylist()]
                cols: list[list] = [[] for _ in names]
                for text, raw in zip(texts, t.encode_runs(texts)):
                    ids = np.frombuffer(raw, "<u4")
                    back = t.decode(ids)
                    digests = [raw, back, *[t.offset_array(text.encode(), ids).tobytes()] * offsets]
                    for c, x in zip(cols, [len(ids), *(hashlib.sha256(x).hexdigest() for x in digests)]):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(own)], pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=[*own, *names])
        t.known = {}

    return df.select(*sent).mapInArrow(tidy(run), schema)


def _row_runs(batch: pa.RecordBatch, most: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
