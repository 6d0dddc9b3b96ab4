"""Packed sequences against the tokenizer itself and the laws of packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelens.llm import packing

PATH = P.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "It's (we'll) 'S x²½Ⅷ é É ̈ a\x1cb\x85c d\xa0e don'T 123", "<|endoftext|> a<|startoftext|>b <| c|>", "İSTANBUL ΣΑΣ Σ ſt Å 漢字😀👍🏽", "a\x00b \x7f\x01 c", "A" * 3000, "à ̀b",
    "a ß ÀÉ×÷ª µ º straße’s l'été ©", "w ".join(map(str, range(9000))), "x " * 2047, "x " * 2048, "same", "same",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def laws(rows, most):
    """Sequences without gaps and within ``most``; only longer documents are cut."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        assert r.length <= most and r.start == r.piece * most
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(held)


def test_pieces_hold_the_ids_of_the_tokenizer(spark, whole):
    docs = spark.createDataFrame([(None if i == 5 else i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    rows = packing.pack_documents(docs, PATH).collect()
    laws(rows, packing.SEQUENCE)
    want = {}
    for i, t in enumerate(ODD):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[(None if i == 5 else i, k // 2048)] = (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_sequences(spark, whole):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    full = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(ODD)}
    got = packing.sequences(docs, PATH, most=100).collect()
    seen = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 100
        for p in r.parts:
            assert ids[p.offset : p.offset + p.length] == full[p.doc_id][100 * p.piece : 100 * p.piece + p.length]
            seen += p.length
    assert seen == sum(map(len, full.values()))


def test_long_texts_are_encoded_whole(whole, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 50)
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    ids = packing.WordIds(PATH)
    for t in filter(None, ODD):
        assert np.frombuffer(ids.encode([t.encode()])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("size", ["sf0.001"])
def test_documents(spark, data, size):
    rows = packing.pack_documents(spark.read.parquet(f"{data}/{size}/documents.parquet"), PATH).collect()
    assert laws(rows, packing.SEQUENCE) <= -(-sum(r.length for r in rows) // packing.SEQUENCE) + 1


def test_many_blocks(spark, monkeypatch):
    """Several blocks and levels: every row placed once, near the least number of sequences."""
    monkeypatch.setattr(packing, "BLOCK_PIECES", 300)
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 2049, 2500), rng.integers(1, 100, 1500), np.full(300, 2048)]).tolist()
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "n long, length long")
    got = packing.pack(rows).join(rows, "n").withColumnRenamed("n", "piece").withColumn("start", F.col("piece") * 2048).collect()
    assert sorted(r.piece for r in got) == list(range(len(lengths)))
    assert laws(got, 2048) <= 1.01 * sum(lengths) / 2048  # blocks as small as here lose some


def test_lengths_that_fit_with_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 50)
    rows = spark.range(400).select(F.col("id").alias("n"), F.lit(1500).cast("long").alias("length"))
    got = packing.pack(rows).collect()
    assert len({r.sequence_id for r in got}) == 400 == len(got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(0, 9))
def test_children_are_whole_solutions(lengths, seed):
    p = packing.Population(np.array(lengths), 64, seed)
    p.found()
    first = p.solutions[0][0]
    for _, a in list(p.solutions):
        for _, b in list(p.solutions):
            child = p.cross(a, b)
            fills = p.fills(child)
            assert fills.min() > 0 and fills.max() <= 64 and fills.sum() == sum(lengths)
    p.evolve()
    assert p.solutions[0][0] <= first and p.solutions[0][0][0] >= p.least


def test_breeding_betters_best_fit():
    p = packing.Population(np.random.default_rng(0).integers(300, 1100, 2000), 2048, 1)
    p.found()
    first = p.solutions[0][0][0]
    p.evolve()
    assert p.solutions[0][0][0] < first


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0 and packing.sequences(none, PATH).count() == 0
