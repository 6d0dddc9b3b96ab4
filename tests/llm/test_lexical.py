"""Rankings and shared sums against plain scoring."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, -(2**63) if d is None else d))
        out += [(i, k + 1, None if d == -(2**63) else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


DOCS = [
    (1, "the Cat sat on the mat"), (2, "a cat, a CAT; a-cat the"), (3, None), (4, ""), (5, "..."), (None, "the mat"), (None, "the dog"), (6, "ÉTÉ été Été x²"), (7, "the cat sat on the mat"), (7, "the mat"),
    (8, "mat " * 30_000 + "cat"), (9, "[cat]_{mat}@`dog~"), (10, "cat\x7fmat\x80dog"), (11, "0 9 a z A Z"),
]
ITEMS = [(1, "the cat"), (2, "cat mat dog"), (3, "the cat sat"), (None, "dog the"), (4, None), (5, "nowhere"), (1, "the mat"), (6, "été z 9"), (7, "cat mat the sat on"), (8, ""), (9, "mat cat the"), (10, "the")]


@pytest.mark.parametrize("top,per_pass", [(50, 100_000), (2, 100_000), (3, 4)])
def test_ranking(spark, monkeypatch, top, per_pass):
    monkeypatch.setattr(lexical, "PASS_TERMS", per_pass)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit("x")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit(1))
    got = sorted(map(tuple, lexical.search(docs, items, top).collect()), key=str)
    assert got == brute(DOCS, ITEMS, top)


def test_ties_at_the_last_place(spark):
    docs = [(i, "word of it" if i % 3 else "word") for i in range(3000, 0, -1)] + [(i, "other") for i in range(5000, 9000)]
    items = [(k, "word") for k in range(3)] + [(9, "word it")]
    got = sorted(map(tuple, lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 7).collect()), key=str)
    assert got == brute(docs, items, 7)


def test_documents(spark, data):
    docs, items = (spark.read.parquet(f"{data}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, lexical.search(docs, items).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 50)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.sets(st.integers(-20, 20), max_size=15), max_size=12), st.integers(0, 99))
def test_shared_sums_are_those_of_the_items(items, seed):
    sharing = lexical.Sharing(items)
    table = np.zeros((sharing.nodes, 4), np.int64)
    table[: len(sharing.terms)] = np.random.default_rng(seed).integers(0, 10**9, (len(sharing.terms), 4))
    by_term = dict(zip(sharing.terms.tolist(), table.copy()))
    asked = [k for k, i in enumerate(sharing.items) if items[i]]
    got = sharing.add_up(table) if sharing.nodes else []
    for k in asked:
        assert got[k].tolist() == sum(by_term[t] for t in items[sharing.items[k]]).tolist()


def test_sharing_saves_sums():
    rng = np.random.default_rng(3)
    items = {k: set(rng.zipf(1.3, 60).clip(0, 5000).tolist()) for k in range(150)}
    sharing = lexical.Sharing(items)
    assert len(sharing.left) < 0.75 * sum(len(t) - 1 for t in items.values())


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(spark.createDataFrame(DOCS, "doc_id long, text string"), items.where("text is null")).count() == 0
