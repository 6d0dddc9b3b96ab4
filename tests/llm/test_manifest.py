"""Manifests against a plain tree in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagelens.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The top of a run of nodes and each one's ``(left, right)`` by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a - a % 8
            paths[i].append(("".join(nodes[lo:a]), "".join(nodes[a + 1 : lo + 8])))
        nodes, at = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [a // 8 for a in at]
    return nodes[0], paths


def brute(rows):
    """``rows`` of (id, lang, leaf): by row the subroot, the root and the path."""
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in langs:
        order = sorted((i for i, r in enumerate(rows) if r[1] == lang), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2]))
        inner[lang] = (*climb([rows[i][2] for i in order]), order)
    root, above = climb([inner[x][0] for x in langs])
    out = {}
    for k, lang in enumerate(langs):
        top, paths, order = inner[lang]
        for i, p in zip(order, paths):
            out[i] = (top, root, p + above[k])
    return out


def compare(spark, rows):
    leaves = [(*r, plain_leaf(r)) for r in rows]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(leaves)], "nth int, doc_id long, lang string, leaf string").withColumn("h", F.lit(1)).withColumn("path", F.lit("x"))
    got = manifest.verify(manifest.prove(df)).collect()
    want = brute(leaves)
    assert len(got) == len(rows)
    for r in got:
        path = [(p.left, p.right) for p in r.path]
        if rows.count(rows[r.nth]) == 1:
            assert (r.subroot, r.root, path) == want[r.nth]
        assert r.root == want[r.nth][1] and r.folded_root == r.root and r.verified and r.h == 1
    # equal rows take each other's places
    assert sorted((r.leaf, str([(p.left, p.right) for p in r.path])) for r in got) == sorted((leaves[i][2], str(w[2])) for i, w in want.items())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 130])
def test_one_group(spark, n):
    compare(spark, [(i * 7, "en") for i in range(n)])


def test_groups_ties_and_nulls(spark):
    rows = [(i, lang) for lang, n in ((None, 9), ("", 1), ("de", 70), ("en", 3), ("é", 17), ("z", 8), ("a", 2), ("b", 1), ("c", 1), ("d", 1)) for i in range(n)]
    rows += [(None, "de"), (None, None), *[(5, "de")] * 20, (6, "de")]
    compare(spark, rows)


def test_windows_of_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(manifest, "WINDOW_NODES", 16)
    compare(spark, [(i, "en") for i in range(700)] + [(i, "de") for i in range(33)])


def test_leaf_fold_and_tampering(spark):
    rows = [(i, None if i % 4 == 0 else f"s{i}", "en" if i % 3 else None, None if i % 5 == 0 else i * 10, None if i == 7 else "" if i == 8 else f"Ünï Text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    cols = [F.col(c) for c in df.columns]
    changed = manifest.leaf(*cols[:4], F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text")))
    got = manifest.verify(manifest.prove(df.select("doc_id", "lang", manifest.leaf(*cols).alias("leaf"), changed.alias("other"))), "other").withColumn("proof", manifest.siblings(F.col("path"))).collect()
    for r in got:
        assert r.leaf == plain_leaf(rows[r.doc_id])
        assert r.verified == (r.doc_id % 2 == 1 or not rows[r.doc_id][4])
        assert r.proof == H("".join(p.left + p.right for p in r.path))
        h = r.other
        for p in r.path:
            h = H(p.left, h, p.right)
        assert h == r.folded_root


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert manifest.prove(none).count() == 0
