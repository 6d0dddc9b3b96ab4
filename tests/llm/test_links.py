"""Near duplicates, components, decontamination and quality against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import common, decontaminate, hnsw, ngram_join, quality


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys(spark, how):
    """Hot keys are joined by a broadcast, others by a merge, and the rows are those of a plain join."""
    keys = [1] * 50 + [2] * 3 + [3] + [None, None] + list(range(10, 40))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    facts = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (10, 1, "c"), (99, 1, "d")], "k long, n long, what string")
    got = common.with_facts(rows, facts, "k", "n", len(keys), how, least=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(facts, "k", how).collect()))
    assert common.with_facts(rows, facts.limit(0), "k", "n", len(keys), how, least=3).count() == (len(keys) if how == "left" else 0)


def test_hubs(spark, monkeypatch):
    """Nodes with very many edges are spread over tasks; components stay the same."""
    monkeypatch.setattr(common, "HUB_EDGES", 20)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(150)] + [(299, 650)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for e in real for x in e}, real)


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in (t or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
    ids = [i for i in sets if i is not None]
    edges = [(a, b) for a in ids for b in ids if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y)]
    return {i: max(map(len, s)) for i, s in sets.items()}, roots(ids, edges)


def copies(rng, n, length, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("trie_sets", [1500, 20])
def test_join_is_brute_force(spark, monkeypatch, trie_sets):
    """Small tries make the large group cross several, so that both ways of dealing blocks are held to the same result."""
    monkeypatch.setattr(ngram_join, "TRIE_SETS", trie_sets)
    rng = random.Random(trie_sets)
    texts = copies(rng, 90, 120, 8) + copies(rng, 12, 40, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} t{i} v{i} x{i}" for i in range(25)] + [f"{shared} " + " ".join(f"q{i}z{j}" for j in range(60)) for i in range(10)]
    texts += ["a b c", "A  b\tc", "a b", None, "", " \n", "Ä b c d e", "ä b c d e", "x " * 3000, "y", "y"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(3, texts[3]), (900, "one two three four five six"), (900, texts[5]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit(0)).withColumn("block", F.lit("b"))
    got = ngram_join.jaccard_components(df).collect()
    size, top = brute_join(rows)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: n for i, n in size.items() if i is not None}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == top
    assert len(got) == len(size) and [r.component_id for r in got if r.doc_id is None] == [None]


def test_rows_of_one_id_are_sets_of_their_own(spark):
    """A repeated row counts no n-gram twice, and two texts of an id aren't pooled into one set."""
    word = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    a, b = f"{word('s', 49)} {word('a', 55)}", f"{word('s', 49)} {word('b', 55)}"
    c, d = word("c", 104), word("d", 104)
    half = f"{word('c', 54)} {word('d', 54)}"
    rows = [(1, a), (1, a), (2, b), (2, b), (11, c), (11, d), (12, half), (13, c), (14, d + " x"), (20, a + " y"), (20, word("z", 30)), (21, word("z", 30) + " u")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size, top = brute_join(rows)
    assert got == {i: (size[i], top[i]) for i in top}
    assert got[2][1] == 2 and got[12][1] == 12 and got[14][1] == 11 and got[21][1] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_repeated_ids(spark, monkeypatch, seed):
    """Random texts, copies and near copies dealt over few ids, in small tries and parts."""
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 12)
    monkeypatch.setattr(ngram_join, "ASKING_SETS", 10)
    rng = random.Random(seed)
    texts = [t for _ in range(8) for t in copies(rng, 12, 60, 7)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    shared = " ".join(f"s{i}" for i in range(50))
    texts += [f"{shared} " + " ".join(f"q{i}z{j}" for j in range(rng.randrange(1, 20))) for i in range(40)]
    rows = [(rng.randrange(150), rng.choice(texts)) for _ in range(260)] + [(rng.randrange(150), t) for t in texts[:60]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size, top = brute_join(rows)
    assert got == {i: (size[i], top[i]) for i in top}


def test_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16))
    group = base[0] + 0.05 * rng.normal(size=(150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, group]))]
    rows += [(1000 + i, base[1].tolist()) for i in range(5)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0]), (2005, []), (2006, (3 * base[2]).tolist()), (None, base[3].tolist()), (7, base[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = hnsw.near_duplicates(df).collect()
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = list(fine)
    u = hnsw.unit([fine[i] for i in ids])
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(u @ u.T >= 0.95)) if a != b]
    n = defaultdict(int)
    for a, _ in pairs:
        n[a] += 1
    every = {i for i, _ in rows if i is not None}
    assert {r.vec_id: r.n_links for r in got if r.vec_id is not None} == {i: n[i] for i in every}
    assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == roots(every, pairs)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got) and len(got) == len(every) + 1
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    """Random vectors with one near copy each are the hard case; the audit widens the beam until links are found."""
    rng = np.random.default_rng(5)
    held = hnsw.unit(rng.normal(size=(3000, 64)))
    q = hnsw.unit(held + 0.02 * rng.normal(size=held.shape))
    graph = hnsw.Graph.load(hnsw.Graph(held).dump(), held)
    r, c, told = hnsw.linked(graph, held, q, 0.95)
    found, true = set(zip(r.tolist(), c.tolist())), set(zip(*map(np.ndarray.tolist, np.nonzero(q @ held.T >= 0.95))))
    assert found <= true and len(found) >= 0.99 * len(true)
    assert told["probes"] == hnsw.PROBES and told["links"] > 0 and told["probes_found"] >= 0.995 * told["probes"]


@pytest.mark.parametrize("d", [16, 64, 384])
def test_links_at_the_threshold(d):
    """Pairs whose cosine is just over or under the threshold; queries that are vectors of the shard aren't their own links."""
    rng = np.random.default_rng(d)
    base = hnsw.unit(rng.normal(size=(1500, d)))
    at, over = hnsw._probes(base, 0.95, rng)
    _, under = hnsw._probes(base[at], 0.9497, rng)
    held = np.vstack([base, over, under])
    r, c, told = hnsw.linked(hnsw.Graph(held), held, held, 0.95, np.arange(len(held)))
    true = held @ held.T >= 0.95
    np.fill_diagonal(true, False)
    found = np.zeros_like(true)
    found[r, c] = True
    assert not (found & ~true).any() and true.sum() >= 2 * hnsw.PROBES
    assert (found & true).sum() >= 0.995 * true.sum() and told["links_found"] >= 0.995 * told["links"]


def test_lengths_and_sizes_of_vectors(spark):
    """Vectors of rare lengths link among themselves; the largest and smallest doubles do as well."""
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(40)]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [2.0, 4.0, 6.0]), (102, [3.0, -1.0, 0.0]), (110, [5.0]), (111, [0.5]), (112, [-1.0])]
    rows += [(200, [1e308, 1e308, 0.0, 0.0]), (201, [1e-300, 1e-300, 0.0, 0.0]), (202, [0.0, 0.0, 1e308, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (100, 101, 102, 110, 111, 112, 200, 201, 202)] == [(1, 100), (1, 100), (0, 102), (1, 110), (1, 110), (0, 112), (1, 200), (1, 200), (0, 202)]
    assert all(got[i] == (0, i) for i in range(40))
    audit = hnsw.recall_audit(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.d for r in audit} == {1, 3, 4, 8} and all(r.probes_found >= 0.995 * r.probes for r in audit)


def test_vectors_in_pieces(spark, monkeypatch):
    """Shards, query parts and pieces of graphs follow bytes, so that a task's memory doesn't follow the table's."""
    for name, size in (("SHARD_BYTES", 32 << 10), ("PART_BYTES", (1 << 10, 64 << 10)), ("PIECE_BYTES", 1 << 10), ("BLOCK_BYTES", 16 << 10)):
        monkeypatch.setattr(hnsw, name, size, raising=False)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(500, 64)).astype(np.float32)
    v = np.vstack([base, base[:80] + 0.05 * rng.normal(size=(80, 64)).astype(np.float32), base[0] + 0.02 * rng.normal(size=(40, 64)).astype(np.float32)])
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")
        pairs = list(hnsw.brute_links(v))
        got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()}
        low = roots(range(len(v)), pairs)
        n = np.bincount([a for a, _ in pairs], minlength=len(v))
        assert got == {i: (n[i], low[i]) for i in range(len(v))}
        audit = hnsw.recall_audit(df).collect()
        tasks = {(r.shard, r.part) for r in audit}
        assert len(audit) == len(tasks) >= 8 * 5 and {s for s, _ in tasks} >= set(range(9))


def test_links_of_one_group_are_not_held_at_once():
    """Vectors that are all linked have as many links as pairs; a task counts them, and a batch that links to one vector is no block."""
    import tracemalloc

    rng = np.random.default_rng(4)
    near = hnsw.unit(rng.normal(size=128) + 0.01 * rng.normal(size=(3000, 128)))
    graph, own = hnsw.Graph(near), np.arange(len(near))
    pairs, most = 0, 0
    tracemalloc.start()
    for r, _ in hnsw.links(graph, near, near, 0.95, own, hnsw.audited(graph, near, near, 0.95, own)["beam"]):
        pairs += len(r)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    rows = np.arange(1, 3000)
    table = graph.out[0]
    table[:] = -1
    before = tracemalloc.get_traced_memory()[0]
    graph._link(rows, np.where(rows[:, None] % 2 == 0, [[0, 2999]], [[0, 1]]), np.ones((len(rows), 2)), 0)
    linked = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert pairs == 3000 * 2999 and most < 120 << 20 and linked < 120 << 20  # the pairs alone were 144 MB


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    items = [(i, "Question " + " ".join(rng.sample(words, 12)) + "? Answer " + " ".join(rng.sample(words, n)) + ".") for i, n in enumerate((1, 3, 6, 20, 90))] + [(50, "tiny item"), (51, None), (52, "")]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, noise(rng.randrange(300)) + "\n" + t.upper().replace(" ", "  ") + "\n" + noise(40)) for i, t in items[:5]]
    docs += [(100 + i, noise(500)) for i in range(20)] + [(200, items[3][1][: len(items[3][1]) // 3]), (201, None), (202, ""), (203, "a tiny item here"), (None, items[1][1]), (204, items[0][1] * 2), (204, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()), key=str)
    assert got == sorted([(i, i) for i in range(5)] + [(203, 50), (None, 1), (204, 0)], key=str)
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([100 + i for i in range(20)] + [200, 201, 202, None], key=str)
    assert decontaminate.overlaps(d.limit(0), b).count() == 0 and decontaminate.overlaps(d, b.limit(0)).count() == 0


def brute_overlaps(docs, items, share=75):
    """Every item against every text: the share of the shingles of question and of answer that the text holds."""
    import re

    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    for i, t in items:
        parts = [words(x) for x in decontaminate.question_and_answer(t or "")]
        for d, text in docs:
            own, good = words(text), any(parts)
            for p in filter(None, parts):
                k = min(5, len(p))
                want, have = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (p, own))
                good &= 100 * len(want & have) >= share * len(want)
            if good:
                out.add((d, i))
    return out


def test_decontamination_is_brute_force(spark):
    """Whole items, parts of them, edits, question and answer far from each other, either alone, very long texts, and ties."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    some = lambda n: rng.sample(words, n)
    items = [(i, f"{' '.join(some(rng.randrange(8, 60)))}? {' '.join(some(rng.choice((1, 3, 12, 24))))}.") for i in range(60)] + [(60, f"{' '.join(some(14))}"), (61, f"{' '.join(some(24))}? {' '.join(some(24))}.")]
    docs, noise = [], lambda n: " ".join(rng.choice(words) for _ in range(n))
    for n, (i, t) in enumerate(items * 3):
        q, a = decontaminate.question_and_answer(t)
        edited = " ".join(w if rng.random() > 0.04 else "zz" for w in t.split())
        body = [t, edited, f"{q} {noise(120)} {a}", q, a, t[: len(t) * 3 // 4]][rng.randrange(6)]
        docs.append((n, f"{noise(rng.randrange(80))} {body} {noise(rng.randrange(80))}"))
    tie = " ".join(some(12))  # eight shingles; six of them are 75 of a hundred
    items.append((62, tie))
    docs += [(900, " ".join(tie.split()[:10])), (901, " ".join(tie.split()[:9])), (902, f"{noise(60_000)} {items[61][1]} {noise(60_000)}"), (903, None)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_overlaps(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and (900, 62) in want and (901, 62) not in want and (902, 61) in want


def test_blocks_are_skipped():
    """Fewer postings are read than the asked passages have, and the scores are those of all postings."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(640)]
    index = decontaminate.ItemIndex(items)
    text = " ".join(rng.choice(words) for _ in range(4000)) + " " + items[77][1]
    n = decontaminate.numbers_of([text])[0]
    got = index.search(n, np.array([0, len(n)]), 0.5)
    terms, best = index.term_of(n), {}
    for at in range(0, len(n), decontaminate.CELL_WORDS):
        score = np.zeros(len(index.item))
        for t in set(terms[at : at + 2 * decontaminate.CELL_WORDS].tolist()) - {len(index.terms)}:
            for p in range(index.start[t, 0], index.start[t, -1]):
                score[index.part[p]] += index.score[p]
        for p in np.flatnonzero(score >= 0.5):
            best[0, int(index.item[p])] = max(score[p], best.get((0, int(index.item[p])), 0))
    assert got.keys() == best.keys() and got and all(abs(got[k] - best[k]) < 1e-9 for k in got)
    assert 0 < index.read < index.held / 10


def test_decontamination_in_passes(spark, monkeypatch, data):
    docs, items = (spark.read.parquet(f"{data}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontaminate.overlaps(docs, items).select("doc_id", "item_id", "question_found").collect()))
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 7)
    assert one == sorted(map(tuple, decontaminate.overlaps(docs, items).select("doc_id", "item_id", "question_found").collect()))
    assert one


def test_quality_on_held_out_labels(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{data}/sf0.01/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r for r in quality.classify(docs, fit).collect()}
    assert len(got) == docs.count()
    good = [got[i].kept for i, q in held.items() if q == 1]
    bad = [got[i].kept for i, q in held.items() if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2


def test_quality_edges(spark):
    rows = [(i, "Plain words make up this text. " * 5, "a/x", "en") for i in range(30)] + [(100 + i, "LOUD!! NOISE!! " * 9, "b", "en") for i in range(30)]
    rows += [(None, None, None, None), (500, "", "a/y", None), (100, "LOUD!! NOISE!! " * 9, "b", "en"), (600, "LOUD!! " * 30, "rare", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)] + [(5, None), (None, 0), (100, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(30)) and not any(by[100 + i].kept for i in range(30)) and not by[600].kept
    assert by[5].host_share > by[600].host_share > by[110].host_share
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, *range(30)}
    assert all(r.kept for r in quality.classify(docs, labels.limit(0)).collect()) and quality.classify(docs.limit(0), labels).count() == 0


def test_posterior_is_brute_force(spark):
    """Shares of host and path, each without the row itself, by plain sums."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("fine", "plain", "good") if i % 3 else ("spam", "win", "cash")) for _ in range(30)), f"h{rng.randrange(12)}/{rng.randrange(3)}", rng.choice(("en", None))) for i in range(400)]
    rows += [(900, None, "alone", "en"), (901, "word " * 200_000, "h1/0", "en"), (901, "word " * 200_000, "h1/0", "en"), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.evidence, r.host_share, r.path_share, r.score) for r in quality.classify(docs, labels).collect())
    known = {i: q for i, q in labels.collect()}
    odds = np.log(np.mean(list(known.values())) / (1 - np.mean(list(known.values()))))
    place = sorted((-1 if i is None else i, (s or "").split("/")[0], " ".join(x for x in (s, g) if x is not None)) for i, _, s, g in rows)
    p = [1 / (1 + np.exp(-(e + odds))) for _, e, *_ in got]
    by_host, by_path = defaultdict(list), defaultdict(list)
    for (_, h, q), x in zip(place, p):
        by_host[h].append(x)
        by_path[h, q].append(x)
    mean = np.mean(p)

    def strength(groups):
        groups = [(len(g), sum(g), m) for g, m in groups if len(g) > 1]
        w = sum(n for n, _, _ in groups)
        spread, noise = sum(n * (s / n - m) ** 2 for n, s, m in groups) / w, sum(m * (1 - m) for _, _, m in groups) / w
        return 1000.0 if spread <= noise else min(1000.0, max(1.0, np.mean([m * (1 - m) for _, _, m in groups]) / (spread - noise) - 1))

    a = strength([(g, mean) for g in by_host.values()])
    b = strength([(g, (sum(by_host[h]) + a * mean) / (len(by_host[h]) + a)) for (h, _), g in by_path.items()])
    for (_, e, hs, ps, score), (_, h, q), x in zip(got, place, p):
        want_host = (sum(by_host[h]) - x + a * mean) / (len(by_host[h]) - 1 + a)
        want_path = (sum(by_path[h, q]) - x + b * want_host) / (len(by_path[h, q]) - 1 + b)
        assert abs(hs - want_host) < 1e-9 and abs(ps - want_path) < 1e-9
        assert abs(score - 1 / (1 + np.exp(-e) * (1 - want_path) / want_path)) < 1e-9


def test_evidence_of_words():
    """Log-likelihood ratios of words are those of plain counts, and weights grow with what evidence tells."""
    texts, good = [b"a b c", b"a b", b"x y", b"x b", b"x"], np.array([1, 1, 0, 0, 0])
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    row, slot = quality._slots(data, offsets)
    counts = np.zeros((2, quality.SLOTS))
    np.add.at(counts, (good[row], slot), 1)
    known = quality.Evidence(np.ones((2, len(quality.FEATURES), 10)), counts, np.array([3, 2]))
    s = quality.SMOOTH
    ratio = lambda n1, n0: np.log((n1 + s * (n1 + n0 + 1) / 7) / (2 + s) / ((n0 + s * (n1 + n0 + 1) / 7) / (3 + s)))
    assert abs(known.of(data, offsets)[1, 1] - (ratio(2, 0) + ratio(2, 1)) / np.sqrt(2)) < 1e-12
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    w = quality._logistic(x, (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))).astype(float))
    assert abs(w[0] - 0.5) < 0.2 and abs(w[1] - 2) < 0.3 and w[2] < 0.2
