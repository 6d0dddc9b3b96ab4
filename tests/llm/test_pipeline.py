"""Stages of the corpus pipeline, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import pii
from tests.llm.test_links import brute_join
from tests.llm.test_pii import brute


def test_stages(spark, data):
    d = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], d).cache())
    assert [x.columns for x in kept[:-1]] == [docs.columns] * 5
    rows = [{r.doc_id: r for r in x.collect()} for x in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert gone and sum(labels.get(i) == 1 for i in gone) <= 1
    _, top = brute_join([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, t in top.items() if i == t}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, r in rows[2].items() if not any(t in " ".join(r.text.lower().split()) for t in items)}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert brute(r.text) == "" and r.n_chars == len(r.text)
        assert brute(rows[3][i].text) or r.text == rows[3][i].text or "[TERM]" in r.text
    assert set(rows[5]) == set(rows[4])
    # the joined run gives the rows of the stages one after the other, with the cleaned texts
    ran = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert ran == rows[5] and {i: r.text for i, r in ran.items()} == {i: r.text for i, r in rows[4].items()}
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_stages_on_odd_rows(spark, data):
    """Nulls, empty and very long texts, repeated rows, other columns with clashing names, and no rows at all."""
    d = f"{data}/sf0.001"
    clean = "The river runs past the old mill, and the miller counts his sacks before the evening comes. " * 3
    rows = [(None, None), (None, clean), (1, clean), (1, clean), (2, clean), (3, ""), (4, None), (5, "word " * 100_000), (6, "mail me@x.org or +49 30 1234567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "spans", "score", "kept", "component_id", "n_tokens", "block", "p"):
        docs = docs.withColumn(c, F.lit("x" if c != "p" else None))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, d), stage(spark, docs.limit(0), d)
        assert none.count() == 0 and set(docs.columns) <= set(out.columns), name
        kept = [(r.doc_id, r.text) for r in out.collect()]
        if name == "n-gram Jaccard join":
            assert sorted(kept, key=str) == sorted([x for x in rows if x != (2, clean)], key=str)
        elif name == "PII":
            assert (6, "mail [EMAIL] or [PHONE]") in kept and len(kept) == len(rows)
        elif name != "quality classifier":
            assert sorted(kept, key=str) == sorted(rows, key=str), name
