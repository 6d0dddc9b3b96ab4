"""Base spans against Python's patterns, and terms that disclose an entity."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagelens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    worth = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(w - 9 if w > 9 else w for w in worth) % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


HARD = [
    None, "", "a@b.co_x@d.com", "%%a.b@c.d.e..f@g-h.ij.", "x@y", "é😀 me@b.de 😀 1.2.3.4.5.6.7.8", "1.2.3.256 01.002.0003.4 255.255.255.255 0.0.0.0", "4111 1111 1111 1111",
    "4111-1111-1111-1111 4111  1111", "x4111111111111111x", "1 4111 1111 1111 1111", "+1 (736) 555-2678, +49 30 123456 7 +1+2 +123456789012345678", "12-34 56", "a@b.c" * 50, "+1 4111 1111 1111 1111",
    "1" * 60_000, "7 " * 60_000, "a" * 60_000 + "@b" + ".c" * 60_000, "1." * 60_000, "+" + "1 " * 30_000, "12 3.4", "me@xy.de", "\n".join(["a.b@c.de 10.0.0.1"] * 300), "0" * 16, "1.2.3.4@5.6.7.8",
    "999999999999999999999.1.1.1", "a@b-.c-d.e-", "@.@a@b.c@d.e",
]


def test_base_spans_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(HARD):
        want = brute(t)  # slow on long runs
        assert got[i].spans == want, (t or "")[:40]
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[i].n_email == want.count("email"), t


@pytest.mark.parametrize("size", ["sf0.001"])
def test_documents(spark, data, size):
    docs = spark.read.parquet(f"{data}/{size}/documents.parquet")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert ",".join(x for x in got[r.doc_id].spans.split(",") if not x.startswith("term")) == brute(r.text)


def test_disclosing_term(spark):
    rows = [(i, f"plain number {i} words stand here and more of them") for i in range(60)]
    rows += [(100, "ask Zanzibar keeper me@x.org today"), (101, "the keeper was seen by Zanzibar, me@x.org said"), (102, "keeper of words")]
    rows += [(200 + i, "copy with Quokka at you@y.org") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [got[i].n_term > 0 for i in (100, 101, 102, 200, 5)] == [True, True, False, False, False]
    assert got[100].spans == "email:20:28,term:4:12,term:13:19"
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[100] == "ask [TERM] [TERM] [EMAIL] today" and clean[5] == rows[5][1] and clean[200] == "copy with Quokka at [EMAIL]"


WORD = re.compile(r"[^\W_]+")


def disclosed(texts):
    """By text the terms that give one of its entities away, from the definition alone."""
    rows = []
    for t in texts:
        entities = {m[0].lower() for m in EMAIL.finditer(t)}
        words = [w.lower() for w in WORD.findall(EMAIL.sub(lambda m: " " * len(m[0]), t))]
        rows.append((t, entities, words, set(words)))
    with_term, with_entity = Counter(w for r in rows for w in r[3]), Counter(e for r in rows for e in r[1])
    together, places = Counter(), defaultdict(set)
    for _, entities, words, own in rows:
        around = defaultdict(set)
        for i, w in enumerate(words):
            around[w].add((words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None))
        for e in entities:
            for w in own:
                together[e, w] += 1
                places[e, w] |= around[w]
    said = {p for p, n in together.items() if 2 * n >= with_term[p[1]] and math.log2(n / with_term[p[1]] * len(texts) / with_entity[p[0]]) >= 4 and len(places[p]) > 1}
    return {t: {w for e in entities for w in own if (e, w) in said} for t, entities, _, own in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_by_the_definition(spark, seed):
    """Random texts with shared and own entities and terms, copies, and a text with many of both."""
    rng = random.Random(seed)
    texts = [" ".join(f"plain{rng.randrange(40)}" for _ in range(12)) for _ in range(150)]
    for k in range(40):
        words = [rng.choice([f"plain{rng.randrange(40)}", f"rare{rng.randrange(25)}", f"own{k}", f"e{rng.randrange(12)}@x.org", f"only{k}@y.org"]) for _ in range(rng.randrange(4, 20))]
        texts += [" ".join(words)] * rng.choice([1, 1, 1, 3])
    texts.append(" ".join(f"hub{i % 60} rare{i % 25} hub{i * 7 % 60} h{i}@z.org" for i in range(120)))
    want = disclosed(texts)
    assert sum(map(len, want.values())) > 60
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        t = texts[r.doc_id]
        marks = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")]
        assert {t[s:e].lower() for s, e in marks} == want[t]


def test_dense_texts_take_linear_time(spark):
    """Tens of thousands of addresses in one text, and hundreds of entities beside hundreds of terms."""
    n = 40_000
    text = " ".join(f"u{i}@h{i}.org w{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find(docs).first().n_email == n
    assert pii.sanitise(docs).first().text == " ".join(f"[EMAIL] w{i}" for i in range(n))
    texts = [" ".join(f"t{i} t{i * 3 % 500} e{i}@x.org" for i in range(500)), *["plain words"] * 40]
    base = pii.find_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = pii.disclosing_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii._texts(base), len(texts))
    assert got.count() == 500


def test_terms_of_whole_texts(spark):
    """Terms far from the entity, short ones and such with digits, and those of an entity that occurs once."""
    far = "plain words stand here and more of them " * 20
    rows = [(i, f"plain number {i} words stand here and more of them") for i in range(60)]
    rows += [(100, f"Ask Zog B52 now, {far} me@x.org {far} then Zog left"), (101, f"me@x.org {far} so the B52 of Zog flew"), (102, "plain Zog")]
    rows += [(200, f"Yonder Quokka sat. {far} you@y.org {far} See that quokka run."), (201, "Once Wombat one@z.org"), (202, "Once Wombat one@z.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[100] == f"Ask [TERM] [TERM] now, {far} [EMAIL] {far} then [TERM] left" and clean[101] == f"[EMAIL] {far} so the [TERM] of [TERM] flew"
    assert clean[200] == f"Yonder [TERM] sat. {far} [EMAIL] {far} See that [TERM] run." and clean[201] == "Once Wombat [EMAIL]" and clean[102] == "plain Zog"
    for r in pii.find(docs).collect():
        marks = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")]
        assert {dict(rows)[r.doc_id][s:e].lower() for s, e in marks} == {100: {"zog", "b52"}, 101: {"zog", "b52"}, 200: {"quokka"}}.get(r.doc_id, set())


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0
    rows = [(None, "me@x.org"), (None, "me@x.org"), (1, "a"), (1, "b@c.de"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("mark", F.lit("m"))
    assert sorted(str(r.doc_id) + r.spans for r in pii.find(docs).collect()) == ["1", "1email:0:6", "2", "Noneemail:0:8", "Noneemail:0:8"]
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == ["None", "[EMAIL]", "[EMAIL]", "[EMAIL]", "a"]
