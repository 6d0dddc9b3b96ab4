"""Encoding, token counts, shards, archives and notices against plain versions."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import bpe, licenses, sharding, token_counts, warc

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "  a \n\n b's   x² ½ Ⅷ 漢字 😀👍🏽 é\x1c\x85　y don't  ", "\t\t", "<|endoftext|>", "a" * 5000, "word " * 40_000, " 12345678901234", "same", "same"]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def frame(spark, texts=TEXTS):
    rows = [(None if i == 8 else i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_round_trip_is_that_of_the_ranks(spark, plain):
    got = sorted(map(tuple, bpe.round_trip(frame(spark), RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t or "")
        want.append((None if i == 8 else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_digests_of_offsets_and_kept_columns(spark):
    df = frame(spark).withColumn("n_tokens", F.lit("x"))
    got = bpe.round_trip(df, RANKS, P.PATTERN, offsets=True, keep=True)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"] and got.count() == len(TEXTS)
    want = {r.doc_id: [x for o in r.offsets for x in o] for r in bpe.encode(df, RANKS, P.PATTERN, offsets=True).collect()}
    for r in got.collect():
        assert r.offsets_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<i4").tobytes()).hexdigest() and r.ids == "x"


def test_encode_decode_and_offsets(spark, plain):
    df = frame(spark, TEXTS[:6])
    coded = bpe.encode(df, RANKS, P.PATTERN, offsets=True)
    for r in coded.collect():
        t = TEXTS[r.doc_id] or ""
        assert r.ids == plain.encode_ordinary(t) and len(r.offsets) == len(r.ids)
        assert not r.offsets or (r.offsets[0].start, r.offsets[-1].end) == (0, len(t))
    back = {r.doc_id: r for r in bpe.decode(coded, RANKS, P.PATTERN).collect()}
    assert [back[i].text for i in range(6)] == [t or "" for t in TEXTS[:6]]
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    t = bpe.tokenizer_for(RANKS, P.PATTERN)
    ids = np.frombuffer(next(iter(t.encode_runs([text]))), "<u4")
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert ids.tolist() == plain.encode_ordinary(text) and t.decode(ids) == text.encode()


def test_token_counts(spark, plain):
    docs = frame(spark)
    lengths = token_counts.token_lengths(docs, RANKS, P.PATTERN)
    n = sorted(len(plain.encode_ordinary(t or "")) for t in TEXTS)
    assert sorted(r.n_tokens for r in lengths.collect()) == n
    sums = token_counts.suffix_sums(token_counts.length_histogram(lengths))
    assert {r.n_tokens: r.n_docs for r in sums.collect()} == Counter(n)
    for r in sums.collect():
        assert (r.docs_longer, r.tokens_longer, r.total_tokens) == (sum(x > r.n_tokens for x in n), sum(x for x in n if x > r.n_tokens), sum(n))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    for r in token_counts.truncated_totals(sums, [0, 1, 100, 10**6]).collect():
        assert (r.kept_tokens, r.cut_docs) == (sum(min(x, r.context_limit) for x in n), sum(x > r.context_limit for x in n))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for i, x in enumerate(n, 1) if i >= r.share * len(n))
    assert token_counts.suffix_sums(token_counts.length_histogram(lengths.limit(0))).count() == 0


def test_shards(spark):
    rows = [(i, f"text {i} " * (i % 40 + 1)) for i in range(3000)] + [(5000 + i, "hot " * 200) for i in range(1500)] + [(None, None), (None, None), (9000, "x" * 20_000), (9000, "x" * 20_000), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("s"))
    got = sharding.assign(df).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    size, slots, shards = Counter(), Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots[r.shard, r.slot] += 1
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(size.values()) <= mean * 1.02 + 20_001 and max(slots.values()) == 1
    assert all(s == set(range(len(s))) for s in ({k for x, k in slots if x == n} for n in range(16)))
    hot, large = zlib.crc32(b"hot " * 200), zlib.crc32(b"x" * 20_000)
    assert len(shards[hot]) > 1 and all(len(s) == 1 for c, s in shards.items() if c not in (hot, large))
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.assign(df.repartition(7)).collect() if r.doc_id != 9000}
    assert again == {(r.doc_id, r.text_crc32): r.shard for r in got if r.doc_id != 9000}
    assert sharding.assign(df.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    """Rows with null and with repeated ids are written once each."""
    rows = [(i, f"t{i}") for i in range(200)] + [(None, "t1"), (None, None), (7, "t7"), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("s"))
    told = sharding.write_shards(df, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert Counter(r.shard for r in back.collect()) == Counter(r.shard for r in told.collect()) and "size" in back.columns


def test_overfull_ranges(spark, monkeypatch):
    """Few drawn keys leave ranges overfull; they are subdivided until none is, and a hot text is parted by its rows."""
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 8)
    rows = [(i, f"text {i} " * (1 + 30 * (i % 97 == 0))) for i in range(6000)] + [(10_000 + i, "hot " * 50) for i in range(3000)] + [(None, "hot " * 50)] * 50
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8, keys_per_range=1).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert len(got) == len(rows) and max(size.values()) <= 1.05 * mean and min(size.values()) >= 0.95 * mean
    assert all(sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got))) for n in range(8))


def test_archives(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "http://c\r\nX: y", "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (9, "u", "r"), (9, "u", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = [tuple(r) for r in warc.through_archives(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").collect()]
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        last = max((j for j, _, u in rows if j is not None and (u or "") == (t or "")), default=None)
        link = last if i is not None and i < last else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if link else "response", link, None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_archive_files(spark, tmp_path):
    """The reader takes files of the binaryFile source, with and without dictionary, and says what is wrong."""
    good = warc.record_bytes(1, "http://a", b"body", warc.sha1_base32(b"body"), None, "2024-01-01T00:00:00Z")
    words = b"WARC/1.1 Content-Length body " * 40
    d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(dict_data=d)
    raw = {"a": warc.dictionary_frame(words) + z.compress(good) + z.compress(good.replace(b"body", b"bodx")), "b": zstandard.compress(good[:-1]) + zstandard.compress(b"junk"), "c": zstandard.compress(good)[:-3], "d": b""}
    for k, v in raw.items():
        (tmp_path / f"{k}.warc.zst").write_bytes(v)
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    got = sorted(str(r.problem) for r in warc.read_archives(files).collect())
    assert got[0] == "None" and got[1].startswith("archive") and got[2:] == ["block digest", "length", "no WARC header"]


def test_notices(spark):
    texts = {
        1: "Intro.\nReleased under the MIT License.\nMore words.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "This work is licensed under the GNU General Public License, version 2.",
        4: "Licensed under CC BY-NC 4.0. And LICENSED UNDER CC BY 4.0.", 5: "He has a license to drive and permission to park.", 6: licenses.TEMPLATES["MIT"].replace("without restriction", "without any restriction"), 7: None, 8: "", 9: "é" * 10 + " " + licenses.TEMPLATES["Apache-2.0"],
        10: "Licensed under the Weird License, Version 9.9.", 11: "word " * 50_000 + "Released under the MIT License.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("license", F.lit("z"))
    got = sorted((r.doc_id, r.license, texts[r.doc_id][r.start : r.end]) for r in licenses.scan(df).collect())
    assert [(i, n) for i, n, _ in got] == [(1, "MIT-notice"), (2, "GPL-3.0"), (3, "GPL-2.0"), (4, "CC-BY-4.0"), (4, "CC-BY-NC-4.0"), (6, "MIT"), (9, "Apache-2.0"), (11, "MIT-notice")]
    assert got[0][2] == "Released under the MIT License"
    six = next(r for r in licenses.scan(df).collect() if r.doc_id == 6)
    assert (six.missing, six.added) == ([], ["any"])
    assert licenses.scan(df.limit(0)).count() == 0


def test_short_notices(spark):
    """Each template stands for itself, alone and with other text around it."""
    lines = dict(licenses.TEMPLATES)
    texts = ["All rights reserved.", "Licensed under the MIT License.", "Released under the Apache License, Version 2.0.", *lines.values()]
    want = ["proprietary-notice", "MIT-licensed", "Apache-2.0-released", *lines]
    around = "Some words of prose that go before it, as they do in most documents.\n{}\nAnd then the text goes on with other words about birds and rivers."
    rows = [(i, x) for i, t in enumerate(texts) for x in (t, around.format(t))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.license) for r in got.collect()) == Counter({(i, k): 2 for i, k in enumerate(want)})


def test_corpus_notices_of_all_five_lines(spark, data):
    """Every planted line is found, the reserved rights too, and nothing else."""
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    lines = {licenses.TEMPLATES[k]: k for k in ("MIT-notice", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")} | {"All rights reserved.": "proprietary-notice"}
    want = Counter((r.doc_id, k) for r in docs.collect() for line, k in lines.items() for _ in range(r.text.count(line)))
    assert Counter((r.doc_id, r.license) for r in licenses.scan(docs).collect()) == want


def test_numbers_and_common_words_in_notices(spark):
    """Numbers of clauses, lines and pages are differences of wording; other names and versions are other licenses."""
    t = licenses.TEMPLATES
    bsd = t["BSD-3-Clause"].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    texts = [bsd, t["MIT"].replace("subject to", "17 subject to"), t["Apache-2.0-header"].replace("required by", "required"), t["GPL-3.0-header"].replace("GNU General", "GNU Lesser General"), t["GPL-3.0-header"].replace("version 3", "version 2")]
    texts += ["Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", t["CC-BY-4.0-work"].replace("Attribution", "Attribution-NoDerivatives")]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.missing, r.added) for r in got) == [(0, "BSD-3-Clause", [], ["1", "2", "3"]), (1, "MIT", [], ["17"]), (2, "Apache-2.0-header", ["by"], []), (3, "LGPL-3.0-header", [], [])]


def test_many_like_places(spark):
    """A notice behind several that start as it does is found at its own place."""
    half = "permission of sun and sea"
    text = f"{half} here we go " * 5 + f"{half} {half}"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = licenses.scan(df, templates={"twice": f"{half} {half}"}).collect()
    assert [(r.start, r.end, r.missing, r.added) for r in got] == [(text.index(f"{half} {half}"), len(text), [], [])]


def test_names_expressions_and_lists():
    """Tags as expressions of whole names, names in lists, headings and one-word names."""
    s = licenses.Scanner(licenses.TEMPLATES)
    found = lambda t: [(k.split("-name")[0], t[a:z]) for k, a, z, *_ in s.scan(t)]
    assert found("// SPDX-License-Identifier: MIT-0\nx") == found("SPDX-License-Identifier: BSD-3-Clause-Clear") == found("SPDX-License-Identifier: MIT+") == []
    assert found("SPDX-License-Identifier: MIT OR Apache-2.0") == [("MIT-tag", "SPDX-License-Identifier: MIT"), ("Apache-2.0-tag", "Apache-2.0")]
    assert found("(SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND mit).\nOR ISC") == [("GPL-2.0-only-tag", "SPDX-License-Identifier: (GPL-2.0-only"), ("MIT-tag", "mit")]
    assert found("under the MIT License and the Apache License, Version 2.0") == [("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0")]
    assert found("Licensed under the MIT License or the Mozilla Public License 2.0.") == [("MIT-licensed", "Licensed under the MIT License"), ("MPL-2.0", "Mozilla Public License 2.0")]
    assert found("the MIT license") == [("MIT", "MIT license")] and found("It is GPLv3 code, not LGPLv2.1.") == [("GPL-3.0", "GPLv3"), ("LGPL-2.1", "LGPLv2.1")]
    assert [k for k, _ in found("MIT License\n\nCopyright (c) 2020 Us\n\n" + licenses.TEMPLATES["MIT"])] == ["MIT", "MIT"]
    assert found("MIT-0 License") == found("a license by MIT") == found("the GNU General Public License") == found("GPL-3.0-like") == []


def test_near_names_every_template_that_can_fit():
    """The running counts against counting each window anew."""
    rng = np.random.default_rng(5)
    s = licenses.Scanner(licenses.TEMPLATES)
    vocab = sorted({w for t in s.words.values() for w in t}) + ["x"] * 200
    words = [(vocab[i], 0, 0) for i in rng.integers(0, len(vocab), 1500)] + [(w, 0, 0) for w in s.words["MIT"]] * 3
    places = sorted(rng.choice(len(words), 150, replace=False).tolist())
    for p, names in zip(places, s.near(words, places)):
        window = {w for w, _, _ in words[max(0, p - s.reach) : p + s.reach]}
        assert names == sorted(k for k, w in s.words.items() if len(window & set(w)) >= s.least[k])


def test_text_of_triggers_alone():
    import time

    rng = np.random.default_rng(1)
    few = ["license", "permission", "copyright", "redistribution", "free software", "licensed", "version", "the", "public", "general"]
    text = " ".join(few[i] for i in rng.integers(0, len(few), 60_000))
    began = time.time()
    licenses.Scanner(licenses.TEMPLATES).scan(text)
    assert time.time() - began < 60
