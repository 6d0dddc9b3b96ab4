"""Golden cases of parsing, rules, packs, the reading model and documents."""

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelens.functions.elements import selector
from pagelens.operators import documents, enrichment, packs, reading, rules
from pagelens.plans.page_queries import DEFECTS
from pagelens.sources import pages as source
from pagelens.streaming import audits as stream


SELECTORS = ["p", "#A", ".acc", "[data-k='Ab']", "[data-k*='a' i]", "[class~='x']", "p:not([data-k])", "[class~='acc'] [class*='header']", ".acc > .header", "p + b", "p ~ b", "div ~ [title]", "div p + i b, s", "*", "p::before"]


def parse(spark, *html):
    return source.parse_pages(spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("https://lib.example/x")))


def test_tree():
    nodes = source.parse_html("<p>a <b>b<p>c<ul><li>x<li>y</ul><script>var t='</p>';</script><br>d &amp; e<span aria-hidden=true>×</span>")
    got = [(n["tag"], n["parent"], n["end"], n["text"]) for n in nodes]
    assert got[:3] == [("p", 0, 2, "a b"), ("b", 1, 2, "b"), ("p", 0, 3, "c")]
    assert [n["ix"] for n in nodes if n["tag"] == "li"] == [0, 1] and source.parse_html("") == []
    assert source.parse_html("<button><span aria-hidden='true'>Go</span>×</button>")[0]["vis"] == ""


def test_selectors(spark):
    df = parse(spark, "<div class='acc x' id=A><p class='header' data-k='Ab'>1</p><i><b class='header'>2</b></i></div><p>3</p>")
    count = lambda s: df.select(F.size(F.filter("nodes", selector(s)))).first()[0]
    assert [count(s) for s in ("p", "#A", ".acc", "[data-k]", "[data-k='Ab']", "[data-k*='b']", "[data-k*='a' i]", "[class~='x']", "p:not([data-k])", "[class~='acc'] [class*='header']", ".acc > .header", "p, b", "[data-k^='A']")] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 2, 1, 3, 1]
    with pytest.raises(ValueError):
        selector("p::before")


def test_rules_see_earlier_rules_and_undo(spark):
    body = "".join(DEFECTS.values())
    out = rules.run_rules(parse(spark, f"<html><body>{body}</body></html>", "")).cache()
    report = rules.audit_report(out).where("page_id = 0").collect()
    assert {r.rule_id for r in report} >= {"file-links", "images-alt", "icon-buttons", "form-fields", "media-captions"}
    assert rules.audit_report(out).where("page_id = 1 and rule_id <> 'landmarks'").count() == 0
    same = rules.undo_changes(out).select(F.col("original").cast("string") == F.col("nodes").cast("string")).collect()
    assert [r[0] for r in same] == [True, True]
    once = rules.touched_elements(out).where("page_id = 0").collect()
    assert any(r.needs_content and "ACC2" in r.codes for r in once)


def test_large_page(spark):
    """A page of some 12,000 elements, all rules: the work follows its size, so this ends in seconds."""
    body = "".join(DEFECTS.values())
    n = len(source.parse_html(f"<body>{body}</body>")) - 1
    times = 12_000 // n
    report = rules.audit_report(rules.run_rules(parse(spark, f"<html><body>{body * times}</body></html>"))).collect()
    found = {(r.rule_id, r.kind): r["count"] for r in report}
    assert found["file-links", "fix"] == found["help-affordance", "fix"] == found["pagination", "fix"] == times
    assert found["form-fields", "flag"] >= times and sum(r.rule_id == "graphs-longdesc" and r.kind == "flag" for r in report) >= times


def test_reading_takes_linear_time(spark):
    """Tables in tables, tens of thousands of paragraphs, and as many with one text."""
    nested = "<main>" + "<table><tr><td>" * 400 + "x" + "</td></tr></table>" * 400 + "</main>"
    assert reading.reading_blocks(parse(spark, nested)).select(F.size("rows")).collect() == [(400,)]
    many = "<main>" + "".join(f"<p>text {i}</p>" for i in range(30_000)) + "<p>same</p>" * 30_000 + "</main>"
    rows = reading.reading_blocks(parse(spark, many)).orderBy("ix").collect()
    assert [r.text for r in rows] == [f"text {i}" for i in range(30_000)] + ["same"]
    modals = rules.changes(rules.run_rules(parse(spark, "<body>" + "<div class='modal'>open</div>" * 1000 + "<p>b</p></body>"), ["dialog-escape"]))
    assert modals.where("attr = 'aria-hidden'").count() == 1001


def test_what_is_near_an_element():
    """The structure that the parse leaves against looking for it."""
    html = "<a href=x>t<b><img src=1><i>u</i></b></a><label>L <input></label><nav> <p>a</p> <ul><li> <svg><title>T</title></svg></ul></nav><div> </div><a><img alt=z><button>o</button></a><label></label>"
    nodes = source.parse_html(html)
    for n in nodes:
        below = [m for m in nodes if n["id"] < m["id"] <= n["end"]]
        first = lambda *tags: next((m["id"] for m in below if m["tag"] in tags), 0)  # noqa: B023, E731
        above = lambda tag: next((u for u in reversed(n["up"]) if nodes[u - 1]["tag"] == tag), 0)  # noqa: B023, E731
        assert (n["a"], n["label"], n["nav"]) == (above("a"), above("label"), above("nav"))
        assert (n["title"], n["pic"], n["ctl"]) == (first("title"), first("img"), first(*source.CONTROLS))
        assert n["blocky"] == any(m["tag"] in source.BLOCKS for m in below) and n["chars"] == len(n["text"])


def test_packs_from_files(spark, tmp_path):
    """Files of packs, the broken left out; what the interpreter selects against selectors as columns."""
    own = {"id": "own", "match": {"selectors": ["p, .none"]}, "rules": [{"code": chr(65 + i), "select": s, "set": {f"data-{i}": i}} for i, s in enumerate(SELECTORS)]}
    for name, text in (("a", json.dumps(own)), ("b", "{cut"), ("c", '{"id": "late", "match": {"hosts": ["other"]}, "rules": []}')):
        (tmp_path / f"{name}.json").write_text(text)
    rows = packs.read_site_packs(spark, f"file://{tmp_path}/*.json")
    assert [(r.id, r.enabled, r.source) for r in rows.orderBy("ord").collect()] == [("own", True, "file"), ("late", True, "file")]
    html = "<div class='acc x' id=A><p class='header' data-k='Ab'>1</p><i><b class='header'>2</b></i></div><p>3</p><b>4</b><s title=t>5</s><b class=acc>6</b>"
    pages = rules.prepared(parse(spark, html, "<i>no</i>"))
    got = packs.apply_packs(pages, rows).where("page_id = 0").cache()
    for i, s in enumerate(SELECTORS):
        want = pages.where("page_id = 0").select(F.filter("nodes", selector(s)).id).first()[0] if i != len(SELECTORS) - 1 else []
        assert [r.node_id for r in rules.changes(got).where(F.col("attr") == f"data-{i}").orderBy("node_id").collect()] == want, s
    assert rules.changes(packs.apply_packs(pages, rows)).where("page_id = 1").count() == 0
    small, large = (packs.apply_packs(pages, packs.as_packs(spark, [own | {"id": f"p{i}"} for i in range(n)])) for n in (5, 500))
    size = lambda df: df._jdf.queryExecution().analyzed().expressions().toString().count("lambda")
    assert size(small) == size(large)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packs, "PASS_CHARS", 10)
        assert packs.pack_matches(pages, packs.as_packs(spark, [own, own | {"id": "b", "enabled": False}, own | {"id": "c"}])).count() == 2


def test_enrichment_runs(spark, tmp_path):
    """Keys that fail are called again, those that succeeded never; a service that raises or loses keys; how requests end."""
    log = tmp_path / "log"
    log.mkdir()

    def call(cap, src, label):
        mark = log / src
        mark.write_text(mark.read_text() + "x" if mark.exists() else "x")
        if src == "never" or src == "second" and len(mark.read_text()) < 2 or src == "later" and len(mark.read_text()) < 4:
            raise ValueError("busy")
        return f"words of {src}"

    def loses(batches):
        for b in batches:
            yield pd.DataFrame({"key": [], "result": [], "error": []})

    rows = [(i, cap, s, s, s) for i, (cap, s) in enumerate([*[("ocr", s) for s in ("first", "second", "never", "later", "first")], ("transcribe", "t"), ("describeImage", "d"), ("describeGraph", "g")])]
    requests = enrichment.with_key(spark.createDataFrame(rows, "n int, cap string, src string, label string, hash_source string"))
    known = enrichment.Providers(ocr="auto", transcribe="auto", describeGraph="auto").register(enrichment.Registered("ocr", "o", enrichment.per_item(call))).register(enrichment.Registered("transcribe", "t", loses)).register(enrichment.Registered("describeImage", "d", loses))
    ended = lambda run: [(r.state, r.note, r.result) for r in enrichment.run_enrichment(requests, known, f"file://{tmp_path}/kept", run).orderBy("n").collect()]
    rest = [("failed", "no result", None), ("held", "waiting for you to run it", None), ("skipped", "no provider configured", None)]
    first, second = ("done", "", "words of first"), ("done", "", "words of second")
    assert ended("1") == [first, second, ("failed", "busy", None), ("failed", "busy", None), first, *rest]
    assert ended("2") == [first, second, ("failed", "busy", None), ("done", "", "words of later"), first, *rest]
    assert {f.name: len(f.read_text()) for f in log.iterdir()} == {"first": 1, "second": 2, "never": 4, "later": 4}
    cache = enrichment.enrichment_cache(enrichment.read_calls(spark, f"file://{tmp_path}/kept"))
    assert {(r.generated, r.verified, r.provider) for r in cache.collect()} == {(True, False, "o")} and cache.count() == 3


def test_text_once_a_page(spark):
    """Text lies in pieces of the page; elements that nobody closes don't nest without end."""
    df = parse(spark, "<div>a <b> b</b>c" * 3000)
    assert df.select(F.size("bits"), F.expr("aggregate(bits, 0, (n, b) -> n + length(b))"), F.expr("array_max(transform(nodes, n -> n.depth))")).first()[1:] == (3000 * 4, source.DEEPEST)
    rows = source.page_nodes(parse(spark, "<p> One <b>two </b> three<i aria-hidden=true>x</i></p><i aria-hidden=true>y</i>")).orderBy("node_id").collect()
    assert [(r.text, r.vis_name) for r in rows] == [("One two threex", "One two threex"), ("two", "two"), ("x", "x"), ("y", "y")]


def test_siblings_in_selectors(spark):
    df = parse(spark, "<body><p>1</p><b>2</b><i>3</i><b>4</b><div><b>5</b></div></body>")
    count = lambda s: df.select(F.size(F.filter("nodes", selector(s)))).first()[0]
    assert [count(s) for s in ("p + b", "p ~ b", "i + b", "p ~ div > b", "p+b, p~i", "b ~ p")] == [1, 2, 1, 1, 2, 0]


def test_packs_as_rows_and_providers(spark):
    own = packs.as_packs(spark, [{"id": "a", "rules": [{"code": "A"}]}])
    more = packs.register_pack(packs.register_pack(own, {"id": "b", "rules": [{"code": "B"}]}), {"id": "a", "rules": [{"code": "C"}]})
    listed = lambda df: [(r.id, r.rules[0].code, r.enabled) for r in df.orderBy("ord").collect()]
    assert listed(more) == [("a", "C", True), ("b", "B", True)] and listed(packs.unregister_pack(more, "b")) == [("a", "C", True)]
    assert listed(packs.enable_pack(more, "a", False)) == [("a", "C", False), ("b", "B", True)]
    with pytest.raises(ValueError):
        packs.register_pack(own, {"id": "c"})
    known = enrichment.Providers(describeGraph="off").register(enrichment.Registered("ocr", "local")).register(enrichment.Registered("transcribe", "remote", available=lambda: False))
    assert {r.cap: (r.name, r.available, r.policy) for r in known.rows(spark).collect()} == {"ocr": ("local", True, "ask"), "describeImage": (None, False, "ask"), "describeGraph": (None, False, "off"), "reflowPdf": (None, False, "auto"), "transcribe": ("remote", False, "ask")}
    with pytest.raises(ValueError):
        known.register(enrichment.Registered("dance", "x"))


def test_names(spark):
    out = rules.run_rules(parse(spark, "<a href='/f/Annual_Report_2023.pdf'>here</a><a href='b.docx' data-size='1536' target=_blank>Plan (docx, 1 MB)</a>"), ["file-links"])
    got = [(c.attr, c.new) for c in rules.changes(out).orderBy("stage").collect() if c.attr != rules.MARK]
    assert got == [("aria-label", "Annual Report 2023, PDF file"), ("aria-label", "Plan, Word file, 1.5 KB (opens in new window)"), ("rel", "noopener")]


def test_packs(spark):
    df = rules.prepared(parse(spark, "<meta name=Generator content='Drupal 10'><div class='pager'>a</div><div class='pager' role='navigation'>b</div>", "<p>x</p>"))
    assert [(r.page_id, r.pack_id) for r in packs.pack_matches(df, packs.BUNDLED).collect()] == [(0, "islandora")]
    out = packs.apply_packs(df, packs.BUNDLED)
    assert [(r.pack_id, r.code, r["count"]) for r in rules.audit_report(out).collect()] == [("islandora", "NAV2", 1)]
    own = [{"id": "mine", "match": {"hosts": ["lib.example"]}, "rules": [{"code": "X", "level": "A", "select": "p", "set": {"role": "note"}, "remove": ["class"]}]}]
    assert rules.audit_report(packs.apply_packs(df, own)).first().msg == "[mine] X"
    assert packs.bundled_packs(spark).count() == 5


def test_reading_model(spark):
    html = "<header>H</header><nav>n</nav><main><h1>T</h1><p>One <a href='a.pdf'>Doc</a></p><p>One <a href='a.pdf'>Doc</a></p><img src='x.png' alt='x.png'><figure><img src='f.png'><figcaption>Cap</figcaption></figure><div class='chart'>Sales</div><table><caption>C</caption><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><ul><li>i</li></ul><h2>U</h2><div hidden>no</div><h2>V</h2></main><footer>f</footer>"
    blocks = reading.reading_blocks(parse(spark, f"<body>{html}</body>")).cache()
    assert [(r.type, r.text) for r in blocks.orderBy("ix").collect()] == [("heading", "T"), ("para", "One Doc"), ("filelink", None), ("image", ""), ("image", "Cap"), ("graph", "Sales"), ("table", "C"), ("list", None), ("heading", "U"), ("heading", "V")]
    assert blocks.where("type = 'table'").first().rows == [["1", "2"]]
    assert [r.slug for r in reading.outline(blocks).orderBy("seq").collect()] == ["rr-t-0", "rr-u-1", "rr-v-2"]
    requests = enrichment.with_key(enrichment.requests_of(blocks))
    providers = spark.createDataFrame([("describeImage", "p", True, "auto"), ("describeGraph", "p", True, "ask")], "cap string, name string, available boolean, policy string")
    cache = spark.createDataFrame([], "key string, result string")
    planned = enrichment.plan_requests(requests, providers, cache)
    assert {r.cap: r.state for r in planned.collect()} == {"describeImage": "queued", "describeGraph": "held"}

    def provider(batches):
        for b in batches:
            yield b[["key"]].assign(result=" A barn ", error=None)

    done = enrichment.call_provider(planned, provider, "p", 2).cache()
    assert [(r.generated, r.verified, r.provider) for r in done.collect()] == [(True, False, "p")]
    filled = enrichment.apply_descriptions(blocks, requests, done)
    assert [(r.text, r.generated) for r in filled.where("type = 'image'").orderBy("ix").collect()] == [("A barn", True), ("Cap", False)]
    assert {r.state for r in enrichment.plan_requests(requests, providers, done).collect()} == {"done", "held"}


def test_documents(spark):
    items = [(1, 0, 0, 0.0, 700.0, 20.0, "Big"), (1, 0, 1, 50.0, 701.0, 20.0, " Title"), (1, 0, 2, 0.0, 680.0, 10.0, "First line"), (1, 0, 3, 0.0, 660.0, 10.0, "ends here."), (1, 1, 4, 0.0, 700.0, 10.0, "Next <page>")]
    df = spark.createDataFrame(items, "doc_id long, page int, seq int, x double, y double, size double, str string")
    nodes = documents.build_paragraphs(documents.classify_lines(documents.group_text_lines(df), documents.body_size(df))).cache()
    assert [(r.type, r.level, r.text) for r in nodes.orderBy("ix").collect()] == [("h", 1, "Big Title"), ("p", None, "First line ends here."), ("p", None, "Next <page>")]
    html = documents.render_html(nodes, documents.document_title(nodes)).first().html
    assert html.startswith('<article lang="en">\n<h1>Big Title</h1>\n<h2>Big Title</h2>') and "Next &lt;page&gt;" in html
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "hello"), (1, 1, 1.0, 3661.5, " world ")], "media_id long, seq int, start double, end double, text string")
    assert documents.segments_to_vtt(seg).first().vtt == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\nhello\n\n2\n00:00:01.000 --> 01:01:01.500\nworld\n"
    assert documents.transcript_text(seg).first().text == "hello world"
    key = spark.createDataFrame([("abc",), ("",)], "t string").select(enrichment.content_key(F.col("t"))).collect()
    assert [r[0] for r in key] == ["1a47e90b", "811c9dc5"]
    cells = documents.csv_to_cells(spark.createDataFrame([(1, 'a,"b ""q"", c"\r\n,\n"x\ny",2')], "doc_id long, text string")).orderBy("row", "col").collect()
    assert [(r.value, r.scope) for r in cells] == [("a", "col"), ('b "q", c', "col"), ("x\ny", "row"), ("2", None)]


def plain_csv(text):
    """Rows by the states that a reader of CSV passes through, one character at a time."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and text[i : i + 2] == '""':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\n\r":
            cell += c
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return [r for r in rows if any(x.strip("\t\n\x0b\f\r \xa0\u2028\ufeff") for x in r)]


def test_csv_states(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice('"",,\n\r ab\x01\x02\x00\xa0\x85é') for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ['"a\n', '"', '""', '"""', 'a,', ",", "\n", '"' + 'x""' * 200_000, '"a",' * 20_000, None]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", documents.csv_rows(F.col("t")).alias("rows")).collect()
    for r in got:
        assert r.rows == plain_csv(texts[r.id] or ""), texts[r.id]


def test_lines_by_first_item(spark):
    """Random baselines against a walk over the items; a page of many items on few lines."""
    rng = random.Random(3)
    items, want = [], {}
    for doc in range(60):
        lines, low = {}, rng.choice([-12, 0, 100])
        for seq in range(rng.randrange(1, 25)):
            y = low + rng.randrange(48) / 4
            items.append((doc, 0, seq, rng.random(), y, 10.0, f"{seq}."))
            key, known = math.floor(y + 0.5), None
            for k in sorted((k for k in lines if k >= 0)) + [k for k in lines if k < 0]:
                known = k if abs(k - key) <= 2 else known
            lines.setdefault(key if known is None else known, []).append((items[-1][3], f"{seq}."))
        want[doc] = ["".join(t for _, t in sorted(lines[k])) for k in sorted(lines, reverse=True)]
    items += [(99, 0, i, float(i), 700.0 - i % 40 * 10, 10.0, "x") for i in range(20_000)]
    df = spark.createDataFrame(items, "doc_id long, page int, seq int, x double, y double, size double, str string")
    got = documents.group_text_lines(df).orderBy("doc_id", "line").collect()
    for doc in want:
        assert [r.text for r in got if r.doc_id == doc] == want[doc]
    assert [len(r.text) for r in got if r.doc_id == 99] == [500] * 40


def test_streams(spark, tmp_path, data):
    pages = spark.read.parquet(f"{data}/sf0.001/pages.parquet")
    pages.limit(5).write.parquet(f"file://{tmp_path}/in")
    query = stream.stream_page_audit(spark.readStream.schema(pages.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check", ["landmarks"])
    query.awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").where("rule_id = 'landmarks'").count() == 5
