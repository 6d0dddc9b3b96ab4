"""What the findings of the third round were about, on tables made for them."""

import duckdb
import pytest

from pagelens import plans
from pagelens.operators import enrichment

from .test_queries import rows


def against_sql(spark, name, d, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, str(d)).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return rows(got)


def write(path, select):
    duckdb.sql(f"copy ({select}) to '{path}' (format parquet)")


@pytest.mark.parametrize("name", ["reading_blocks", "outline"])
def test_headings_cut_within_an_entity(spark, tmp_path, name):
    cut = ["a &amp", "b &amp;&am", "c &lt", "d &quot", "e &amp;lt", "f &amp;amp;", "g &"]
    pages = [(i, f"u{i}", f"<html><body><article><h1>{h}</h1><p>x &amp; y</p></article></body></html>") for i, h in enumerate(cut)]
    duckdb.sql("create or replace temp table cut_pages(page_id bigint, url varchar, html varchar)")
    duckdb.executemany("insert into cut_pages values (?, ?, ?)", pages)
    write(tmp_path / "pages.parquet", "from cut_pages")
    got = against_sql(spark, name, tmp_path, "pages")
    assert sum("a &" in r for r in got) == 1 and not any("a &amp" in r for r in got)


def test_pages_of_one_small_file_are_many_tasks(spark, data):
    from pagelens.plans import made_queries, page_queries, rule_queries

    d = f"{data}/sf0.001"
    for pages in (rule_queries.planted_pages(spark, d, "images-alt"), page_queries.pack_pages(spark, d), made_queries._reading_pages(spark, d), made_queries._whole_pages(spark, d)):
        assert pages.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_what_a_page_is_like_is_worked_out_once_for_all_packs(spark):
    import re

    from pagelens.operators import packs, rules
    from pagelens.sources import pages

    some = [{"id": f"k{i}", "match": {"generator": "x", "selectors": [f".c{i}"]}, "rules": [{"code": "X1", "select": "p", "set": {"role": "a"}}]} for i in range(3)]
    parsed = pages.parse_pages(spark.createDataFrame([(1, "u", '<meta name="generator" content="ax"><p class="c2">a</p>')], "page_id long, url string, html string"))
    out = packs.apply_packs(rules.prepared(parsed), packs.as_packs(spark, some))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"arrays_overlap\([^()]*\)", plan) and not re.search(r"arrays_overlap\([^()]*\(", plan)
    assert {(r.pack_id, r.attr) for r in rules.changes(out).collect()} >= {("k0", "role"), ("k1", "role"), ("k2", "role")}


def test_contents_of_one_content_key_are_told_apart(spark, tmp_path):
    one = ("glbvs", "yacxa")
    assert len({r.key for r in spark.createDataFrame([(t,) for t in one], "t string").select(enrichment.content_key("t").alias("key")).collect()}) == 1
    write(tmp_path / "documents.parquet", f"select * from (values (0::bigint, '{one[0]}', 's'), (4, '{one[1]}', 's'), (8, '{one[0]}', 's')) t(doc_id, text, source)")
    assert ("ocr", "4", "", "queued") in against_sql(spark, "plan_requests", tmp_path, "documents")
    against_sql(spark, "enrichment_status", tmp_path, "documents")


def test_lines_of_a_page_are_found_by_baseline(spark):
    from pagelens.operators import documents

    one = [(1, 0, k, float(k % 10), 700.0 - 18 * (k // 10) + k % 2, 10.0, f"{k} ") for k in range(400)]
    items = spark.createDataFrame([*one, (2, 0, 0, 2.0, 10.0, None, "b"), (2, 0, 0, 1.0, 10.4, 3.0, "a"), (2, 1, 0, 0.0, 5.0, 1.0, " ")], "doc_id long, page int, seq int, x double, y double, size double, str string")
    lines = documents.group_text_lines(items)
    got = {(r.doc_id, r.page, r.line): (r.text, r.size) for r in lines.collect()}
    assert got == {(1, 0, n + 1): (" ".join(str(k) for k in range(10 * n, 10 * n + 10)), 10.0) for n in range(40)} | {(2, 0, 1): ("ab", 3.0)}
    # items are dealt once, by page, and no array of a page's items is walked for each of them
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_stored_ids_name_the_audit_and_the_place(spark):
    from pagelens.sources import audits

    shot = "array(named_struct('kind', 'good', 'filename', 'f', 'note', '', 'image_base64', cast(null as string)))"
    one = spark.range(2).selectExpr("concat('a', id) as id", "'n' as dl_name", "'u' as dl_url", "'' as assessor", "'t' as created_at", "'' as user_agent", "'' as tool_version", "'' as overall_note", f"cast(null as {audits.SUMMARY}) as auto_summary", f"cast(array(named_struct('code', 'A', 'level', 'A', 'title', 't', 'compliance_score', 1, 'auto_score', 1, 'auto_findings', null, 'violations_note', '', 'good_note', '', 'evidence', {shot})) as array<{audits.SITUATION}>) as situations")
    tables = audits.flatten_audits(one)
    assert sorted(r.id for r in tables["situation_result"].collect()) == ["a0:0", "a1:0"]
    assert sorted((r.id, r.situation_result_id) for r in tables["evidence"].collect()) == [("a0:0:0", "a0:0"), ("a1:0:0", "a1:0")]


def test_plain_markup_is_read_as_the_standard_parser_reads_it(monkeypatch):
    from pagelens.sources import pages

    def slow(html):
        tree = pages._Tree()
        markup = pages._Markup(tree)
        markup.feed(html)
        markup.close()
        return tree.finish()

    plain = [
        "<!DOCTYPE html><html><head><title>a &amp; b</title></head><body class='x y' ID=m hidden><P>c<p id=1 id=2> d  e<ul><li>f<li>g</ul><br>&lt;h", "", " a", "<a href=\"/f.pdf\" data-size='20'\n>x</a></b>y &am",
        "<div aria-hidden=true>x<b>y</b></div><img alt=''><table><tr><td>1<td>2<tr><td>3</table>", "<label>N <input required></label><nav><a>z</a></nav>",
    ]
    other = ["<title>x<b>y</b></title>z", "<title>x", "<script>var t='</p>'</script>a", "<br/>a", "<svg/>b", "<!-- c -->d", "<p a='1'b='2'>e", "<p a='&lt;'>f", "a < b", "<p", "<a href=/x/>g", "</p >h", "<p é=1>", "<textarea><p></textarea>"]
    for html in plain + other:
        assert pages._read(html) == slow(html), html
    # plain markup needs no HTMLParser, and a page met again isn't read again
    monkeypatch.setattr(pages, "_Markup", None)
    for html in plain:
        assert pages._read_short(html) is pages._read_short(html)
    assert all(pages._read_plain(html) is None for html in other)


def test_few_of_many_packs_are_tried_on_a_page(spark):
    from pagelens.operators import packs
    from pagelens.sources import pages

    match = {
        "all": {}, "host": {"hosts": ["lib1.", "lib2."]}, "host_asks": {"hosts": ["lib1."], "generator": "maker"}, "empty": {"generator": "^z*$"}, "open": {"selectors": ["[data-x]"]}, "open_host": {"hosts": ["lib2."], "selectors": ["[data-x]"]},
        "class": {"selectors": ["li.c1", "li.c1 > b"]}, "id": {"selectors": ["p.c2#a"]}, "tag": {"selectors": ["ul > i:not(.c1)"]}, "both": {"generator": "MAKER [0-9]", "selectors": ["li.c1"]}, "bad": {"generator": "bad(", "selectors": [".c9"]},
    }
    rows = packs.as_packs(spark, [{"id": k, "match": m, "rules": [{"code": "X", "select": "p", "set": {"role": "a"}}]} for k, m in match.items()])
    html = ['<meta name=generator content="Maker 1"><ul><li class="c1 x">a</ul>', '<p id=a class="c2">a</p><ul><i class=c1>b</i></ul>', '<ul><i data-x>b</i><li>c</ul>']
    parsed = pages.parse_pages(spark.createDataFrame([(i, f"https://lib{i}.org", h) for i, h in enumerate(html, 1)], "page_id long, url string, html string"))
    got = {}
    for r in packs.pack_matches(parsed, rows).collect():
        got.setdefault(r.page_id, []).append(r.pack_id)
    assert got == {1: ["all", "host", "host_asks", "class", "both"], 2: ["all", "host", "empty", "id"], 3: ["all", "empty", "open", "tag"]}
    # a pack stands under the id or class that it needs rather than under a tag, which most pages have
    found = packs._finders([packs.compile_pack({"id": f"k{i}", "match": {"selectors": [f"li.c{i}"]}, "rules": []}, lambda p: True) for i in range(300)])
    assert not found["any"] and max(map(len, found["signs"])) < 8 and sorted(k["key"] for s in found["signs"] for k in s) == sorted(f".c{i}" for i in range(300))


def test_what_pages_show_is_counted_once(spark, data):
    from pagelens.plans import page_queries

    plan = page_queries.good_techniques(spark, f"{data}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # each look at a page's images is one filter, which count, message and both of its findings read
    assert plan.count("gif|webp|svg|tif") == 1 and plan.count("exists(nodes") == 2


def test_pages_of_one_source_are_audited_once_for_the_counts(spark, tmp_path, monkeypatch):
    from pagelens.plans import rule_queries

    few = {r: rule_queries.PLANTED[r] for r in ("form-fields", "landmarks")}
    monkeypatch.setattr(rule_queries, "PLANTED", few)
    write(tmp_path / "part.parquet", "select i::bigint as p_partkey, 'n' || i // 40 as p_name, 'b' as p_brand, 't' as p_type, (i % 7)::int as p_size, 1.0 as p_retailprice from range(90) t(i)")
    rows_of = rule_queries.rule_counts(spark, str(tmp_path))
    want = duckdb.sql(" union all ".join(rule_queries._counts_sql(r) for r in few).replace("from part", f"from '{tmp_path}/part.parquet'")).fetchall()
    assert sorted(map(tuple, rows_of.collect())) == sorted(want) and len(want) == 2
    plan = rows_of._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [" ".join(plan[i + 1 : i + 3]) for i, line in enumerate(plan) if "MapInArrow" in line]
    assert len(below) == 2 and all("Aggregate [" in b for b in below)


def test_a_form_field_is_looked_at_once(spark):
    from pagelens.operators import rules
    from pagelens.sources import pages

    ids, found, fixes, flags = rules.form_fields().kept
    # whether a field has a name is worked out once, and so is how many fields there are of each kind
    assert found.of.text.count("aria-labelledby") == 1 and all(f"{found.text}, 0" in k.of.text for k in (fixes, flags))
    html = "<form><label for=a>A</label><input id=a><label>B</label><input id=b required><input id=c placeholder=' C '><input id=d><label>E</label><label for=x>F</label><input id=g><input required aria-label=h><label>I<select></select></label><textarea title=j></textarea><input type=hidden></form>"
    audited = rules.run_rules(pages.parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")), ["form-fields"])
    got = {(r.node_id, r.attr, r.new) for r in rules.changes(audited).collect() if r.attr != rules.MARK}
    assert got == {(4, "for", "b"), (5, "aria-required", "true"), (6, "aria-label", "C"), (8, "for", "d"), (10, "data-needs-label", "1"), (11, "aria-required", "true")}
    assert sorted((r.kind, r["count"]) for r in rules.audit_report(audited).collect()) == [("fix", 5), ("flag", 1)]


def test_a_page_met_again_is_made_once(spark, data):
    from pagelens.plans import rule_queries
    from pagelens.sources import pages

    read, places = [pages._read(h) for h in ("<p a=1>x<b>y</b>", "<ul class='q'><li>a<li>b</ul>", "")], [0, 1, 1, 2, 0, 2]
    assert [a.to_pylist() for a in pages._repeated(read, places)] == [a.to_pylist() for a in pages._arrays([read[k] for k in places])]
    # equal pages of a task stand beside each other, so few of them are read again
    made = rule_queries.planted_pages(spark, f"{data}/sf0.001", "form-fields").rdd.mapPartitions(lambda rows: [[r.html for r in rows]]).collect()
    assert all(p == sorted(p) for p in made) and max(map(len, made)) > 5
    html = ["<p>a</p>", "<b>c</b>", "<p>a</p>", None, "<p>a</p>", "x" * 5000, "x" * 5000]
    parsed = pages.parse_pages(spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html").coalesce(1))
    got = {r.page_id: ([n.tag for n in r.nodes], r.bits) for r in parsed.collect()}
    assert got == {k: ([] if h is None or h[0] == "x" else [h[1]], [] if h is None else [h.strip("<pb/>")] if h[0] == "<" else [h]) for k, h in enumerate(html)}


def test_requests_do_not_carry_a_page_for_each_element(spark):
    import re

    from pagelens.operators import rules
    from pagelens.sources import pages

    html = "<img src=a><video src=b></video><video title=t><source src=c></video><video src=d><track kind=captions></video><audio src='' aria-label=l></audio><img alt=x src=e><img>"
    audited = rules.run_rules(pages.parse_pages(spark.createDataFrame([(1, "u", html), (2, "u", "")], "page_id long, url string, html string")), ["images-alt"])
    asked = enrichment.node_requests(audited)
    plan = asked._jdf.queryExecution().analyzed().toString()
    assert re.search(r"explode\(transform\(filter\(nodes", plan) and not re.search(r"explode\(nodes", plan)
    assert sorted((r.ix, r.cap, r.src, r.label) for r in asked.collect()) == [(1, "describeImage", "a", rules.LABELS["image"]), (2, "transcribe", "b", ""), (3, "transcribe", "c", "t"), (7, "transcribe", "", "l")]
