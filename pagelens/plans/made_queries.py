"""Queries whose pages, texts and audits are made from columns of the given tables, so that DuckDB can work out the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CODE_LABELS, RULES
from ..functions import sqltext
from ..operators import documents, enrichment, packs, reading, rules, scoring
from ..operators.rules import FIXES, FLAGS
from ..sources import audits as store
from ..sources import pages as source
from ..sources import shapes, wire
from ..sources.shapes import SHAPES_SQL, page_parts, shared_folder, table
from .audit_queries import CARD_SQL, audit_card
from .rule_queries import PLANTED, planted_pages


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# What the pages of a whole audit hold: rules and how often, then one of five platforms, of which one says so by its generator.
_OFTEN = {"file-links": "cast(p_partkey % 3 as int)", "images-alt": "cast(p_size % 3 as int)", "form-fields": "cast((p_partkey + p_size) % 3 as int)", "graphs-longdesc": "cast(p_size % 2 as int)"}
_PLATFORM = """case p_partkey % 5 when 0 then '<div id="facets" class="f' || p_size || '">' || p_name || '</div>' when 1 then '<div id="mirador">m</div><div class="uv"></div>' when 2 then '<ul class="resource-list"><li>' || p_name || '</li></ul>'
 when 3 then repeat('<nav class="pager">p</nav>', cast(1 + p_size % 2 as int)) else '' end"""
_WHOLE = " || ".join([f"repeat({PLANTED[r].body}, {n})" for r, n in _OFTEN.items()] + [f"({_PLATFORM})"])
_NAVS = "if(p_partkey % 5 = 3, 1 + p_size % 2, 0)"


def _whole_pages(spark: SparkSession, d: str) -> DataFrame:
    head = F.expr("'<html><head><title>t</title>' || if(p_partkey % 5 = 3, '<meta name=generator content=\"Drupal ' || p_size || '\">', '') || '</head><body><h1>' || p_name || '</h1>'")
    html = F.concat(head, F.expr(_WHOLE), F.lit("</body></html>"))
    return source.parse_pages(page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("https://lib").alias("url"), html.alias("html")))


def run_audit(spark: SparkSession, d: str) -> DataFrame:
    """All rules, then the packs, over pages that hold several defects and a platform: one report."""
    report = rules.audit_report(packs.run_audit(_whole_pages(spark, d), packs.bundled_packs(spark)))
    return report.select("page_id", "pack_id", "code", "kind", F.coalesce("count", F.lit(-1)).cast("long").alias("count"), "msg")


def fixes_applied(spark: SparkSession, d: str) -> DataFrame:
    """What rules and packs changed on each page, in all."""
    audited = packs.run_audit(_whole_pages(spark, d), packs.bundled_packs(spark))
    return scoring.fixes_applied(rules.counts(audited)).select("page_id", F.col("fixes_applied").cast("long").alias("fixes_applied"))


def many_packs(spark: SparkSession, d: str) -> DataFrame:
    """Five hundred packs as JSON files, some of them broken, on pages: by host, by generator, by a class of their own, by a rule that
    sees what an earlier pack set; the changes that they make."""
    place = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    k = F.col("id")
    kinds = F.get(F.array(*[F.lit(x) for x in (
        '{"hosts": ["lib#."], "selectors": []}', '{"generator": "maker-# [0-9]+"}', '{"selectors": ["nav .none, ul > li.c#"]}', '{"generator": "bad(#", "selectors": ["p.c#"]}', '{"hosts": ["lib#."], "selectors": ["li.none"]}',
    )]), (k % 5).cast("int"))
    text = F.concat(F.lit('{"id": "k#", "ord": #, "match": '), kinds, F.lit(', "rules": [{"code": "X1", "level": "A", "describe": "first", "select": "li.c#, li ~ b", "set": {"role": "k#", "tabindex": #}, "remove": ["title"]},'
        '{"select": "[role=\'k#\']:not(b)", "when": {"notRole": "none"}, "set": {"lang": "x#"}}, {"code": "X3", "select": "p::before", "set": {"id": "never"}}]}'))  # fmt: skip
    rows = spark.range(500).select(F.replace(text, F.lit("#"), k.cast("string")).alias("value"))
    rows = rows.unionByName(spark.createDataFrame([('{"title": "no id", "rules": []}',), ('{"id": "none"}',), ("{cut",)], "value string"))
    rows.write.option("maxRecordsPerFile", 1).text(place)
    html = F.expr("""'<html><head><meta name="generator" content="Maker-' || (p_partkey % 500) || ' 2"></head><body><ul><li class="c' || (p_size * 7 % 500) || '" title="t">a</li><b title="u">' || p_name || '</b></ul><p class="c' || (p_size * 3 % 500) || '">b</p></body></html>'""")
    pages = source.parse_pages(page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.expr("'https://lib' || (p_partkey % 50) || '.example'").alias("url"), html.alias("html")))
    out = rules.changes(packs.apply_packs(rules.prepared(pages), packs.read_site_packs(spark, place)))
    return out.where(F.col("attr").isin("role", "tabindex", "title", "lang", "id")).select("page_id", F.col("node_id").cast("long").alias("node_id"), "pack_id", "attr", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("-")).alias("new"))


_SLOTTED = """repeat('<div class="chart toggle">' || p_name || '</div><p>x</p><div class="plot expand" data-target="#t' || p_size || '"></div><b class="toggle">b</b><i id="t' || p_size || '" hidden>i</i>', cast(p_partkey % 3 as int))"""


def slot_targets(spark: SparkSession, d: str) -> DataFrame:
    """Controls that are graphics too: what they control is the description slot put behind them, unless they name another
    element; and attributes that differ from the original once all is undone."""
    html = F.concat(F.lit("<html><head><title>t</title></head><body>"), F.expr(_SLOTTED), F.lit("</body></html>"))
    pages = page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    out = rules.run_rules(source.parse_pages(pages), ["graphs-longdesc", "disclosure"])
    made = rules.changes(out).where("attr in ('aria-controls', 'aria-expanded')").select("page_id", F.col("node_id").cast("long").alias("node_id"), "attr", "new")
    both = rules.undo_changes(out).select("page_id", F.posexplode(F.arrays_zip("original", "nodes")).alias("i", "z"))
    left = both.where(F.to_json("z.original.attrs") != F.to_json("z.nodes.attrs")).select("page_id", F.col("i").cast("long").alias("node_id"), F.lit("left").alias("attr"), F.lit("").alias("new"))
    return made.unionByName(left)


_HOSTED = [
    {"id": "one", "match": {"hosts": ["lib1.", "lib2."]}, "rules": [{"code": "X1", "level": "A", "select": "p", "set": {"role": "note"}}]},
    {"id": "two", "match": {"generator": "drupal [0-9]+"}, "rules": [{"code": "X2", "level": "A", "select": "p + b, i ~ u", "describe": "After others", "fix": lambda x: {"title": sqltext.concat(sqltext.lit("n"), x["ix"].cast("string"))}}]},
    {"id": "off", "enabled": False, "match": {}, "rules": [{"code": "X3", "level": "A", "select": "p", "set": {"role": "x"}}]},
]


def packs_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Own packs by host and by generator, one of them with a rule that is a function, one turned off: their changes."""
    html = "'<html><head><meta name=Generator content=\"' || case when p_size % 2 = 0 then 'Drupal ' || p_size else p_name end || '\"></head><body><p>a</p><b>b</b><i>c</i><s>d</s><u>e</u></body></html>'"
    pages = page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.expr("'https://lib' || (p_partkey % 5) || '.example/'").alias("url"), F.expr(html).alias("html"))
    out = packs.apply_packs(rules.prepared(source.parse_pages(pages)), _HOSTED)
    return rules.changes(out).where(F.col("attr").isin("role", "title")).select("page_id", F.col("node_id").cast("long").alias("node_id"), "pack_id", "attr", "new")


def page_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for words of images and for transcripts of media, over pages with images and pages with media."""
    out = None
    for rule in ("images-alt", "media-captions"):
        rows = enrichment.node_requests(rules.run_rules(source.parse_pages(planted_pages(spark, d, rule)), [rule]))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("page_id", "cap", "src").agg(F.count("*").alias("n"))


_READING = """'<html><head><title>' || case when p_size % 4 = 0 then '' else p_name || ' &amp; more' end || '</title></head><body><header>H</header><nav>n</nav><main><h1>' || p_brand || '</h1><p>Made of <b>' || p_type ||
 '</b> <a href="/f/' || p_size || '.pdf">Data</a></p>' || repeat('<p>Same</p>', cast(1 + p_partkey % 3 as int)) || '<img src="i.png"><img src="j.png" alt="A ' || p_name || '"><img src="k.png" alt=""><div class="chart">Sales</div>' ||
 '<table><caption>' || p_name || '</caption><tr><th>a</th></tr><tr><td>' || p_size || '</td></tr></table><ul><li>x</li><li>' || p_name || '</li></ul><blockquote>Q</blockquote><h2>' || p_type || '</h2><div hidden>no</div><section><span>leaf ' || p_size || '</span></section></main></body></html>'"""


def _reading_pages(spark: SparkSession, d: str) -> DataFrame:
    return source.parse_pages(page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), F.expr(_READING).alias("html")))


def reading_made(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each made page in their order, with what each kind carries."""
    rows = reading.reading_blocks(_reading_pages(spark, d))
    w = F.row_number().over(scoring.Window.partitionBy("page_id").orderBy("ix"))
    text = lambda c: F.coalesce(c, F.lit(""))
    more = F.concat_ws("|", text(F.col("src")), text(F.col("href")), text(F.array_join("items", ",")), text(F.array_join("headers", ",")), text(F.array_join(F.flatten("rows"), ",")), text(F.col("needs_desc").cast("string")))
    return rows.select("page_id", w.cast("long").alias("seq"), "type", F.coalesce("level", F.lit(0)).cast("long").alias("level"), text(F.col("text")).alias("text"), more.alias("more"))


_BLOCKS_SQL = """select p_partkey as page_id, seq::bigint as seq, type, level::bigint as level, text, more from (select *, unnest([
  {'seq': 1, 'type': 'heading', 'level': 1, 'text': p_brand, 'more': '|||||'}, {'seq': 2, 'type': 'para', 'level': 0, 'text': 'Made of ' || p_type || ' Data', 'more': '|||||'},
  {'seq': 3, 'type': 'filelink', 'level': 0, 'text': '', 'more': '|/f/' || p_size || '.pdf||||'}, {'seq': 4, 'type': 'para', 'level': 0, 'text': 'Same', 'more': '|||||'},
  {'seq': 5, 'type': 'image', 'level': 0, 'text': '', 'more': 'i.png|||||true'}, {'seq': 6, 'type': 'image', 'level': 0, 'text': 'A ' || p_name, 'more': 'j.png|||||false'},
  {'seq': 7, 'type': 'graph', 'level': 0, 'text': 'Sales', 'more': '|||||true'}, {'seq': 8, 'type': 'table', 'level': 0, 'text': p_name, 'more': '|||a|' || p_size || '|'},
  {'seq': 9, 'type': 'list', 'level': 0, 'text': '', 'more': '||x,' || p_name || '|||'}, {'seq': 10, 'type': 'quote', 'level': 0, 'text': 'Q', 'more': '|||||'},
  {'seq': 11, 'type': 'heading', 'level': 2, 'text': p_type, 'more': '|||||'}, {'seq': 12, 'type': 'para', 'level': 0, 'text': 'leaf ' || p_size, 'more': '|||||'}], recursive := true) from part)"""


def outline_made(spark: SparkSession, d: str) -> DataFrame:
    rows = reading.outline(reading.reading_blocks(_reading_pages(spark, d)))
    return rows.select("page_id", F.col("seq").cast("long").alias("seq"), F.col("level").cast("long").alias("level"), "text", "slug")


def page_title(spark: SparkSession, d: str) -> DataFrame:
    pages = _reading_pages(spark, d)
    return reading.page_title(pages, reading.reading_blocks(pages))


def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scorecards as nested audits, written to the three tables and read back."""
    card = audit_card(spark, d)
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")).repartition("page_id")
    meta = pages.select("page_id", F.concat(F.lit("Library "), F.col("page_id").cast("string")).alias("dl_name"), F.lit("https://x").alias("dl_url"), F.lit("2026-01-01T00:00:00.000Z").alias("created_at"))
    folder = f"{shared_folder(spark)}/audits-{uuid.uuid4().hex}"
    store.save_assessments(scoring.to_assessment(card, meta), folder)
    got = store.read_audit_tables(spark, folder)
    rows = got["situation_result"].join(got["assessment"].select(F.col("id").alias("assessment_id"), "dl_name"), "assessment_id")
    return scoring.with_rubric(rows).select("dl_name", "code", "level", F.col("auto_score").cast("double").alias("auto_score"), (F.col("meaning").isNotNull()).alias("explained"))


def audits_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested audits as JSON lines, read back: situations of each audit, and the number in the manifest."""
    nested = store.nest_assessments(shapes.assessment(spark, d), shapes.situation_result(spark, d), shapes.evidence(spark, d))
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    store.export_audits_json(nested, folder)
    back = spark.read.schema("id string, dl_url string, situations array<struct<code:string>>").json(f"{folder}/audits")
    many = spark.read.json(f"{folder}/manifest").select(F.col("count").alias("audits"))
    return back.select("id", "dl_url", F.size("situations").cast("long").alias("n")).crossJoin(F.broadcast(many))


def encode_args(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    cells = (wire.encode_value(c("o_orderkey"), "integer"), wire.encode_value(F.when(c("o_orderkey") % 3 != 0, c("o_orderstatus")), "text"), wire.encode_value(c("o_orderkey") % 2 == 0, "boolean"))
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.concat_ws(",", *cells).alias("args"))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, extensions, names, hosts and slugs of columns."""
    text = lambda c: sqltext.column(c)
    href = sqltext.Sql("'/f/' || replace(p_name, ' ', '%20') || '.' || case p_size % 3 when 0 then 'PDF' when 1 then 'docx' else 'exe' end || '?x#y'")
    url = F.expr("case p_size % 3 when 0 then 'http' when 1 then 'HTTP' else 'https' end || '://me@Lib' || p_size || '.Example:80/p'")
    return table(spark, d, "part").select(
        "p_partkey", text(rules.human_size(sqltext.Sql("p_size * 1001"))).alias("size"), F.coalesce(text(rules.file_extension(href)), F.lit("")).alias("ext"), F.coalesce(text(rules.file_type(rules.file_extension(href))), F.lit("")).alias("type"),
        text(rules.name_from_file(href)).alias("file"), wire.host_of(url).alias("host"), wire.upgrade_https(url).alias("url"), documents.safe_name(F.concat("p_name", F.lit("/?"), "p_brand")).alias("safe"), documents.slug(F.concat(F.lit(" "), "p_brand", F.lit("! ")), F.col("p_size")).alias("slug"),
    )


def csv_to_html(spark: SparkSession, d: str) -> DataFrame:
    q = F.lit('"')
    text = F.when(F.col("p_partkey") % 9 == 0, F.lit(" \n,")).otherwise(F.concat(F.lit('name,"<b>"\r\n'), "p_name", F.lit(","), q, "p_brand", F.lit(", "), "p_type", q, F.lit("\n"), F.col("p_size").cast("string"), F.lit(",\n")))
    return table(spark, d, "part").select("p_partkey", documents.csv_to_html(text).alias("html"))


def csv_states(spark: SparkSession, d: str) -> DataFrame:
    """Cells of texts with quotes within cells, control characters, carriage returns in and out of quotes and an end that is missing."""
    q, join = F.lit('"'), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    text = join("a\x01b,", name, q, ",", brand, q, "x\r,", q, q, "\n", " ,\u00a0\n", q, q, q, size, q, q, ",\r\n", q, ",\x02c\n", size, ",", q, "open ", name, "\n")
    cells = documents.csv_to_cells(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return cells.select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


def drifting_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages on which baselines drift: what joins a line depends on its first item, and on which lines there are by then."""
    ys = [700, 698.4, 696.6, 698, 695, 694.5, 702, 703, 701, -1, -2.5, 0.5, -4, -3]
    item = lambda k, y: F.struct(F.lit(k).alias("seq"), F.lit(float(20 - k)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(10 + k)).alias("size"), F.concat(F.lit(f"{k}."), F.col("p_size").cast("string"), F.lit(" ")).alias("str"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 3).cast("int").alias("page"), F.explode(F.array(*[item(k, y) for k, y in enumerate(ys)])).alias("i")).select("doc_id", "page", "i.*")
    return documents.group_text_lines(items).select("doc_id", "page", F.col("line").cast("long").alias("line"), "text", "size")


def content_key_units(spark: SparkSession, d: str) -> DataFrame:
    """Keys of texts with characters beyond the basic plane."""
    return table(spark, d, "customer").select("c_custkey", enrichment.content_key(F.concat(F.lit("\U0001f600é"), "c_name", F.lit("漢\U0001d11e"))).alias("key"))


def text_to_html(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" <&>\r\n\r\n\n"), "p_brand", F.lit("\n"), "p_type")
    return table(spark, d, "part").select("p_partkey", documents.text_to_html(text).alias("html"))


def code_labels(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_label(shapes.report(spark, d)).groupBy("code", "label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (run_audit, fixes_applied, slot_targets, many_packs, packs_by_host, page_requests, reading_made, outline_made, page_title, store_round_trip, audits_json, encode_args, scalar_functions, csv_to_html, csv_states, drifting_lines, content_key_units, text_to_html, code_labels)}

CODES = {r[0]: r[1] for r in RULES}
_LABELS = ", ".join(f"({_q(c)}, {_q(t)})" for c, t in CODE_LABELS.items())
_SIZE = "case when p_size * 1001 < 1024 then (p_size * 1001) || ' bytes' else printf('%.1f KB', p_size * 1001 / 1024.0) end"
ORACLE_SQL = {
    "run_audit": " union all ".join([f"select p_partkey as page_id, '' as pack_id, {_q(CODES[r])} as code, {_q(k)} as kind, ({n})::bigint as count, {m} as msg from (select *, unnest(range({times})) as i from (select *, {often} as n from part))" for r, often in _OFTEN.items() for k, n, m, times in PLANTED[r].report])
      + f""" union all select p_partkey, '', 'COM1', 'fix', 1 + {_NAVS}, {_q(FIXES['landmarks'])} from part union all select p_partkey, '', 'NAV2', 'fix', {_NAVS}, {_NAVS} || {_q(FIXES['pagination'])} from part where p_partkey % 5 = 3
      union all select p_partkey, pack_id, code, 'fix', if(i = 3, {_NAVS}, n), msg from part join (values (0, 'blacklight', 'COM2/NAV1', 1, 'Facet panel is a labelled region'), (1, 'iiif', 'USE1', 2, 'Image/manuscript viewer container is a labelled region'),
        (2, 'omeka', 'ACC4', 1, 'Resource list exposed as a list'), (3, 'islandora', 'NAV2', 1, 'Drupal pager is a labelled nav landmark')) g(i, pack_id, code, n, msg) on i = p_partkey % 5""",
    "fixes_applied": f"select p_partkey as page_id, ({_OFTEN['file-links']} + 3 * {_OFTEN['images-alt']} + 4 * {_OFTEN['form-fields']} + 2 * {_OFTEN['graphs-longdesc']} + 1 + 2 * {_NAVS} + case p_partkey % 5 when 1 then 2 when 3 then {_NAVS} when 4 then 0 else 1 end)::bigint as fixes_applied from part",
    "slot_targets": """select p_partkey as page_id, node::bigint as node_id, attr, new from (select *, unnest(range(p_partkey % 3)) as i from part),
      lateral (select unnest([5, 5, 7, 7, 8, 8]) + 5 * i as node, unnest(['aria-controls', 'aria-expanded', 'aria-controls', 'aria-expanded', 'aria-controls', 'aria-expanded']) as attr,
        unnest(['desc-' || (5 + 5 * i), 'true', 't' || p_size, 'false', 't' || p_size, 'false']) as new)""",
    "many_packs": """with pk as (select k, p.* from range(500) r(k), (select p_partkey, p_size, p_size * 7 % 500 as li, p_size * 3 % 500 as par from part) p
        where case k % 5 when 0 then p_partkey % 50 = k when 1 then p_partkey % 500 = k when 2 then li = k when 3 then par = k else false end),
      b as (select *, row_number() over (partition by p_partkey order by k) as nth, lag(k) over (partition by p_partkey order by k) as before, max(case when k = li then k end) over (partition by p_partkey order by k rows between unbounded preceding and 1 preceding) as own from pk),
      c as (select *, unnest(case when k = li then [{'node': 6, 'attr': 'role', 'old': '', 'new': 'k' || k}, {'node': 6, 'attr': 'tabindex', 'old': '', 'new': k::varchar}, {'node': 6, 'attr': 'title', 'old': 't', 'new': '-'}] else [] end
        || [{'node': 7, 'attr': 'role', 'old': coalesce('k' || before, ''), 'new': 'k' || k}, {'node': 7, 'attr': 'tabindex', 'old': coalesce(before::varchar, ''), 'new': k::varchar}] || case when nth = 1 then [{'node': 7, 'attr': 'title', 'old': 'u', 'new': '-'}] else [] end
        || case when k = li then [{'node': 6, 'attr': 'lang', 'old': '', 'new': 'x' || k}] else [] end, recursive := true) from b)
      select p_partkey as page_id, node::bigint as node_id, 'k' || k as pack_id, attr, old, new from c""",
    "packs_by_host": """select p_partkey as page_id, 5::bigint as node_id, 'one' as pack_id, 'role' as attr, 'note' as new from part where p_partkey % 5 in (1, 2)
      union all select p_partkey, k, 'two', 'title', 'n' || (k - 5) from part, (values (6::bigint), (9)) v(k) where p_size % 2 = 0""",
    "page_requests": """with p as (select p_partkey as page_id, p_partkey % 3 as n from part where p_partkey % 3 > 0)
      select page_id, 'describeImage' as cap, src, n::bigint as n from p, (values ('a.png'), ('b.png')) v(src) union all select page_id, 'transcribe', src, n from p, (values ('v'), ('a')) v(src)""",
    "reading_made": _BLOCKS_SQL,
    "outline_made": """select p_partkey as page_id, seq::bigint as seq, level::bigint as level, text, 'rr-' || replace(lower(text), '#', '-') || '-' || seq as slug from (
      select p_partkey, 0 as seq, 1 as level, p_brand as text from part union all select p_partkey, 1, 2, p_type from part)""",
    "page_title": "select p_partkey as page_id, case when p_size % 4 = 0 then p_brand else p_name || ' & more' end as title from part",
    "store_round_trip": f"with {SHAPES_SQL}, {CARD_SQL} select 'Library ' || page_id as dl_name, code, level, case when good + violations > 0 then greatest(1, least(7, floor(1 + 6 * good / (good + violations) + 0.5)))::double end as auto_score, good + violations > 0 as explained from card",
    "audits_json": f"with {SHAPES_SQL} select a.id, a.dl_url, count(s.id)::bigint as n, (select count(*) from assessment) as audits from assessment a left join situation_result s on s.assessment_id = a.id group by 1, 2",
    "encode_args": """select o_orderkey as id, '{"type":"integer","value":"' || o_orderkey || '"},' || case when o_orderkey % 3 <> 0 then '{"type":"text","value":"' || o_orderstatus || '"}' else '{"type":"null"}' end || ',{"type":"integer","value":"' || (1 - o_orderkey % 2) || '"}' as args from orders""",
    "scalar_functions": f"""select p_partkey, {_SIZE} as size, ['pdf', 'docx', 'exe'][1 + p_size % 3] as ext, ['PDF', 'Word', ''][1 + p_size % 3] as type, p_name as file, 'lib' || p_size || '.example' as host, 'https://me@Lib' || p_size || '.Example:80/p' as url,
      replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '_') as safe, 'rr-' || replace(lower(p_brand), '#', '-') || '-' || p_size as slug from part""",
    "csv_to_html": """select p_partkey, case when p_partkey % 9 = 0 then '<p>Empty file.</p>' else '<table lang="en"><caption>Imported spreadsheet data</caption><thead><tr><th scope="col">name</th><th scope="col">&lt;b&gt;</th></tr></thead><tbody><tr><th scope="row">' || p_name ||
      '</th><td>' || p_brand || ', ' || p_type || '</td></tr><tr><th scope="row">' || p_size || '</th><td></td></tr></tbody></table>' end as html from part""",
    "csv_states": """select p_partkey as doc_id, r::bigint as row, c::bigint as col, value from (select *, unnest([0, 0, 0, 1, 1, 2, 2]) as r, unnest([0, 1, 2, 0, 1, 0, 1]) as c,
      unnest(['a' || chr(1) || 'b', p_name || ',' || p_brand || 'x', '', '"' || p_size || '",' || chr(13) || chr(10), chr(2) || 'c', p_size::varchar, 'open ' || p_name || chr(10)]) as value from part)""",
    "drifting_lines": """select p_partkey as doc_id, (p_partkey % 3)::int as page, line::bigint as line, array_to_string(list_transform(seqs, lambda k: k || '.' || p_size), ' ') as text, (10 + list_sort(seqs)[1 + len(seqs) // 2])::double as size
      from part, (values (1, [8, 7]), (2, [6, 3, 1, 0]), (3, [5, 4, 2]), (4, [11, 10, 9]), (5, [13, 12])) v(line, seqs)""",
    "content_key_units": """select c_custkey, printf('%08x', list_reduce([2166136261::bigint, 55357, 56832, 233] || list_transform(string_split(c_name, ''), lambda c: ascii(c)::bigint) || [28450::bigint, 55348, 56606], lambda a, c: (xor(a, c) * 16777619) % 4294967296)) as key from customer""",
    "text_to_html": "select p_partkey, '<article lang=\"en\"><h1>Text document</h1><p>' || p_name || ' &lt;&amp;&gt;</p><p>' || p_brand || '<br>' || p_type || '</p></article>' as html from part",
    "code_labels": f"""with {SHAPES_SQL}, l(token, label) as (values {_LABELS}), c as (select code, count(*) as n from report group by code),
      t as (select code, unnest(string_split(code, '/')) as token, unnest(range(len(string_split(code, '/')))) as i from c), b as (select code, arg_min(label, i) as label from t join l using (token) group by code)
      select code, coalesce(label, code) as label, n from c left join b using (code)""",
}
