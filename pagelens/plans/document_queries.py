"""Queries over documents, captions, enrichment, wire payloads, the catalogue and streams, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, documents, enrichment, reading
from ..sources import pages as source
from ..sources import shapes, wire
from ..sources.shapes import SHAPES_SQL, shared_folder, table
from ..streaming import audits as stream


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents as positioned text: ten to a line, forty lines to a page, every 17th line large."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.trim("text"), "[ \n]+")).alias("p", "str"))
    line = F.floor(F.col("p") / 10).cast("int")
    rows = words.withColumn("l", line)
    return rows.select("doc_id", F.floor(F.col("l") / 40).cast("int").alias("page"), F.col("p").alias("seq"), ((F.col("p") % 10) * 50).cast("double").alias("x"), (780 - (F.col("l") % 40) * 18 + (F.col("p") % 3) * 0.5).alias("y"), F.when(F.col("l") % 17 == 0, 20.0).otherwise(10.0).alias("size"), "str")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.group_text_lines(_items(spark, d))


def _doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    return documents.build_paragraphs(documents.classify_lines(_lines(spark, d), documents.body_size(_items(spark, d))))


def render_html(spark: SparkSession, d: str) -> DataFrame:
    nodes = _doc_nodes(spark, d)
    return documents.render_html(nodes, documents.document_title(nodes)).select("doc_id", F.md5("html").alias("html_md5"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2.25).alias("end"), "text")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    cap = F.get(F.array(*[F.lit(c) for c in ("ocr", "describeImage", "describeGraph", "transcribe")]), (F.col("doc_id") % 4).cast("int"))
    return enrichment.with_key(table(spark, d, "documents").select("doc_id", cap.alias("cap"), F.col("text").alias("hash_source"), F.col("source").alias("src"), F.lit("").alias("label")))


def _planned(spark: SparkSession, d: str) -> DataFrame:
    providers = spark.createDataFrame([("ocr", "p", True, "auto"), ("describeImage", "p", True, "ask"), ("describeGraph", "p", True, "off"), ("transcribe", "p", False, "auto")], "cap string, name string, available boolean, policy string")
    requests = _requests(spark, d)
    cache = requests.where("doc_id % 10 = 0").select("key").distinct()
    return enrichment.plan_requests(requests, providers, cache)


def wire_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Situation rows as pipeline results, decoded again."""
    cell = lambda c, kind: F.when(c.isNull(), F.struct(F.lit("null").alias("type"), F.lit(None).cast("string").alias("value"))).otherwise(F.struct(F.lit(kind).alias("type"), c.cast("string").alias("value")))
    rows = shapes.situation_result(spark, d)
    cells = F.array(cell(F.col("code"), "text"), cell(F.col("compliance_score"), "integer"), cell(F.col("auto_score") / 2, "float"))
    cols = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("code", "score", "half")])
    result = F.struct(F.lit("execute").alias("type"), F.struct(cols.alias("cols"), F.array(cells).alias("rows")).alias("result"))
    payload = rows.select("id", F.to_json(F.array(F.struct(F.lit("ok").alias("type"), result.alias("response")))).alias("payload"))
    out = wire.decode_pipeline_results(wire.parse_results(payload))
    return out.select("id", F.col("values")["code"].alias("code"), F.col("values")["score"].cast("double").alias("score"), F.col("values")["half"].cast("double").alias("half"))


def wire_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit('[{"type":"error","error":{"message":"no such table"}},{"type":"error"}]')).when(F.col("o_orderkey") % 3 == 1, F.lit('[{"type":"ok"},{"type":"error"}]')).otherwise("not json").alias("payload"))
    return wire.decode_pipeline_errors(wire.parse_results(rows)).select("id", F.col("stmt").cast("long").alias("stmt"), "message")


def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    raw = F.get(F.array(F.concat(F.lit("libsql://x"), key, F.lit(".io/")), F.concat(F.lit(" x"), key, F.lit(".io")), F.concat(F.lit("https://x"), key, F.lit(".io")), F.lit("")), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), wire.normalize_url(raw).alias("url"))


def csv_to_cells(spark: SparkSession, d: str) -> DataFrame:
    q = F.lit('"')
    text = F.concat(F.lit('name,"note, with ""quotes"""\r\n'), F.col("p_name"), F.lit(","), q, F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit("\nmore"), q, F.lit("\n,\n"), F.col("p_partkey").cast("string"), F.lit(","))
    cells = documents.csv_to_cells(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return cells.select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value", F.coalesce("scope", F.lit("")).alias("scope"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue entry per part: situations in turn, some with a wrong level, an unknown rule or state."""
    k = F.col("p_partkey")
    sits = F.broadcast(shapes.situations(spark))
    pick = lambda xs, m: F.get(F.array(*[F.lit(x) for x in xs]), (k % m).cast("int"))
    base = table(spark, d, "part").withColumn("ix", (k % 20).cast("int")).join(sits, "ix")
    guideline = F.struct(F.col("p_name").alias("text"), pick(catalogue.CLASSES, 3).alias("classification"), F.coalesce(pick(catalogue.STATUSES, 6), F.lit("lost")).alias("status"), F.lit("").alias("rationale"), F.struct(F.col("p_name").alias("name"), F.array(F.lit("a page"), F.lit("a reader")).alias("given"), F.array(F.lit("it opens")).alias("when"), F.array(F.lit("it is named")).alias("then")).alias("scenario"))
    return base.select("code", F.col("p_name").alias("title"), F.when(k % 50 == 7, "X").otherwise(F.col("level")).alias("level"), F.array(F.when(k % 40 == 3, "no-such-rule").otherwise("file-links")).alias("engine_rules"), F.struct(F.lit("a reader").alias("role"), F.lit("names").alias("feature"), F.lit("I can read").alias("benefit")).alias("user_story"), F.lit(None).cast(f"array<{catalogue.SCENARIO}>").alias("core"), F.array(guideline).alias("guidelines"), k.alias("part"))


def stream_compliance(spark: SparkSession, d: str) -> DataFrame:
    """The running aggregate over events as a stream of audits, read back when all of them have come."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = events.select(F.col("event_type").alias("code"), (F.col("user_id") % 40).cast("string").alias("level"), F.when(F.col("event_id") % 7 != 0, 1 + F.floor(F.abs("value")) % 7).alias("compliance_score"))
    place = f"{shared_folder(spark)}/compliance-{uuid.uuid4().hex}"
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/now")
    stream.compliance(rows).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/now")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_blocks(source.parse_pages(table(spark, d, "pages")))


QUERIES = {
    "group_text_lines": lambda s, d: _lines(s, d).select("doc_id", "page", F.col("line").cast("int").alias("line"), "text", "size"),
    "doc_nodes": lambda s, d: _doc_nodes(s, d).select("doc_id", F.col("ix").cast("long").alias("ix"), "type", F.coalesce("level", F.lit(0)).cast("long").alias("level"), "text"),
    "render_html": render_html,
    "text_to_paragraphs": lambda s, d: documents.text_to_paragraphs(table(s, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n\n")))).select("doc_id", F.col("ix").cast("long").alias("ix"), "paragraph"),
    "csv_to_cells": csv_to_cells,
    "segments_to_vtt": lambda s, d: documents.segments_to_vtt(_segments(s, d)),
    "transcript_text": lambda s, d: documents.transcript_text(_segments(s, d)),
    "content_key": lambda s, d: table(s, d, "customer").select("c_custkey", enrichment.content_key(F.col("c_name")).alias("key")),
    "plan_requests": lambda s, d: _planned(s, d).select("doc_id", "cap", "state", "note"),
    "enrichment_status": lambda s, d: enrichment.enrichment_status(_planned(s, d)),
    "wire_round_trip": wire_round_trip,
    "wire_errors": wire_errors,
    "normalize_url": normalize_url,
    "guideline_matrix": lambda s, d: catalogue.guideline_matrix(catalogue.guideline_rows(_catalogue(s, d))),
    "check_catalogue": lambda s, d: catalogue.check_catalogue(_catalogue(s, d)).groupBy("problem", "code", "detail").agg(F.count("*").alias("n")),
    "render_features": lambda s, d: catalogue.render_features(_catalogue(s, d)),
    "stream_compliance": stream_compliance,
    "reading_blocks": lambda s, d: _blocks(s, d).select("page_id", "type", F.coalesce("level", F.lit(0)).cast("long").alias("level"), "text"),
    "outline": lambda s, d: reading.outline(_blocks(s, d)).select("page_id", F.col("seq").cast("long").alias("seq"), F.col("level").cast("long").alias("level"), "text", "slug"),
}

_WORDS = "w as (select doc_id, unnest(ws) as str, unnest(range(len(ws))) as p from (select doc_id, regexp_split_to_array(trim(text, ' '), '[ \\n]+') as ws from documents))"
_LINES = f"""{_WORDS}, ln as (select doc_id, p // 10 // 40 as page, p // 10 as l, trim(string_agg(str, '' order by p)) as text, case when (p // 10) % 17 = 0 then 20.0 else 10.0 end as size
  from w where trim(str) <> '' group by all),
lines as (select doc_id, page, row_number() over (partition by doc_id, page order by l) as line, text, size from ln where text <> '')"""
_NODES = f"""{_LINES}, body as (select doc_id, list_sort(list(case when (p // 10) % 17 = 0 then 20.0 else 10.0 end))[1 + floor(count(*) / 2)::int] as body from w where trim(str) <> '' group by doc_id),
k as (select l.*, case when size / body >= 1.25 and length(text) < 120 then case when size / body >= 1.9 then 1 when size / body >= 1.5 then 2 else 3 end end as level from lines l join body using (doc_id)),
m as (select *, case when level is not null or lag(level) over q is not null or regexp_matches(lag(text) over q, '[.!?:]$') or lag(page) over q <> page or lag(page) over q is null then 1 else 0 end as new from k window q as (partition by doc_id order by page, line)),
b as (select *, sum(new) over (partition by doc_id order by page, line rows unbounded preceding) as ix from m),
nodes as (select doc_id, ix::bigint as ix, case when max(level) is null then 'p' else 'h' end as type, coalesce(max(level), 0)::bigint as level, string_agg(text, ' ' order by page, line) as text from b group by doc_id, ix)"""
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_VTT = "printf('%02d:%02d:%02d.%03d', (floor({0} / 3600))::int, floor(({0} % 3600) / 60)::int, floor({0} % 60)::int, floor(({0} - floor({0})) * 1000)::int)"
_REQ = "req as (select doc_id, ['ocr', 'describeImage', 'describeGraph', 'transcribe'][1 + (doc_id % 4)::int] as cap, text from documents), cached as (select distinct cap, text from req where doc_id % 10 = 0), pl as (select r.doc_id, r.cap, case when c.cap is not null then 'done' when r.cap in ('describeGraph', 'transcribe') then 'skipped' when r.cap = 'describeImage' then 'held' else 'queued' end as state, case when c.cap is not null then '' when r.cap = 'transcribe' then 'no provider configured' when r.cap = 'describeGraph' then 'turned off' when r.cap = 'describeImage' then 'waiting for you to run it' else '' end as note from req r left join cached c on c.cap = r.cap and c.text = r.text)"
_CAT = "cat as (select p.*, code, level from part p join sit on ix = p_partkey % 20)"

# HTML reads these names of characters without their semicolon too, as in a heading that is cut within one.
_NAMES = {"&lt;?": "'<'", "&gt;?": "'>'", "&quot;?": "chr(34)", "&#39;": "chr(39)", "&nbsp;?": "chr(160)", "&amp;?": "'&'"}
_ENTITIES = ", ".join(f"'{name}', {char}, 'g')" for name, char in _NAMES.items())
_BLANKS = r"'[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
_CLEAN = "trim(regexp_replace(" + "regexp_replace(" * len(_NAMES) + "regexp_replace({}, '<[^>]*>', '', 'g'), " + _ENTITIES + f", {_BLANKS.replace('{', '{{').replace('}', '}}')}, ' ', 'g'))"
#: The given pages hold an article with a heading and paragraphs, some of which nobody closes.
_ARTICLE = f"""art as (select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as t from pages),
head as (select page_id, {_CLEAN.format("regexp_extract(t, '(?s)<h1>(.*?)</h1>', 1)")} as text from art),
para as (select distinct page_id, {_CLEAN.format("p")} as text from (select page_id, unnest(string_split(t, '<p>')[2:]) as p from art))"""

ORACLE_SQL = {
    "group_text_lines": f"with {_LINES} select doc_id, page::int as page, line::int as line, text, size::double as size from lines",
    "doc_nodes": f"with {_NODES} select doc_id, ix, type, level, text from nodes",
    "render_html": f"""with {_NODES}, t as (select doc_id, coalesce(arg_min(text, ix) filter (type = 'h'), 'Untitled document') as title from nodes group by doc_id),
      o as (select doc_id, string_agg('<' || case type when 'h' then 'h' || (level + 1) else 'p' end || '>' || {_ESC.format('text')} || '</' || case type when 'h' then 'h' || (level + 1) else 'p' end || '>', chr(10) order by ix) as body from nodes group by doc_id)
      select doc_id, md5('<article lang="en">' || chr(10) || '<h1>' || {_ESC.format('title')} || '</h1>' || chr(10) || body || chr(10) || '</article>') as html_md5 from t join o using (doc_id)""",
    "text_to_paragraphs": "select doc_id, unnest(range(len(ps)))::bigint as ix, unnest(ps) as paragraph from (select doc_id, regexp_split_to_array(text, '\\n+') as ps from documents)",
    "csv_to_cells": """select p_partkey as doc_id, r::bigint as row, c::bigint as col, value, case when r = 0 then 'col' when c = 0 then 'row' else '' end as scope from (
      select p_partkey, unnest([0, 0, 1, 1, 2, 2]) as r, unnest([0, 1, 0, 1, 0, 1]) as c, unnest(['name', 'note, with "quotes"', p_name, p_brand || ', ' || p_type || chr(10) || 'more', p_partkey::varchar, '']) as value from part)""",
    "segments_to_vtt": f"select conv_id as media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {_VTT.format('(turn * 2.5)')} || ' --> ' || {_VTT.format('(turn * 2.5 + 2.25)')} || chr(10) || trim(text) || chr(10), chr(10) order by turn, text) as vtt from (select *, row_number() over (partition by conv_id order by turn, text) as n from conversations) group by conv_id",
    "transcript_text": "select conv_id as media_id, trim(string_agg(trim(text), ' ' order by turn, trim(text))) as text from conversations group by conv_id having trim(string_agg(trim(text), ' ')) <> ''",
    "content_key": "select c_custkey, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(c_name, ''), lambda c: ascii(c)::bigint)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)) as key from customer",
    "plan_requests": f"with {_REQ} select * from pl",
    "enrichment_status": f"with {_REQ} select cap, state, count(*) as n from pl group by all",
    "wire_round_trip": f"with {SHAPES_SQL} select id, code, compliance_score::double as score, auto_score / 2 as half from situation_result",
    "wire_errors": "select o_orderkey as id, 0::bigint as stmt, 'no such table' as message from orders where o_orderkey % 3 = 0",
    "normalize_url": "select o_orderkey as id, case when o_orderkey % 4 = 3 then '' else 'https://x' || o_orderkey || '.io' end as url from orders",
    "guideline_matrix": "with g as (select ['algorithmic', 'hybrid', 'manual'][1 + (p_partkey % 3)::int] as c, coalesce(['app-layer', 'implemented', 'manual', 'proposed', 'service'][1 + (p_partkey % 6)::int], 'lost') as s from part) select 'classification' as dimension, c as value, count(*) as n from g group by c union all select 'status', s, count(*) from g group by s union all select 'total', 'all', count(*) from g",
    "check_catalogue": f"with {SHAPES_SQL}, {_CAT} select problem, code, detail, count(*) as n from (select 'missing token' as problem, code, unnest(string_split(code, '/')) as detail from sit where ix >= 20 union all select 'unknown rule', code, 'no-such-rule' from cat where p_partkey % 40 = 3 union all select 'level', code, 'X ' || level from cat where p_partkey % 50 = 7 union all select 'status', code, 'lost' from cat where p_partkey % 6 = 5) group by all",
    "render_features": f"with {SHAPES_SQL}, {_CAT} select code, 'Feature: ' || p_name || chr(10) || '  As a reader' || chr(10) || '  I want names' || chr(10) || '  So that I can read' || chr(10) || chr(10) || '  Scenario: ' || p_name || chr(10) || '    Given a page' || chr(10) || '    And a reader' || chr(10) || '    When it opens' || chr(10) || '    Then it is named' as feature from cat",
    "stream_compliance": "select event_type as code, (user_id % 40)::varchar as level, avg(s) as avg_score, count(*) as n from (select *, 1 + floor(abs(value))::bigint % 7 as s from events where event_id % 7 <> 0) where s is not null group by 1, 2",
    "reading_blocks": f"with {_ARTICLE} select page_id, 'heading' as type, 1::bigint as level, text from head where text <> '' union all select page_id, 'para', 0, text from para where text <> ''",
    "outline": f"""with {_ARTICLE}, s as (select *, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) as base from head where text <> '')
      select page_id, 0::bigint as seq, 1::bigint as level, text, 'rr-' || case when base = '' then 'sec' else base end || '-0' as slug from s""",
}
