"""Queries over what is stored, streamed in or read from files, with their DuckDB SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import DESCRIPTIONS, RULES, rules_catalog
from ..operators import catalogue, enrichment, packs, reading
from ..sources import audits as store
from ..sources import pages as source
from ..sources import shapes
from ..sources.shapes import SHAPES_SQL, page_parts, shared_folder, table
from ..streaming import audits as stream
from .rule_queries import ORACLE_SQL as ORACLE_OF_RULES
from .rule_queries import planted_pages

#: One audit an event, in three batches. Four events that follow each other share an id, so repeats meet within a batch and later;
#: some times are long past, some are no times, and every eleventh line is cut off.
_AUDIT_TEXT = """'{"id": "e' || (event_id div 4) || '", "dl_url": "https://u' || user_id || '", "created_at": ' || case when event_type = 'error' then '"no time"' when user_id % 7 = 0 then '"1999-01-01T00:00:00Z"' when user_id % 7 = 1 then 'null'
 else '"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") || '"' end || ', "other": {"k": [1]}, "situations": [{"code": "ACC1", "compliance_score": ' || (1 + user_id % 7) || '}, {"code": "NAV2"}]}'"""


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after three batches of audits of which the second comes again: first audit of each id, and the rejected lines."""
    text = F.expr(_AUDIT_TEXT)
    lines = table(spark, d, "events").select((F.col("event_id") % 3).alias("b"), F.when(F.col("event_id") % 11 == 0, F.substring(text, 1, 30)).otherwise(text).alias("value"))
    place = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for b in range(3):
        lines.where(F.col("b") == b).select("value").write.mode("append").text(f"{place}/in")
        stream.stream_audit_ingest(spark.readStream.text(f"{place}/in"), f"{place}/store", f"{place}/state").awaitTermination()
    stream.ingest(lines.where("b = 1").select("value"), 1, f"{place}/store")
    got = store.read_audit_tables(spark, f"{place}/store")
    rows = got["situation_result"].join(got["assessment"].withColumnRenamed("id", "assessment_id"), "assessment_id").where("code = 'ACC1'")
    both = got["situation_result"].groupBy("assessment_id").agg(F.count("*").alias("n"))
    timed = F.when(F.to_date(F.substring("created_at", 1, 10)) >= F.current_date() - 1, "now").otherwise(F.col("created_at"))
    stored = rows.join(both, "assessment_id").select(F.col("assessment_id").alias("id"), "dl_url", F.when(F.col("created_at") == "no time", F.col("created_at")).otherwise(timed).alias("created_at"), F.col("compliance_score").cast("long").alias("score"), "n")
    bad = spark.read.parquet(f"{place}/store/rejected").select(F.lit("").alias("id"), F.col("value").alias("dl_url"), F.lit("").alias("created_at"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("n"))
    return stored.unionByName(bad)


_FINDINGS_TEXT = """case l_linenumber when 1 then '{"violations": [{"msg": "m' || l_partkey || '", "count": ' || l_suppkey || ', "kind": "fix"}], "goodTechniques": [{"msg": "g", "count": "' || l_partkey || '"}], "extra": [1, {"a": null}]}'
 when 2 then '{"violations": [{"msg": "m", "count": "many"}, {"note": true, "count": 2.0}, 7]}' when 3 then '{"violations": [{"msg": "cut' when 4 then '[' || l_partkey || ']' when 5 then '' when 6 then '{}' end"""


def findings_text(spark: SparkSession, d: str) -> DataFrame:
    """Findings stored as JSON text, of which some are broken, have other shapes or unknown fields: entries, and what could not be read."""
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("ACC1").alias("code"), F.expr(_FINDINGS_TEXT).alias("auto_findings"))
    head = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.expr("""'{"violations": ' || o_custkey || case when o_orderkey % 2 = 0 then ', "good": null}' else '}' end""").alias("auto_summary"))
    place = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    for name, df in (("situation_result", rows), ("assessment", head), ("evidence", spark.createDataFrame([], store.SCHEMAS["evidence"]))):
        df.write.parquet(f"{place}/{name}")
    got = store.read_audit_tables(spark, place)
    entry = lambda kind, x: F.struct(F.lit(kind).alias("list"), x["msg"].alias("msg"), x["count"].alias("count"))
    s = got["situation_result"]
    each = s.select("id", F.explode(F.concat(F.transform(F.coalesce("auto_findings.violations", F.array()), lambda x: entry("violations", x)), F.transform(F.coalesce("auto_findings.goodTechniques", F.array()), lambda x: entry("good", x)))).alias("e"))
    text = lambda c: F.coalesce(c, F.lit("-"))
    out = each.select("id", F.col("e.list").alias("list"), text(F.col("e.msg")).alias("msg"), F.coalesce("e.count", F.lit(-1)).alias("count"))
    out = out.unionByName(s.where("auto_findings_text is not null").select("id", F.lit("text").alias("list"), F.col("auto_findings_text").alias("msg"), F.lit(0).cast("long").alias("count")))
    return out.unionByName(got["assessment"].select("id", F.lit("summary").alias("list"), F.lit("").alias("msg"), (F.col("auto_summary.violations") + F.coalesce("auto_summary.good", F.lit(0))).alias("count")))


def get_assessment(spark: SparkSession, d: str) -> DataFrame:
    """One audit with its situations, by its id: that of the largest order."""
    last = table(spark, d, "orders").agg(F.max("o_orderkey").cast("string")).first()[0]
    nested = store.nest_assessments(shapes.assessment(spark, d), shapes.situation_result(spark, d), shapes.evidence(spark, d))
    one = store.get_assessment(nested, last)
    return one.select("id", "dl_url", F.explode_outer("situations").alias("s")).select("id", "dl_url", "s.code", F.coalesce("s.compliance_score", F.lit(0)).cast("long").alias("score"), F.size("s.evidence").cast("long").alias("evidence"))


def rules_described(spark: SparkSession, d: str) -> DataFrame:
    """Findings by rule, with what the rule does."""
    known = rules_catalog(spark).select("rule_ix", "rule_id", "describe")
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 22).cast("int").alias("rule_ix")).groupBy("rule_ix").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(known), "rule_ix").select("rule_id", F.col("describe").alias("description"), "n")


def guidelines_read(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue written as JSON files and read back: each guideline with its state."""
    guideline = F.struct(F.col("p_name").alias("text"), F.get(F.array(*map(F.lit, catalogue.CLASSES)), (F.col("p_size") % 3).cast("int")).alias("classification"), F.lit("proposed").alias("status"), F.col("p_brand").alias("rationale"))
    rows = table(spark, d, "part").groupBy((F.col("p_partkey") % 20).alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", guideline.alias("g")))).alias("gs"))
    place = f"{shared_folder(spark)}/guidelines-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit("C"), F.col("k").cast("string")).alias("code"), F.transform("gs", lambda x: x["g"]).alias("guidelines"), F.lit(1).alias("other")).write.option("maxRecordsPerFile", 1).json(place)
    got = catalogue.guideline_rows(catalogue.read_guidelines(spark, place))
    return got.select("code", F.col("ix").cast("long").alias("ix"), "text", "classification", "status", "rationale")


def latest_packs(spark: SparkSession, d: str) -> DataFrame:
    """Of several versions of a pack the newest."""
    rows = table(spark, d, "part").select(F.concat(F.lit("k"), (F.col("p_partkey") % 40).cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("at"))
    return packs.latest_packs(rows, "at").select("id", "title")


def contents_made(spark: SparkSession, d: str) -> DataFrame:
    """Contents of pages with three headings or more."""
    html = F.expr("'<main>' || concat_ws('', transform(sequence(1, 1 + cast(p_size % 5 as int)), i -> '<h' || (1 + i % 3) || '>' || p_name || ' ' || i || '</h' || (1 + i % 3) || '>')) || '</main>'")
    pages = source.parse_pages(page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html")))
    return reading.contents(reading.outline(reading.reading_blocks(pages))).select("page_id", F.col("seq").cast("long").alias("seq"), "entry")


def stream_page_audit(spark: SparkSession, d: str) -> DataFrame:
    """Report rows of pages that came as a stream in two batches."""
    place = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages = planted_pages(spark, d, "landmarks").select("page_id", "url", "html")
    for b in range(2):
        pages.where(F.col("page_id") % 2 == b).write.mode("append").parquet(f"{place}/in")
        stream.stream_page_audit(spark.readStream.schema(pages.schema).parquet(f"{place}/in"), f"{place}/out", f"{place}/state", ["landmarks"]).awaitTermination()
    return spark.read.parquet(f"{place}/out").select("page_id", "kind", F.coalesce("count", F.lit(-1)).cast("long").alias("count"), "msg")


def enrichment_runs(spark: SparkSession, d: str) -> DataFrame:
    """How requests end after two runs against a service that fails on some keys, the second time on fewer: what succeeded in the first
    run keeps its words."""
    c = F.col("c_custkey")
    cap = F.get(F.array(*[F.lit(x) for x in ("describeImage", "ocr", "transcribe")]), (F.floor(c / 2) % 3).cast("int"))
    name = F.floor(c / 2).cast("string")
    requests = enrichment.with_key(table(spark, d, "customer").select("c_custkey", cap.alias("cap"), F.concat(F.lit("s"), name).alias("src"), F.concat(F.lit("L"), name).alias("label"), F.concat(F.lit("n"), name).alias("hash_source")))
    place = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"

    def service(run: int, fails: str):
        def batches(rows):
            for b in rows:
                bad = b["key"].str[-1].isin(list(fails))
                yield b[["key"]].assign(result=(f"{run}:" + b["label"]).where(~bad, None), error=pd.Series("busy", b.index).where(bad, None))

        return batches

    out = None
    for run, fails in ((1, "01234567"), (2, "0123")):
        known = enrichment.Providers(describeImage="auto").register(enrichment.Registered("describeImage", "made", service(run, fails))).register(enrichment.Registered("ocr", "made", service(run, "")))
        out = enrichment.run_enrichment(requests, known, place, str(run))
    return out.select("c_custkey", "cap", "state", "note", F.coalesce("result", F.lit("")).alias("result"), F.coalesce("provider", F.lit("")).alias("provider"))


QUERIES = {f.__name__: f for f in (stream_ingest, findings_text, get_assessment, rules_described, guidelines_read, latest_packs, contents_made, stream_page_audit, enrichment_runs)}

_KEY = "printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('n' || (c_custkey // 2), ''), lambda c: ascii(c)::bigint)), lambda a, c: (xor(a, c) * 16777619) % 4294967296))"
_RULES = ", ".join(f"({i}, '{r[0]}', '{DESCRIPTIONS[r[0]].replace(chr(39), chr(39) * 2)}')" for i, r in enumerate(RULES))

_AUDIT_TEXT_SQL = _AUDIT_TEXT.replace("event_id div 4", "event_id // 4").replace("""date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")""", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")
ORACLE_SQL = {
    "stream_ingest": f"""with l as (select event_id, event_id % 3 as b, user_id, case when event_type = 'error' then 'no time' when user_id % 7 = 0 then '1999-01-01T00:00:00Z' when user_id % 7 <> 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as made, {_AUDIT_TEXT_SQL} as line from events),
      r as (select *, row_number() over (partition by event_id // 4 order by b, made nulls last, line) as n from l where event_id % 11 <> 0)
      select 'e' || (event_id // 4) as id, 'https://u' || user_id as dl_url, coalesce(made, 'now') as created_at, (1 + user_id % 7)::bigint as score, 2::bigint as n from r where n = 1
      union all select '', line[1:30], '', 0, 0 from l where event_id % 11 = 0""",
    "get_assessment": f"""with {SHAPES_SQL} select a.id, a.dl_url, s.code, coalesce(s.compliance_score, 0)::bigint as score, (select count(*) from evidence e where e.situation_result_id = s.id) as evidence
      from assessment a left join situation_result s on s.assessment_id = a.id where a.id = (select max(o_orderkey)::varchar from orders)""",
    "rules_described": f"select rule_id, description, count(*) as n from lineitem join (values {_RULES}) r(ix, rule_id, description) on ix = l_partkey % 22 group by all",
    "guidelines_read": """select 'C' || (p_partkey % 20) as code, row_number() over (partition by p_partkey % 20 order by p_partkey) - 1 as ix, p_name as text, ['algorithmic', 'hybrid', 'manual'][1 + p_size % 3] as classification, 'proposed' as status, p_brand as rationale from part""",
    "latest_packs": "select 'k' || (p_partkey % 40) as id, arg_max(p_name, p_partkey) as title from part group by 1",
    "contents_made": "select p_partkey as page_id, (i - 1)::bigint as seq, repeat('  ', (i % 3)::int) || p_name || ' ' || i as entry from (select *, unnest(range(1, 2 + p_size % 5)) as i from part) where p_size % 5 >= 2",
    "stream_page_audit": ORACLE_OF_RULES["planted_landmarks"].join(["select page_id, kind, count, msg from (", ")"]),
    "enrichment_runs": f"""with r as (select c_custkey, c_custkey // 2 as n, ['describeImage', 'ocr', 'transcribe'][1 + c_custkey // 2 % 3] as cap, right({_KEY}, 1) as z from customer)
      select c_custkey, cap, case when cap = 'ocr' then 'held' when cap = 'transcribe' then 'skipped' when z < '4' then 'failed' else 'done' end as state,
        case when cap = 'ocr' then 'waiting for you to run it' when cap = 'transcribe' then 'no provider configured' when z < '4' then 'busy' else '' end as note,
        case when cap <> 'describeImage' or z < '4' then '' when z < '8' then '2:L' || n else '1:L' || n end as result, case when cap <> 'describeImage' or z < '4' then '' else 'made' end as provider from r""",
    "findings_text": """with s as (select l_orderkey || '-' || l_linenumber as id, * from lineitem)
      select id, 'violations' as list, 'm' || l_partkey as msg, l_suppkey::bigint as count from s where l_linenumber = 1 union all select id, 'good', 'g', l_partkey from s where l_linenumber = 1
      union all select id, 'violations', m, n from s, (values ('m', -1), ('-', 2), ('-', -1)) v(m, n) where l_linenumber = 2
      union all select id, 'text', case l_linenumber when 3 then '{"violations": [{"msg": "cut' when 4 then '[' || l_partkey || ']' else '' end, 0 from s where l_linenumber in (3, 4, 5)
      union all select o_orderkey::varchar, 'summary', '', o_custkey from orders""",
}
