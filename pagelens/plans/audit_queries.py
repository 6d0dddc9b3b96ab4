"""Queries over audits and scorecards, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import rules_catalog
from ..operators import audits, scoring
from ..sources import audits as store
from ..sources import shapes
from ..sources.shapes import SHAPES_SQL


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    return audits.fetch_situations(shapes.assessment(spark, d), shapes.situation_result(spark, d))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    return store.nest_assessments(shapes.assessment(spark, d), shapes.situation_result(spark, d), shapes.evidence(spark, d))


def audit_card(spark: SparkSession, d: str) -> DataFrame:
    pages = shapes.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")).distinct()
    return scoring.scorecard(pages, shapes.report(spark, d, dealt=True), shapes.good(spark, d, dealt=True))


def nest_assessments(spark: SparkSession, d: str) -> DataFrame:
    shot = lambda e: F.concat(e["kind"], F.lit("/"), e["filename"])
    sit = lambda s: F.concat_ws(":", s["code"], s["id"], F.array_join(F.transform(s["evidence"], shot), ","))
    return _nested(spark, d).select("id", "dl_url", F.size("situations").cast("long").alias("n"), F.array_join(F.transform("situations", sit), ";").alias("situations"))


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return audit_card(spark, d).select("page_id", "code", "level", "violations", "good", F.col("auto_score").cast("double").alias("auto_score"), "violations_note", "good_note")


def only_flags_by_target(spark: SparkSession, d: str) -> DataFrame:
    rules = F.broadcast(rules_catalog(spark).select("code", "rule_id", "level").dropDuplicates(["code"]))
    rows = scoring.by_conformance_target(scoring.only_rules(shapes.report(spark, d).join(rules, "code"), ["file-links", "ACC4", "NAV2", "RED4"]), "A", "AA")
    return rows.groupBy("code", "level").agg(F.count("*").alias("n"))


QUERIES = {
    "fetch_situations": lambda s, d: _fetched(s, d).withColumns({c: F.col(c).cast("double") for c in ("compliance_score", "auto_score")}),
    "fetch_assessments": lambda s, d: audits.fetch_assessments(shapes.assessment(s, d)),
    "list_assessments": lambda s, d: audits.list_assessments(shapes.assessment(s, d), "https://lib7"),
    "audit_history": lambda s, d: audits.audit_history(shapes.assessment(s, d)),
    "nest_assessments": nest_assessments,
    "compliance_by_situation": lambda s, d: audits.compliance_by_situation(_fetched(s, d)),
    "compliance_by_situation_library": lambda s, d: audits.compliance_by_situation(_fetched(s, d), "https://lib3"),
    "compliance_by_code_sql": lambda s, d: audits.compliance_by_code_sql(_fetched(s, d)),
    "compliance_by_code_local": lambda s, d: audits.compliance_by_code_local(_fetched(s, d)),
    "level_rollup": lambda s, d: audits.level_rollup(_fetched(s, d)),
    "level_tiles": lambda s, d: audits.level_tiles(audits.compliance_by_code_sql(_fetched(s, d))),
    "trend_over_time": lambda s, d: audits.trend_over_time(_fetched(s, d)),
    "trend_last_n": lambda s, d: audits.trend_last_n(shapes.assessment(s, d), shapes.situation_result(s, d), "https://lib7"),
    "headline_metrics": lambda s, d: audits.headline_metrics(_fetched(s, d), "https://lib7"),
    "dashboard_stats": lambda s, d: audits.dashboard_stats(shapes.assessment(s, d)),
    "library_names": lambda s, d: audits.library_names(_fetched(s, d)),
    "library_options": lambda s, d: audits.library_options(shapes.assessment(s, d)),
    "weakest_situations": lambda s, d: audits.weakest_situations(audits.compliance_by_situation(_fetched(s, d))),
    "export_compliance": lambda s, d: store.export_compliance(audits.compliance_by_code_sql(_fetched(s, d))),
    "violations_per_situation": lambda s, d: scoring.violations_per_situation(shapes.report(s, d)).drop("at"),
    "good_techniques_per_situation": lambda s, d: scoring.good_techniques(shapes.good(s, d)).drop("at"),
    "scorecard": scorecard,
    "auto_summary": lambda s, d: scoring.auto_summary(audit_card(s, d)),
    "report_by_code": lambda s, d: scoring.report_by_code(shapes.report(s, d)),
    "rules_by_target": only_flags_by_target,
}

_FETCH = "select id, dl_name, dl_url, assessor, created_at, tool_version from assessment"
_BY_CODE = "select code, level, avg(compliance_score) as avg_score, count(*) as n from fetched group by code, level"
_BY_SITUATION = "select code, level, avg(compliance_score) as avg_score, count(*) as n from fetched where compliance_score is not null{} group by code, level"
_TOKENS = "tok as (select code as situation, unnest(string_split(code, '/')) as token, unnest(range(len(string_split(code, '/')))) as token_ix from sit)"
_VIOLATIONS = f"""{_TOKENS},
ent as (select r.*, unnest(string_split(code, '/')) as t from report r where kind in ('fix', 'flag')),
vio as (select page_id, situation, msg, max(case when coalesce(count, 0) = 0 then 1 else count end) as count,
  arg_min(kind, (token_ix, seq)) as kind, min((token_ix, seq)) as ord from ent join tok on t = token group by page_id, situation, msg)"""
_GOODS = """goo as (select page_id, situation, msg, arg_min(count, (token_ix, msg)) as count, min((token_ix, msg)) as ord
  from good join tok using (token) where count > 0 group by page_id, situation, msg)"""
CARD_SQL = f"""{_VIOLATIONS}, {_GOODS},
v as (select page_id, situation, sum(count) as violations, string_agg('• ' || msg || case when count > 1 then ' (×' || count || ')' else '' end, chr(10) order by ord) as vn from vio group by 1, 2),
g as (select page_id, situation, sum(count) as good, string_agg('• ' || msg, chr(10) order by ord) as gn from goo group by 1, 2),
card as (select p.o_orderkey as page_id, s.code, s.level, coalesce(violations, 0)::bigint as violations, coalesce(good, 0)::bigint as good,
    coalesce(vn, '') as violations_note, coalesce(gn, '') as good_note
  from (select distinct o_orderkey from orders) p cross join sit s left join v on v.page_id = p.o_orderkey and v.situation = s.code
  left join g on g.page_id = p.o_orderkey and g.situation = s.code)"""

_SQL = {
    "fetch_situations": "select * replace (compliance_score::double as compliance_score, auto_score::double as auto_score) from fetched",
    "fetch_assessments": _FETCH,
    "list_assessments": f"{_FETCH} where dl_url = 'https://lib7' order by created_at desc, id limit 25",
    "audit_history": "select id, replace(created_at[1:16], 'T', ' ') as at, dl_name as library, assessor from assessment order by created_at desc, id limit 25",
    "nest_assessments": """select a.id, any_value(a.dl_url) as dl_url, count(s.id) as n,
      coalesce(string_agg(s.code || ':' || s.id || ':' || coalesce(e.shots, ''), ';' order by s.code, s.id), '') as situations
      from assessment a left join situation_result s on s.assessment_id = a.id
      left join (select situation_result_id, string_agg(kind || '/' || filename, ',' order by kind, filename) as shots from evidence group by 1) e on e.situation_result_id = s.id group by a.id""",
    "compliance_by_situation": _BY_SITUATION.format(""),
    "compliance_by_situation_library": _BY_SITUATION.format(" and dl_url = 'https://lib3'"),
    "compliance_by_code_sql": _BY_CODE,
    "compliance_by_code_local": "select code, arg_min(level, (assessment_id, level)) as level, avg(compliance_score) as avg_score, count(*) as n from fetched where compliance_score is not null group by code",
    "level_rollup": "select level, sum(compliance_score) / count(*) as avg_score, count(*) as n from fetched where compliance_score is not null group by level",
    "level_tiles": f"select level, sum(coalesce(avg_score, 0) * n) / sum(n) as avg_score, sum(n)::bigint as n from ({_BY_CODE}) group by level",
    "trend_over_time": "select created_at, created_at[1:10] as date, avg(compliance_score) as avg_score, assessment_id from fetched where compliance_score is not null group by assessment_id, created_at",
    "trend_last_n": """select id, created_at[1:10] as date, avg(compliance_score) as avg_score
      from (select id, created_at from assessment where dl_url = 'https://lib7' order by created_at desc, id desc limit 30) a
      join (select assessment_id, compliance_score from situation_result) s on s.assessment_id = a.id group by id, created_at having avg(compliance_score) is not null""",
    "headline_metrics": "select count(distinct case when dl_url = 'https://lib7' then assessment_id end) as audits, count(distinct dl_url) as libraries, max(case when dl_url = 'https://lib7' then created_at end)[1:10] as latest from fetched",
    "dashboard_stats": "select count(*) as audits, count(distinct dl_url) as libraries, max(created_at)[1:10] as latest from (select * from assessment order by created_at desc, id limit 500)",
    "library_names": "select dl_url, arg_min(dl_name, (created_at, assessment_id)) as dl_name from fetched group by dl_url",
    "library_options": "select distinct on (dl_url) dl_url, dl_name from (select * from assessment order by created_at desc, id limit 500) order by dl_url, created_at desc, id",
    "weakest_situations": f"select * from ({_BY_SITUATION.format('')}) order by avg_score, code, level limit 8",
    "export_compliance": f"select code, level, printf('%.3f', round(coalesce(avg_score, 0), 3)) as avg_score, n from ({_BY_CODE})",
    "violations_per_situation": f"with x as (select 1), {_VIOLATIONS} select page_id, situation, msg, count::bigint as count, kind from vio",
    "good_techniques_per_situation": f"with x as (select 1), {_TOKENS}, {_GOODS} select page_id, situation, msg, count::bigint as count from goo",
    "scorecard": f"with x as (select 1), {CARD_SQL} select page_id, code, level, violations, good, case when good + violations > 0 then greatest(1, least(7, floor(1 + 6 * good / (good + violations) + 0.5)))::double end as auto_score, violations_note, good_note from card",
    "auto_summary": f"with x as (select 1), {CARD_SQL} select page_id, sum(violations)::bigint as violations, sum(good)::bigint as good from card group by page_id",
    "report_by_code": "select page_id, r.code, string_agg(msg, ' ' order by seq, msg) as messages, bool_or(r.kind = 'flag') as needs_content, coalesce(any_value(c.criteria), '') as criteria from report r left join (select code, max(criteria) as criteria from rul group by code) c on c.code = r.code group by page_id, r.code",
    "rules_by_target": "select r.code, u.level, count(*) as n from report r join (select distinct on (code) code, rule_id, level from rul order by code, rule_ix) u on u.code = r.code where (u.rule_id = 'file-links' or u.code in ('ACC4', 'NAV2', 'RED4')) and u.level in ('A', 'AA') group by 1, 2",
}

ORACLE_SQL = {k: f"with {SHAPES_SQL}, " + q.removeprefix("with ") if q.startswith("with ") else f"with {SHAPES_SQL} {q}" for k, q in _SQL.items()}
