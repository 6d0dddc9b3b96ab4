"""Audit tables: schemas, reading, saving nested audits, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = "struct<violations:bigint,good:bigint>"
FINDINGS = "struct<violations:array<struct<msg:string,count:bigint,kind:string>>,goodTechniques:array<struct<msg:string,count:bigint>>>"
EVIDENCE = "struct<kind:string,filename:string,note:string,image_base64:string>"
SITUATION = f"struct<code:string,level:string,title:string,compliance_score:int,auto_score:int,auto_findings:{FINDINGS},violations_note:string,good_note:string,evidence:array<{EVIDENCE}>>"

SCHEMAS = {
    "assessment": f"id string, dl_name string, dl_url string, assessor string, created_at string, user_agent string, tool_version string, overall_note string, auto_summary {SUMMARY}",
    "situation_result": f"id string, assessment_id string, code string, level string, title string, compliance_score int, auto_score int, auto_findings {FINDINGS}, violations_note string, good_note string",
    "evidence": "id string, situation_result_id string, kind string, filename string, note string, image_base64 string",
}
#: Columns that a store may hold as JSON text.
STORED_TEXT = {"auto_summary": SUMMARY, "auto_findings": FINDINGS}
NESTED = f"id string, dl_name string, dl_url string, assessor string, created_at string, user_agent string, tool_version string, overall_note string, auto_summary {SUMMARY}, situations array<{SITUATION}>"


def read_audit_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables with their fixed schemas; columns that a file lacks are null. Findings and summaries may be stored as
    JSON text, see :func:`parse_stored_text`; the table then has what could not be read in a column of its own."""
    out = {}
    for name, schema in SCHEMAS.items():
        stored = spark.read.parquet(f"{folder}/{name}").schema
        for c in stored.fields:
            if c.name in STORED_TEXT and c.dataType.simpleString() == "string":
                schema = schema.replace(f"{c.name} {STORED_TEXT[c.name]}", f"{c.name} string")
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
        out[name] = parse_stored_text(rows.select(*[f.name for f in T.StructType.fromDDL(schema).fields]))
    return out


def parse_stored_text(rows: DataFrame) -> DataFrame:
    """Findings and summaries from JSON text of any shape.

    Fields are taken one by one as far as they can be read: a count may be text, an entry may lack fields or have others, and
    a list may be missing. Text that is no JSON object gives null, and is kept in ``<column>_text``; for text that could
    be read that column is null.
    """
    for name in (c for c in STORED_TEXT if c in rows.columns and rows.schema[c].dataType.simpleString() == "string"):
        v, raw = F.try_parse_json(name), F.col(name)
        if name == "auto_summary":
            read = F.struct(*[F.try_variant_get(v, f"$.{f}", "bigint").alias(f) for f in ("violations", "good")])
        else:
            entry = lambda x, fields: F.struct(*[F.try_variant_get(x, f"$.{f}", "bigint" if f == "count" else "string").alias(f) for f in fields])
            many = lambda f, *fields: F.transform(F.try_variant_get(v, f"$.{f}", "array<variant>"), lambda x: entry(x, fields)).alias(f)  # noqa: B023, E731
            read = F.struct(many("violations", "msg", "count", "kind"), many("goodTechniques", "msg", "count"))
        known = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        rows = rows.withColumn(f"{name}_text", F.when(~known, raw)).withColumn(name, F.when(known, read).cast(STORED_TEXT[name]))
    return rows


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Nested audits from JSON lines; a part that does not parse is null."""
    return spark.read.schema(NESTED).json(path)


def with_id(nested: DataFrame) -> DataFrame:
    """Audits without an id get one that follows from what they say."""
    return nested.withColumn("id", F.coalesce("id", F.sha2(F.to_json(F.struct("dl_url", "created_at", "assessor", "situations")), 256)))


def flatten_audits(nested: DataFrame) -> dict[str, DataFrame]:
    """Rows of the three tables from nested audits, with defaults filled.

    An id is that of the audit and the row's place in it, so that flattening twice gives the same rows. A digest of these would
    be most of what is stored, as digests can't be compressed.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = with_id(nested)
    heads = own.select("id", *map(text, ("dl_name", "dl_url", "assessor")), F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("created_at"), *map(text, ("user_agent", "tool_version", "overall_note")), "auto_summary")
    sits = own.select(F.col("id").alias("assessment_id"), F.posexplode("situations").alias("pos", "s")).withColumn("id", F.concat_ws(":", "assessment_id", "pos"))
    rows = sits.select("id", "assessment_id", *[F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c) for c in ("code", "level", "title")], "s.compliance_score", "s.auto_score", "s.auto_findings", *[F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c) for c in ("violations_note", "good_note")])
    shots = sits.select(F.col("id").alias("situation_result_id"), F.posexplode("s.evidence").alias("pos", "e"))
    shots = shots.select(F.concat_ws(":", "situation_result_id", "pos").alias("id"), "situation_result_id", F.coalesce("e.kind", F.lit("violation")).alias("kind"), F.coalesce("e.filename", F.lit("")).alias("filename"), F.coalesce("e.note", F.lit("")).alias("note"), "e.image_base64")
    return {"assessment": heads, "situation_result": rows, "evidence": shots}


@contextmanager
def _shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """What a write has shuffled goes when it ends; else it stays on disk until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def save_assessments(nested: DataFrame, folder: str, batch: str | None = None) -> None:
    """Write nested audits as one batch of the three tables: a folder of each, which is written over when the batch comes again.

    Headers go last, so a reader that joins on them never sees half an audit. Without ``batch`` the audits are one of their own.
    """
    tables, batch = flatten_audits(nested), batch or f"save-{uuid.uuid4().hex}"
    with _shuffles_let_go(nested.sparkSession):
        for name in ("evidence", "situation_result", "assessment"):
            tables[name].write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/batch={batch}")


def nest_assessments(assessment: DataFrame, situation: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per audit: its header and ``situations`` ordered by code, each with its evidence; without any, ``[]``."""
    shots = evidence.groupBy(F.col("situation_result_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", "filename", "note", "image_base64"))).alias("evidence"))
    full = situation.join(shots, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")))
    fields = ["code", "id", "level", "title", "compliance_score", "auto_score", "auto_findings", "violations_note", "good_note", "evidence"]
    fields = [c for c in fields if c in full.columns]
    each = full.groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when((a["code"] < b["code"]) | ((a["code"] == b["code"]) & (a["id"] < b["id"])), -1).when((a["code"] == b["code"]) & (a["id"] == b["id"]), 0).otherwise(1)).alias("situations"))
    out = assessment.join(each, assessment["id"] == each["assessment_id"], "left").drop("assessment_id")
    return out.withColumn("situations", F.coalesce("situations", F.array().cast(each.schema["situations"].dataType)))


def get_assessment(nested: DataFrame, audit_id: str) -> DataFrame:
    return nested.where(F.col("id") == audit_id)


def export_compliance(by_code: DataFrame) -> DataFrame:
    """``(code, level, avg_score, n)`` with the mean as text of three decimals, a null mean as 0."""
    return by_code.select("code", "level", F.format_string("%.3f", F.coalesce("avg_score", F.lit(0.0))).alias("avg_score"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def export_compliance_csv(by_code: DataFrame, path: str) -> None:
    export_compliance(by_code).orderBy("code", "level").write.mode("overwrite").option("header", True).csv(path)


def export_audits_json(nested: DataFrame, path: str) -> None:
    """Full audits as JSON lines, compressed by gzip, and a manifest with the time and their number, which is counted while they
    are written."""
    counted = Observation()
    with _shuffles_let_go(nested.sparkSession):
        nested.observe(counted, F.count(F.lit(1)).alias("count")).write.mode("overwrite").option("compression", "gzip").json(f"{path}/audits")
    one = nested.sparkSession.range(1).select(F.current_timestamp().alias("exported_at"), F.lit(counted.get["count"]).cast("long").alias("count"))
    one.write.mode("overwrite").json(f"{path}/manifest")
