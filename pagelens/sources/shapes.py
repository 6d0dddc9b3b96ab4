"""Audit-shaped tables from the given star schema, and the same in SQL; every query derives its rows from these."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import RULES, SITUATIONS, rules_catalog, situations


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a session without a
    cluster gets a new local one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each become a page. The file of the parts is so small that one task reads it, while parsing and auditing what is
    made of them is all of the work, so the rows are dealt by key: over three tasks a core, as a task first reads a large plan."""
    shuffled, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    return table(spark, sf_dir, "part").repartition(max(min(shuffled, 32), 3 * cores), "p_partkey")


def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit per order; libraries come from customers."""
    lib = (F.col("o_custkey") % 40).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Library "), lib).alias("dl_name"), F.concat(F.lit("https://lib"), lib).alias("dl_url"),
        F.col("o_orderpriority").alias("assessor"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("o_orderstatus").alias("tool_version"),
    )


def _line_id() -> F.Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))


def situation_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One situation row per line of an order; the last line number has no human score."""
    lines = table(spark, sf_dir, "lineitem").withColumn("ix", (F.col("l_partkey") % 24).cast("int"))
    score = F.when(F.col("l_linenumber") != 7, 1 + F.col("l_quantity").cast("int") % 7)
    return lines.join(F.broadcast(situations(spark)), "ix").select(
        _line_id().alias("id"), F.col("l_orderkey").cast("string").alias("assessment_id"), "code", "level", "title",
        score.cast("int").alias("compliance_score"), (1 + F.col("l_suppkey") % 7).cast("int").alias("auto_score"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One screenshot per returned line."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumn("ix", (F.col("l_partkey") % 24).cast("int"))
    return lines.join(F.broadcast(situations(spark)), "ix").select(
        _line_id().alias("situation_result_id"), F.when(F.col("l_linestatus") == "O", "good").otherwise("violation").alias("kind"),
        F.concat("code", F.lit("_image1.png")).alias("filename"), F.lit("").alias("note"), F.lit(None).cast("string").alias("image_base64"),
    )


def _lines(spark: SparkSession, sf_dir: str, dealt: bool) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.repartition("l_orderkey") if dealt else lines


def report(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``(page_id, seq, code, kind, count, msg)``: one report entry per line; every fifth has no count. With ``dealt`` the lines
    are dealt by page, so that what is worked out of a page's entries moves no more rows, and none of their text."""
    lines = _lines(spark, sf_dir, dealt).withColumn("rule_ix", (F.col("l_partkey") % 22).cast("int"))
    kind = F.element_at(F.array(F.lit("fix"), F.lit("flag"), F.lit("error")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return lines.join(F.broadcast(rules_catalog(spark)).select("rule_ix", "rule_id", "code"), "rule_ix").select(
        F.col("l_orderkey").alias("page_id"), _line_id().alias("seq"), "code", kind.alias("kind"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity").cast("long")).alias("count"), F.concat("rule_id", F.lit(" finding "), (F.col("l_suppkey") % 3).cast("string")).alias("msg"),
    )


def good(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``(page_id, token, msg, count)``: good techniques by token, from lines without tax; ``dealt`` as for :func:`report`."""
    lines = _lines(spark, sf_dir, dealt).where("l_tax < 0.03").withColumn("ix", (F.col("l_suppkey") % 24).cast("int"))
    token = F.split("code", "/")[0]
    return lines.join(F.broadcast(situations(spark)), "ix").groupBy(F.col("l_orderkey").alias("page_id"), token.alias("token")).agg(F.count("*").alias("count")).withColumn("msg", F.concat("token", F.lit(" done well")))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), round(l_extendedprice * 100)::bigint)"

#: The shapes above as DuckDB common table expressions.
SHAPES_SQL = f"""
sit(ix, code, title, level) as (values {_values((i, *s) for i, s in enumerate(SITUATIONS))}),
rul(rule_ix, rule_id, code, level, kind, criteria) as (values {_values((i, *r) for i, r in enumerate(RULES))}),
assessment as (select o_orderkey::varchar as id, 'Library ' || (o_custkey % 40)::varchar as dl_name, 'https://lib' || (o_custkey % 40)::varchar as dl_url,
  o_orderpriority as assessor, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as created_at, o_orderstatus as tool_version from orders),
situation_result as (select {_LINE_ID} as id, l_orderkey::varchar as assessment_id, code, level, title,
  case when l_linenumber = 7 then null else 1 + l_quantity::int % 7 end as compliance_score, 1 + l_suppkey % 7 as auto_score
  from lineitem join sit on ix = l_partkey % 24),
evidence as (select {_LINE_ID} as situation_result_id, case l_linestatus when 'O' then 'good' else 'violation' end as kind, code || '_image1.png' as filename
  from lineitem join sit on ix = l_partkey % 24 where l_returnflag = 'R'),
fetched as (select a.id as assessment_id, dl_name, dl_url, assessor, created_at, code, level, compliance_score, auto_score
  from situation_result s join assessment a on a.id = s.assessment_id),
report as (select l_orderkey as page_id, {_LINE_ID} as seq, code, ['fix', 'flag', 'error'][(l_linenumber % 3 + 1)::int] as kind,
  case when l_suppkey % 5 <> 0 then l_quantity::bigint end as count, rule_id || ' finding ' || (l_suppkey % 3)::varchar as msg
  from lineitem join rul on rule_ix = l_partkey % 22),
good as (select l_orderkey as page_id, split_part(code, '/', 1) as token, count(*) as count, split_part(code, '/', 1) || ' done well' as msg
  from lineitem join sit on ix = l_suppkey % 24 where l_tax < 0.03 group by 1, 2)
"""
