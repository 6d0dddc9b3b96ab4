"""Aggregates over audits: by situation, level, library and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (None, "", "All")


def level_order(level: Column) -> Column:
    """A, AA, AAA, then others."""
    return F.when(level == "A", 0).when(level == "AA", 1).when(level == "AAA", 2).otherwise(9)


def filter_library(df: DataFrame, dl_url: str | None = None) -> DataFrame:
    """Rows of one library; None, the empty text and "All" let all rows through."""
    return df if dl_url in ALL else df.where(F.col("dl_url") == dl_url)


def scored_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("compliance_score").isNotNull())


def fetch_situations(assessment: DataFrame, situation: DataFrame) -> DataFrame:
    """Situation rows with the header of their audit, nine columns."""
    a = assessment.select(F.col("id").alias("assessment_id"), "dl_name", "dl_url", "assessor", "created_at")
    return a.join(situation.select("assessment_id", "code", "level", "compliance_score", "auto_score"), "assessment_id")


def fetch_assessments(assessment: DataFrame) -> DataFrame:
    """Audits, newest first; equal times by id."""
    return assessment.select("id", "dl_name", "dl_url", "assessor", "created_at", "tool_version").orderBy(F.desc("created_at"), "id")


def list_assessments(assessment: DataFrame, dl_url: str | None = None, limit: int = 25) -> DataFrame:
    return fetch_assessments(filter_library(assessment, dl_url)).limit(limit)


def audit_history(assessment: DataFrame, dl_url: str | None = None, limit: int = 25) -> DataFrame:
    """``(id, at, library, assessor)`` of the newest audits: time to the minute, and the url where there is no name."""
    rows = list_assessments(assessment, dl_url, limit)
    name = F.coalesce(F.when(F.col("dl_name") != "", F.col("dl_name")), F.col("dl_url"), F.lit(""))
    return rows.select("id", F.replace(F.substring(F.coalesce("created_at", F.lit("")), 1, 16), F.lit("T"), F.lit(" ")).alias("at"), name.alias("library"), F.coalesce("assessor", F.lit("")).alias("assessor"))


def compliance_by_situation(situations: DataFrame, dl_url: str | None = None) -> DataFrame:
    """``(code, level, avg_score, n)`` over scored rows; rows without code or level are left out."""
    rows = scored_only(filter_library(situations, dl_url)).where("code is not null and level is not null")
    return rows.groupBy("code", "level").agg(F.avg("compliance_score").alias("avg_score"), F.count("*").alias("n")).orderBy("code", "level")


def compliance_by_code_sql(situations: DataFrame, dl_url: str | None = None) -> DataFrame:
    """As :func:`compliance_by_situation`, but ``n`` counts unscored rows too and groups without scores keep a null mean."""
    rows = filter_library(situations, dl_url)
    return rows.groupBy("code", "level").agg(F.avg("compliance_score").alias("avg_score"), F.count("*").alias("n")).orderBy("code", "level")


def compliance_by_code_local(situations: DataFrame, dl_url: str | None = None) -> DataFrame:
    """By code alone over scored rows; the level is that of the audit with the smallest id."""
    rows = scored_only(filter_library(situations, dl_url))
    return rows.groupBy("code").agg(F.min_by("level", F.struct("assessment_id", "level")).alias("level"), F.avg("compliance_score").alias("avg_score"), F.count("*").alias("n")).orderBy("code")


def level_rollup(situations: DataFrame, dl_url: str | None = None) -> DataFrame:
    """``(level, avg_score, n)`` in the order A, AA, AAA, others."""
    rows = scored_only(filter_library(situations, dl_url)).where("code is not null and level is not null")
    return rows.groupBy("level").agg((F.sum("compliance_score") / F.count("*")).alias("avg_score"), F.count("*").alias("n")).orderBy(level_order(F.col("level")), "level")


def level_tiles(by_code: DataFrame) -> DataFrame:
    """Always three rows. A null mean counts as 0 and a group without rows as one; other levels are left out."""
    three = by_code.sparkSession.createDataFrame([("A",), ("AA",), ("AAA",)], "level string")
    n = F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(F.col("n"))
    sums = by_code.groupBy("level").agg(F.sum(F.coalesce("avg_score", F.lit(0.0)) * n).alias("s"), F.sum(n).alias("n"))
    return F.broadcast(three).join(sums, "level", "left").select("level", (F.col("s") / F.col("n")).alias("avg_score"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("level")


def trend_over_time(situations: DataFrame, dl_url: str | None = None) -> DataFrame:
    """``(created_at, date, avg_score, assessment_id)``, oldest first."""
    g = scored_only(filter_library(situations, dl_url)).groupBy("assessment_id", "created_at").agg(F.avg("compliance_score").alias("avg_score"))
    return g.select("created_at", F.substring("created_at", 1, 10).alias("date"), "avg_score", "assessment_id").orderBy("created_at", "assessment_id")


def trend_last_n(assessment: DataFrame, situation: DataFrame, dl_url: str | None = None, n: int = 30) -> DataFrame:
    """Means of the newest ``n`` audits, oldest first. Audits without scores drop out after the limit, as do all when fewer
    than two are left."""
    newest = filter_library(assessment, dl_url).select("id", "created_at").orderBy(F.desc(F.coalesce("created_at", F.lit(""))), F.desc("id")).limit(n)
    rows = situation.select(F.col("assessment_id").alias("id"), "compliance_score").join(F.broadcast(newest.select("id")), "id", "left_semi")
    means = rows.groupBy("id").agg(F.avg("compliance_score").alias("avg_score")).where("avg_score is not null").join(F.broadcast(newest), "id")
    many = F.count("*").over(Window.partitionBy(F.lit(1)))
    return means.withColumn("many", many).where("many >= 2").select("id", F.substring("created_at", 1, 10).alias("date"), "avg_score").orderBy("date", "id")


def headline_metrics(situations: DataFrame, dl_url: str | None = None) -> DataFrame:
    """One row ``(audits, libraries, latest)``: audits and latest date of the selection, libraries of all rows."""
    mine = F.lit(True) if dl_url in ALL else F.col("dl_url") == dl_url
    return situations.agg(F.count_distinct(F.when(mine, F.col("assessment_id"))).alias("audits"), F.count_distinct("dl_url").alias("libraries"), F.coalesce(F.substring(F.max(F.when(mine, F.col("created_at"))), 1, 10), F.lit("—")).alias("latest"))


def dashboard_stats(assessment: DataFrame, dl_url: str | None = None, limit: int = 500) -> DataFrame:
    """As the headline metrics, but from the newest ``limit`` audits, with or without situations."""
    rows = fetch_assessments(assessment).limit(limit)
    mine = F.lit(True) if dl_url in ALL else F.col("dl_url") == dl_url
    url = F.when(F.col("dl_url") != "", F.col("dl_url"))
    return rows.agg(F.count(F.when(mine, 1)).alias("audits"), F.count_distinct(url).alias("libraries"), F.coalesce(F.substring(F.max(F.when(mine, F.coalesce("created_at", F.lit("")))), 1, 10), F.lit("—")).alias("latest"))


def library_names(situations: DataFrame) -> DataFrame:
    """``(dl_url, dl_name)``: the name in the earliest audit that has one."""
    rows = situations.where("dl_url is not null and dl_name is not null")
    names = rows.groupBy("dl_url").agg(F.min_by("dl_name", F.struct("created_at", "assessment_id")).alias("dl_name"))
    return situations.where("dl_url is not null").select("dl_url").distinct().join(names, "dl_url", "left").orderBy("dl_url")


def library_options(assessment: DataFrame, limit: int = 500) -> DataFrame:
    """``(dl_url, dl_name)`` of the newest audits: the name in the newest audit of each library, else the url."""
    rows = fetch_assessments(assessment).limit(limit).where("dl_url <> ''")
    name = F.coalesce(F.when(F.col("dl_name") != "", F.col("dl_name")), F.col("dl_url"))
    first = rows.withColumn("name", name).groupBy("dl_url").agg(F.max("created_at").alias("t"), F.collect_list(F.struct("created_at", "id", "name")).alias("all"))
    newest = F.array_min(F.transform(F.filter("all", lambda x: x["created_at"] == F.col("t")), lambda x: F.struct(x["id"], x["name"])))
    return first.select("dl_url", newest["name"].alias("dl_name")).orderBy("dl_url")


def weakest_situations(by_code: DataFrame, n: int = 8) -> DataFrame:
    return by_code.orderBy("avg_score", "code", "level").limit(n)
