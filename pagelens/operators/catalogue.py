"""The guideline catalogue: consistency checks, counts and scenario texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import rules_catalog, situations

SCENARIO = "struct<name:string,given:array<string>,when:array<string>,then:array<string>>"
SCHEMA = f"code string, title string, level string, wcag string, elements array<string>, engine_rules array<string>, user_story struct<role:string,feature:string,benefit:string>, core array<{SCENARIO}>, guidelines array<struct<text:string,classification:string,status:string,rationale:string,scenario:{SCENARIO}>>"
# Fixed values.
CLASSES = ("algorithmic", "hybrid", "manual")
STATUSES = ("app-layer", "implemented", "manual", "proposed", "service")


def read_guidelines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def guideline_rows(catalogue: DataFrame) -> DataFrame:
    """``(code, ix, text, classification, status, rationale)``."""
    return catalogue.select("code", F.posexplode("guidelines").alias("ix", "g")).select("code", "ix", "g.text", "g.classification", "g.status", "g.rationale")


def guideline_matrix(rows: DataFrame) -> DataFrame:
    """``(dimension, value, n)``: guidelines by classification, by status, and in all."""
    sets = rows.groupingSets([[F.col("classification")], [F.col("status")], []], "classification", "status").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    dimension = F.when(F.col("g") == 1, "classification").when(F.col("g") == 2, "status").otherwise("total")
    return sets.select(dimension.alias("dimension"), F.coalesce("classification", "status", F.lit("all")).alias("value"), "n")


def check_catalogue(catalogue: DataFrame) -> DataFrame:
    """``(problem, code, detail)``: tokens that no entry covers, unknown rules, other levels than the situation's, and
    unknown classes or states."""
    spark = catalogue.sparkSession
    have = catalogue.select(F.explode(F.split("code", "/")).alias("token"))
    missing = situations(spark).select("code", F.explode(F.split("code", "/")).alias("token")).join(have, "token", "left_anti").select(F.lit("missing token").alias("problem"), "code", F.col("token").alias("detail"))
    rules = rules_catalog(spark).select("rule_id")
    unknown = catalogue.select("code", F.explode("engine_rules").alias("rule_id")).join(rules, "rule_id", "left_anti").select(F.lit("unknown rule").alias("problem"), "code", F.col("rule_id").alias("detail"))
    levels = catalogue.join(situations(spark).select("code", F.col("level").alias("own")), "code").where("level <> own").select(F.lit("level").alias("problem"), "code", F.concat_ws(" ", "level", "own").alias("detail"))
    rows = guideline_rows(catalogue)
    classes = rows.where(~F.coalesce(F.col("classification"), F.lit("")).isin(*CLASSES)).select(F.lit("classification").alias("problem"), "code", F.coalesce("classification", F.lit("")).alias("detail"))
    states = rows.where(~F.coalesce(F.col("status"), F.lit("")).isin(*STATUSES)).select(F.lit("status").alias("problem"), "code", F.coalesce("status", F.lit("")).alias("detail"))
    return missing.unionByName(unknown).unionByName(levels).unionByName(classes).unionByName(states)


def scenario_text(s: Column) -> Column:
    """Lines of a scenario: the first step of a kind has its word, the next ones And."""
    def steps(field: str, word: str) -> Column:
        return F.transform(F.coalesce(s[field], F.array().cast("array<string>")), lambda x, i: F.concat(F.lit("    "), F.when(i == 0, word).otherwise("And"), F.lit(" "), x))

    return F.array_join(F.concat(F.array(F.concat(F.lit("  Scenario: "), s["name"])), steps("given", "Given"), steps("when", "When"), steps("then", "Then")), "\n")


def render_features(catalogue: DataFrame) -> DataFrame:
    """``(code, feature)``: one text per situation with its core scenarios and those of its guidelines."""
    own = F.filter(F.transform("guidelines", lambda g: g["scenario"]), lambda s: s.isNotNull())
    texts = F.transform(F.concat(F.coalesce("core", F.array().cast(f"array<{SCENARIO}>")), F.coalesce(own, F.array().cast(f"array<{SCENARIO}>"))), scenario_text)
    story = F.concat_ws("\n", F.concat(F.lit("  As "), F.col("user_story.role")), F.concat(F.lit("  I want "), F.col("user_story.feature")), F.concat(F.lit("  So that "), F.col("user_story.benefit")))
    return catalogue.select("code", F.concat_ws("\n\n", F.concat(F.lit("Feature: "), "title", F.lit("\n"), story), F.array_join(texts, "\n\n")).alias("feature"))
