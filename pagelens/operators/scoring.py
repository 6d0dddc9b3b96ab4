"""From report entries and good techniques to the scorecard of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CODE_LABELS, rubric, rules_catalog, situation_tokens, situations


def situation_entries(entries: DataFrame, token: Column) -> DataFrame:
    """Rows of ``entries`` once for each situation that shares a token with them; adds ``situation`` and ``token_ix``."""
    tokens = F.broadcast(situation_tokens(entries.sparkSession).select(F.col("code").alias("situation"), F.col("token").alias("__token"), "token_ix"))
    return entries.withColumn("__token", F.explode(F.split(token, "/"))).join(tokens, "__token").drop("__token")


def violations_per_situation(report: DataFrame) -> DataFrame:
    """``(page_id, situation, msg, count, kind, at)``: fixes and flags, equal messages of a situation merged.

    A merged count is the largest, a missing one counts as 1, and the kind is that of the first entry. ``at`` orders
    messages by first appearance: place of the token, then ``seq``.
    """
    rows = situation_entries(report.where(F.col("kind").isin("fix", "flag")), F.col("code"))
    at = F.struct("token_ix", "seq")
    msg = F.coalesce(F.col("msg"), F.when(F.col("kind") == "flag", "Content needs to be supplied").otherwise("Non-compliant markup repaired"))
    count = F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count")).cast("long")
    return rows.groupBy("page_id", "situation", msg.alias("msg")).agg(F.max(count).alias("count"), F.min_by("kind", at).alias("kind"), F.min(at).alias("at"))


def good_techniques(good: DataFrame) -> DataFrame:
    """``(page_id, situation, msg, count, at)``: good findings of a situation, the first of each message."""
    rows = situation_entries(good, F.col("token")).where("count > 0")
    at = F.struct("token_ix", "msg")
    return rows.groupBy("page_id", "situation", "msg").agg(F.min_by("count", at).alias("count"), F.min(at).alias("at"))


def auto_score(good: Column, viol: Column) -> Column:
    """1 to 7 by the share of good findings, halves rounded up; null where nothing was found."""
    return F.when(good + viol > 0, F.least(F.greatest(F.floor(1 + 6 * good / (good + viol) + 0.5), F.lit(1)), F.lit(7))).cast("int")


def _lines(items: str, times: bool) -> Column:
    def line(x: Column) -> Column:
        text = F.concat(F.lit("• "), x["msg"])
        return F.concat(text, F.when(x["count"] > 1, F.concat(F.lit(" (×"), x["count"].cast("string"), F.lit(")"))).otherwise("")) if times else text

    return F.array_join(F.transform(items, line), "\n")


def scorecard(pages: DataFrame, report: DataFrame, good: DataFrame) -> DataFrame:
    """24 rows per page: counts, suggested score, findings in order of appearance and notes.

    ``pages(page_id)`` holds every page once. The level is the situation's, and the human score starts as the suggestion.
    What is known of a page is joined as one row of maps by situation; its 24 rows are made where that row is, so they aren't
    shuffled, and stay dealt by page.
    """
    known = F.broadcast(situations(pages.sparkSession).select(F.col("code").alias("situation"), "title", "level"))
    of_page = lambda df, *cols: df.groupBy("page_id").agg(*[F.map_from_entries(F.collect_list(F.struct("situation", c))).alias(c) for c in cols])
    keep = lambda *fields: lambda x: F.struct(*[x[f] for f in fields])
    v = violations_per_situation(report).groupBy("page_id", "situation").agg(F.sum("count").alias("violations"), F.transform(F.array_sort(F.collect_list(F.struct("at", "msg", "count", "kind"))), keep("msg", "count", "kind")).alias("found"))
    g = good_techniques(good).groupBy("page_id", "situation").agg(F.sum("count").alias("good"), F.transform(F.array_sort(F.collect_list(F.struct("at", "msg", "count"))), keep("msg", "count")).alias("done"))
    rows = pages.select("page_id").join(of_page(v, "violations", "found"), "page_id", "left").join(of_page(g, "good", "done"), "page_id", "left").crossJoin(known)
    rows = rows.withColumns({c: F.try_element_at(c, F.col("situation")) for c in ("violations", "found", "good", "done")})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    score = auto_score(zero("good"), zero("violations"))
    return rows.select(
        "page_id", F.col("situation").alias("code"), "level", "title", zero("violations").alias("violations"), zero("good").alias("good"),
        score.alias("auto_score"), score.alias("compliance_score"), F.coalesce("found", F.array().cast("array<struct<msg:string,count:bigint,kind:string>>")).alias("violation_list"),
        F.coalesce("done", F.array().cast("array<struct<msg:string,count:bigint>>")).alias("good_list"),
    ).withColumn("violations_note", _lines("violation_list", True)).withColumn("good_note", _lines("good_list", False))


def with_rubric(card: DataFrame) -> DataFrame:
    """Adds ``meaning``, what the rubric says of each score; null without a score."""
    return card.join(F.broadcast(rubric(card.sparkSession)), F.col("compliance_score") == F.col("score"), "left").drop("score")


def with_label(rows: DataFrame) -> DataFrame:
    """Adds ``label`` to rows with a ``code``: the short label of its first part that has one, else the code."""
    known = F.create_map(*[F.lit(x) for kv in CODE_LABELS.items() for x in kv])
    each = F.filter(F.transform(F.split("code", "/"), lambda c: F.element_at(known, c)), lambda x: x.isNotNull())
    return rows.withColumn("label", F.coalesce(F.get(each, F.lit(0)), "code"))


def auto_summary(card: DataFrame) -> DataFrame:
    """``(page_id, violations, good)``: totals over the situations of a page."""
    return card.groupBy("page_id").agg(F.sum("violations").alias("violations"), F.sum("good").alias("good"))


def to_assessment(card: DataFrame, meta: DataFrame) -> DataFrame:
    """Nested audits, ready to save, from scorecards and ``meta(page_id, dl_name, dl_url, assessor, created_at, ...)``."""
    findings = F.struct(F.col("violation_list").alias("violations"), F.col("good_list").alias("goodTechniques")).alias("auto_findings")
    one = F.struct("code", "level", "title", "compliance_score", "auto_score", findings, "violations_note", "good_note", F.array().cast("array<struct<kind:string,filename:string,note:string,image_base64:string>>").alias("evidence"))
    each = card.groupBy("page_id").agg(F.struct(F.sum("violations").alias("violations"), F.sum("good").alias("good")).alias("auto_summary"), F.array_sort(F.collect_list(one), lambda a, b: F.when(a["code"] < b["code"], -1).when(a["code"] > b["code"], 1).otherwise(0)).alias("situations"))
    out = meta.join(each, "page_id")
    for c in ("dl_name", "dl_url", "assessor", "user_agent", "tool_version", "overall_note"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in out.columns else F.lit(""))
    created = F.col("created_at") if "created_at" in out.columns else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return out.select(F.sha2(F.concat_ws(":", "page_id", "dl_url", *["created_at"] * ("created_at" in out.columns)), 256).alias("id"), "dl_name", "dl_url", "assessor", created.alias("created_at"), "user_agent", "tool_version", "overall_note", "auto_summary", "situations")


def report_by_code(report: DataFrame) -> DataFrame:
    """``(page_id, code, messages, needs_content, criteria)``: messages joined by a space in report order."""
    criteria = F.broadcast(rules_catalog(report.sparkSession).groupBy("code").agg(F.max("criteria").alias("criteria")))
    rows = report.groupBy("page_id", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("msg", F.lit("")).alias("msg")))), lambda x: x["msg"]), " ").alias("messages"), F.bool_or(F.col("kind") == "flag").alias("needs_content"))
    return rows.join(criteria, "code", "left").select("page_id", "code", "messages", "needs_content", F.coalesce("criteria", F.lit("")).alias("criteria"))


def by_conformance_target(df: DataFrame, *levels: str) -> DataFrame:
    return df.where(F.col("level").isin(*levels))


def only_rules(df: DataFrame, wanted: list[str] | str | None) -> DataFrame:
    """Entries of the given rule ids or codes; None lets all through."""
    if wanted is None:
        return df
    wanted = [wanted] if isinstance(wanted, str) else wanted
    return df.where(F.col("rule_id").isin(*wanted) | F.col("code").isin(*wanted))


def fixes_applied(counts: DataFrame) -> DataFrame:
    """``(page_id, fixes_applied)`` from what each rule changed, ``counts(page_id, rule_id, n)``."""
    return counts.groupBy("page_id").agg(F.sum("n").alias("fixes_applied"))


def position(page: str = "page_id", container: str = "container", order: str = "node_id") -> tuple[Column, Column]:
    """Item i of n of a container."""
    w = Window.partitionBy(page, container)
    return F.row_number().over(w.orderBy(order)), F.count("*").over(w)
