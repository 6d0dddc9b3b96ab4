"""Audits and pages as streams; these extend the batch operators, which they call on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..sources import pages as source
from ..sources.audits import NESTED, save_assessments, with_id


#: A batch with at most so many ids is sent to where the stored headers are; for more, both are dealt by id.
SENT_IDS = 500_000


def ingest(lines: DataFrame, batch: int | str, folder: str) -> None:
    """Store the audits of one batch, JSON text in ``value``, exactly once.

    An id that another batch has stored is left out, however long ago; of repeats within the batch the one with the earliest
    ``created_at`` stays, then the smallest text. Times are text and are kept as they are, also such as are no times. Lines
    that are no JSON object go to ``rejected``. A batch that comes again writes over its own folders, and its own
    ids don't count as stored, so a replay changes nothing.
    """
    spark = lines.sparkSession
    read = lines.select("value", F.from_json("value", f"{NESTED}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("a"))
    bad = F.col("a").isNull() | F.col("a.__bad").isNotNull() | ~F.coalesce(F.trim("value").startswith("{"), F.lit(False))
    read.where(bad).select("value").write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch}")
    audits = with_id(read.where(~bad).select("value", "a.*").drop("__bad"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("created_at"), "value"))
    audits = audits.withColumn("__n", first).where("__n = 1").drop("__n", "value")
    ids = audits.select("id")
    known = spark.read.parquet(f"{folder}/assessment").where(F.col("batch").cast("string") != str(batch)).select("id")
    if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:
        known = known.join(F.broadcast(ids), "id", "left_semi").distinct()
    save_assessments(audits.join(known, "id", "left_anti"), folder, str(batch))


def stream_audit_ingest(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Store a stream of audits as JSON text, all that is there now, each batch by :func:`ingest`. One stream writes to a store."""
    spark = lines.sparkSession
    save_assessments(spark.createDataFrame([], NESTED), folder, "none")
    return lines.writeStream.foreachBatch(lambda batch, k: ingest(batch, k, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compliance(situations: DataFrame) -> DataFrame:
    """Running ``(code, level, avg_score, n)`` of scored rows; for output in complete or update mode."""
    rows = situations.where("compliance_score is not null and code is not null and level is not null")
    return rows.groupBy("code", "level").agg(F.avg("compliance_score").alias("avg_score"), F.count("*").alias("n"))


def windowed_compliance(situations: DataFrame, time_col: str, window: str, late: str) -> DataFrame:
    """As :func:`compliance` by window of time; rows later than ``late`` are left out."""
    rows = situations.where("compliance_score is not null").withWatermark(time_col, late)
    return rows.groupBy(F.window(time_col, window), "code").agg(F.avg("compliance_score").alias("avg_score"), F.count("*").alias("n"))


def stream_page_audit(pages: DataFrame, folder: str, checkpoint: str, only: list[str] | None = None) -> StreamingQuery:
    """Report rows of pages as they come. Parsing and rules keep no state, so each micro-batch stands alone."""
    def put(batch: DataFrame, _: int) -> None:
        rules.audit_report(rules.run_rules(source.parse_pages(batch), only)).write.mode("append").parquet(folder)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
