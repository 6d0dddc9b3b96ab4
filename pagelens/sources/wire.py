"""Typed results of a remote SQL pipeline as rows, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = "array<struct<type:string,response:struct<type:string,result:struct<cols:array<struct<name:string>>,rows:array<array<struct<type:string,value:string,base64:string>>>>>,error:struct<message:string>>>"


def parse_results(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Adds ``results``; a payload that does not parse gives null."""
    return payloads.withColumn("results", F.from_json(json_col, RESULTS))


def decode_cell(cell: Column) -> Column:
    """A cell as text: null for null cells and for numbers that don't parse."""
    number = F.when(cell["type"] == "integer", cell["value"].try_cast("bigint").cast("string")).when(cell["type"] == "float", F.when(cell["value"].try_cast("double").isNotNull(), cell["value"]))
    return F.when(cell["type"] == "null", None).when(cell["type"].isin("integer", "float"), number).when(cell["type"] == "blob", F.coalesce(cell["base64"], cell["value"])).otherwise(cell["value"])


def decode_pipeline_results(parsed: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, stmt, row, values map<column, text>)`` of every statement that gave rows."""
    stmts = parsed.select(id_col, F.posexplode("results").alias("stmt", "r")).where("r.type = 'ok' and r.response.result is not null")
    rows = stmts.select(id_col, "stmt", F.transform("r.response.result.cols", lambda c: c["name"]).alias("cols"), F.posexplode("r.response.result.rows").alias("row", "cells"))
    return rows.select(id_col, "stmt", "row", F.map_from_arrays("cols", F.transform("cells", decode_cell)).alias("values"))


def decode_pipeline_errors(parsed: DataFrame, id_col: str = "id", statements: Column | None = None) -> DataFrame:
    """``(id, stmt, message)`` of the statements that failed; the close entry that ends a batch is not looked at."""
    many = F.size("results") - 1 if statements is None else statements
    rows = parsed.select(id_col, many.alias("many"), F.posexplode("results").alias("stmt", "r"))
    return rows.where("r.type = 'error' and stmt < many").select(id_col, "stmt", F.coalesce("r.error.message", F.lit("error")).alias("message"))


def encode_value(c: Column, kind: str) -> Column:
    """``{type, value}`` as JSON; ``kind`` is integer, float, boolean or text."""
    text = F.when(c, "1").otherwise("0") if kind == "boolean" else c.cast("string")
    name = {"boolean": "integer"}.get(kind, kind)
    return F.when(c.isNull(), F.to_json(F.struct(F.lit("null").alias("type")))).otherwise(F.to_json(F.struct(F.lit(name).alias("type"), text.alias("value"))))


def normalize_url(c: Column) -> Column:
    """Trimmed, without trailing slashes, with https where another or no scheme stands."""
    c = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", "")
    c = F.regexp_replace(c, "^(?i)libsql://", "https://")
    return F.when((c != "") & ~c.rlike("^(?i)https?://"), F.concat(F.lit("https://"), c)).otherwise(c)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def upgrade_https(url: Column) -> Column:
    """The URL with https in place of http."""
    return F.regexp_replace(url, "^(?i)http:", "https:")
