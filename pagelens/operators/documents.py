"""Positioned text to headings and paragraphs, and documents to HTML, cells and captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Titles and captions of documents that have none of their own.
UNTITLED, TEXT_TITLE, CSV_CAPTION, CSV_EMPTY = "Untitled document", "Text document", "Imported spreadsheet data", "Empty file."
# What counts as white space at the ends of a text.
_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_NOT_BLANK = f"[^{_SPACE}]"


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a plain expression is worked out wherever it is written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def upper_median(values: Column) -> Column:
    """Item at place floor(n / 2) of the sorted items that aren't null, 0 for none."""
    middle = lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int"))
    return F.coalesce(_let(F.sort_array(F.filter(values, lambda v: v.isNotNull())), middle), F.lit(0.0))


def group_text_lines(items: DataFrame, gap: float = 2.0) -> DataFrame:
    """Lines of ``items(doc_id, page, seq, x, y, size, str)``: ``(doc_id, page, line, text, size)``, top first.

    Items come in order of ``seq``. The first one of a line fixes its baseline, rounded half up; a later one joins a line whose
    baseline is within ``gap``, and begins one where there is none. Of several such lines it joins the highest, or, where
    baselines below 0 are among them, the newest of these. Parts of a line are joined by x without spaces. Items are dealt by
    page once and gathered by baseline; only a page's different baselines are walked, and items are looked at one by one only
    where their baseline is near several lines.
    """
    rows = items.where(F.col("str").rlike(_NOT_BLANK)).withColumn("y", F.floor(F.col("y") + 0.5).cast("double"))
    of_y = rows.repartition("doc_id", "page").groupBy("doc_id", "page", "y").agg(F.min("seq").alias("first"), F.collect_list(F.struct("x", "seq", "str", "size")).alias("items"))
    pages = of_y.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("first", "y", "items"))).alias("ys"))
    near = lambda k, y: F.abs(k["y"] - y) <= gap
    # whether a baseline begins a line is settled when it first occurs
    walked = F.transform("ys", lambda b: F.struct(b["first"].alias("first"), b["y"].alias("y")))
    none = F.slice(walked, 1, 0)
    begun = F.aggregate(walked, none, lambda keys, b: F.when(F.exists(keys, lambda k: near(k, b["y"])), keys).otherwise(F.array_append(keys, b)))
    numbered = lambda keys: _let(F.reverse(F.sort_array(F.transform(keys, lambda k: k["y"]))), lambda order: F.transform(keys, lambda k: F.struct(k["first"].alias("first"), k["y"].alias("y"), F.array_position(order, k["y"]).alias("line"))))
    each = pages.withColumn("keys", _let(begun, numbered)).select("doc_id", "page", "keys", F.explode_outer("ys").alias("b"))
    each = each.select("doc_id", "page", "b", F.filter("keys", lambda k: near(k, F.col("b.y"))).alias("met"))

    def line_of(i: Column) -> Column:
        newest = lambda live, below: F.when(F.size(below) > 0, F.element_at(below, -1)["line"]).otherwise(F.array_min(F.transform(live, lambda k: k["line"])))
        begun = F.filter("met", lambda k: (k["first"] < i["seq"]) | ((k["first"] == i["seq"]) & (k["y"] <= F.col("b.y"))))
        return _let(begun, lambda live: _let(F.filter(live, lambda k: k["y"] < 0), lambda below: newest(live, below)))

    several = _let(F.transform("b.items", lambda i: F.struct(line_of(i).alias("line"), i.alias("i"))), lambda placed: F.transform("met", lambda k: F.struct(k["line"].alias("line"), F.transform(F.filter(placed, lambda p: p["line"] == k["line"]), lambda p: p["i"]).alias("items"))))
    # the one line that is near has begun by then, as the baseline else would have begun one
    one = F.transform("met", lambda k: F.struct(k["line"].alias("line"), F.col("b.items").alias("items")))
    each = each.select("doc_id", "page", F.when(F.size("met") == 1, one).otherwise(several).alias("p")).select("doc_id", "page", F.explode_outer("p").alias("p")).select("doc_id", "page", "p.line", "p.items")
    made = lambda parts: F.struct(collapse_ws(F.array_join(F.transform(parts, lambda p: p["str"]), "")).alias("text"), upper_median(F.transform(parts, lambda p: p["size"])).alias("size"))
    lines = each.groupBy("doc_id", "page", "line").agg(_let(F.sort_array(F.flatten(F.collect_list("items"))), made).alias("t"))
    return lines.select("doc_id", "page", "line", "t.text", "t.size").where("text <> ''")


def body_size(items: DataFrame) -> DataFrame:
    """``(doc_id, body)``: upper median of the sizes of a document's items, 10 where that is 0. Counted by size first, so
    that a long document's items don't meet in one list."""
    sizes = items.where(F.length(F.trim("str")) > 0).groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("size")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("n").over(Window.partitionBy("doc_id"))
    found = sizes.withColumn("upto", upto).withColumn("all", all_).where(F.col("upto") > F.floor(F.col("all") / 2))
    return found.groupBy("doc_id").agg(F.min("size").alias("body")).withColumn("body", F.when(F.col("body") == 0, 10.0).otherwise(F.col("body")))


def classify_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Adds ``level``: 1 to 3 for headings by size against the body's, null for the rest."""
    ratio = F.col("size") / F.col("body")
    level = F.when((ratio >= 1.25) & (F.length("text") < 120), F.when(ratio >= 1.9, 1).when(ratio >= 1.5, 2).otherwise(3))
    return lines.join(body, "doc_id").withColumn("level", level)


def build_paragraphs(lines: DataFrame) -> DataFrame:
    """``(doc_id, ix, type, level, text)``: lines run together until one ends a sentence, a heading comes or the page ends."""
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    before = lambda c: F.lag(c).over(w)
    new = F.col("level").isNotNull() | before("level").isNotNull() | before("text").rlike(r"[.!?:]$") | (before("page") != F.col("page"))
    rows = lines.withColumn("block", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("page", "line", "text")))
    out = rows.groupBy("doc_id", "block").agg(F.max("level").alias("level"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    return out.select("doc_id", F.col("block").cast("int").alias("ix"), F.when(F.col("level").isNull(), "p").otherwise("h").alias("type"), "level", "text")


def document_title(nodes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """``(doc_id, title)``: the metadata's title, the first heading, or a default."""
    first = nodes.groupBy("doc_id").agg(F.min_by("text", F.when(F.col("type") == "h", F.col("ix"))).alias("heading"))
    if meta is not None:
        first = first.join(meta.select("doc_id", F.nullif(F.trim("title"), F.lit("")).alias("given")), "doc_id", "left")
    given = F.col("given") if meta is not None else F.lit(None).cast("string")
    return first.select("doc_id", F.coalesce(given, "heading", F.lit(UNTITLED)).alias("title"))


def render_html(nodes: DataFrame, titles: DataFrame, lang: str = "en") -> DataFrame:
    """``(doc_id, html)``: one article per document, headings one level down."""
    def one(n: Column) -> Column:
        tag = F.when(n["type"] == "h", F.concat(F.lit("h"), (n["level"] + 1).cast("string"))).otherwise("p")
        return F.concat(F.lit("<"), tag, F.lit(">"), html_escape(n["text"]), F.lit("</"), tag, F.lit(">"))

    body = nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ix", "type", "level", "text"))), one), "\n").alias("body"))
    return titles.join(body, "doc_id", "left").select("doc_id", F.concat(F.lit(f'<article lang="{lang}">\n<h1>'), html_escape(F.col("title")), F.lit("</h1>\n"), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit("</article>")).alias("html"))


def paragraphs_of(text: Column) -> Column:
    """Paragraphs between runs of two or more line ends."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{2,}")


def text_to_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(paragraphs_of(F.coalesce(F.col(text_col), F.lit("")))).alias("ix", "paragraph"))


def text_to_html(text: Column, lang: str = "en") -> Column:
    each = F.transform(paragraphs_of(text), lambda p: F.concat(F.lit("<p>"), F.replace(html_escape(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.concat(F.lit(f'<article lang="{lang}"><h1>{TEXT_TITLE}</h1>'), F.array_join(each, ""), F.lit("</article>"))


#: A run in quotes, in which a doubled quote stands for one, and which may lack its end; a comma; a line feed; other characters.
_CSV_TOKEN = r'"[^"]*+(?:""[^"]*+)*+"?+|,|\n|[^",\n]++'


def _parts(tokens: Column, between: str) -> Column:
    """Runs of tokens between those that are ``between``; one more than there are of these."""
    at = F.concat(F.array(F.lit(-1)), F.filter(F.transform(tokens, lambda t, i: F.when(t == between, i)), lambda i: i.isNotNull()))
    return F.transform(at, lambda a, k: F.slice(tokens, a + 2, F.coalesce(F.get(at, k + 1), F.size(tokens)) - a - 1))


def csv_rows(text: Column) -> Column:
    """Rows of cells of a CSV text.

    A quote begins a run of characters that are taken as they are, anywhere in a cell, up to the next quote that isn't doubled,
    or to the end of the text. Outside of such runs a comma ends a cell, a line feed a row, and carriage returns are
    dropped. Rows of blank cells go.
    """
    run = lambda t: F.replace(F.regexp_extract(t, r'(?s)^"(.*?)"?\z', 1), F.lit('""'), F.lit('"'))
    ended = lambda t: F.when(t.startswith('"'), run(t)).otherwise(F.replace(t, F.lit("\r"), F.lit("")))
    cells = lambda row: F.transform(_parts(row, ","), lambda cell: F.array_join(F.transform(cell, ended), ""))
    rows = F.transform(_parts(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CSV_TOKEN), F.lit(0)), "\n"), cells)
    return F.filter(rows, lambda r: F.exists(r, lambda c: c.rlike(_NOT_BLANK)))


def csv_to_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, col, value, scope)`` of CSV texts, see :func:`csv_rows`. The first row's cells are column headers, the first
    cell of other rows is a row header."""
    cells = docs.select(id_col, F.posexplode(csv_rows(F.col(text_col))).alias("row", "r")).select(id_col, "row", F.posexplode("r").alias("col", "value"))
    return cells.withColumn("scope", F.when(F.col("row") == 0, "col").when(F.col("col") == 0, "row"))


def csv_to_html(text: Column, lang: str = "en") -> Column:
    """A CSV text as a table with header cells; a note where it has no rows."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), html_escape(c), F.lit(f"</{tag.split()[0]}>"))
    row = lambda r, make: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, make), ""), F.lit("</tr>"))
    rows = csv_rows(text)
    head = row(F.get(rows, F.lit(0)), lambda c: cell('th scope="col"', c))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: row(r, lambda c, i: F.when(i == 0, cell('th scope="row"', c)).otherwise(cell("td", c))))
    made = F.concat(F.lit(f'<table lang="{lang}"><caption>{CSV_CAPTION}</caption><thead>'), head, F.lit("</thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table>"))
    return F.when(F.size(rows) > 0, made).otherwise(f"<p>{CSV_EMPTY}</p>")


def vtt_time(seconds: Column) -> Column:
    t = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))
    part = lambda c: F.floor(c).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d", part(t / 3600), part((t % 3600) / 60), part(t % 60), part((t - F.floor(t)) * 1000))


def segments_to_vtt(segments: DataFrame) -> DataFrame:
    """``(media_id, vtt)`` from ``segments(media_id, seq, start, end, text)``."""
    cue = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), vtt_time(s["start"]), F.lit(" --> "), vtt_time(s["end"]), F.lit("\n"), F.trim(F.coalesce(s["text"], F.lit(""))), F.lit("\n"))
    cues = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))), cue)
    return segments.groupBy("media_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n")).alias("vtt"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """``(media_id, text)``: the segments joined by spaces; none for media without words."""
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda s: s["t"]), " "))
    return segments.groupBy("media_id").agg(text.alias("text")).where("text <> ''")


def slug(text: Column, seq: Column) -> Column:
    """Up to 40 letters and digits with hyphens, and the number that tells equal ones apart."""
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40)
    return F.concat(F.lit("rr-"), F.when(base == "", "sec").otherwise(base), F.lit("-"), seq.cast("string"))


def safe_name(text: Column) -> Column:
    name = F.substring(F.regexp_replace(F.coalesce(F.nullif(text, F.lit("")), F.lit("document")), r"[^\w.-]+", "_"), 1, 60)
    return F.when(name == "", "document").otherwise(name)
