"""The linear reading model of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elements import any_inside, attr, children, classes, filled, first_inside, inside, is_visible, node, selector, tag_in, text_of
from .documents import slug

# What a reader skips, and file types of links.
SKIP_TAGS = ("script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "button", "iframe")
SKIP_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "toolbar")
FILE_LINK = r"(?i)\.(pdf|docx?|pptx?|xlsx?|csv|txt|rtf|epub)(\?|#|$)"

BLOCK = "struct<node_id:int,part:int,type:string,level:int,text:string,src:string,href:string,name:string,ext:string,ordered:boolean,needs_desc:boolean,items:array<string>,headers:array<string>,rows:array<array<string>>,key:string>"


def reading_scope() -> Column:
    """The first main landmark or article, else the body."""
    first = lambda s: F.get(F.filter("nodes", selector(s)), F.lit(0))
    return F.coalesce(first("main, [role='main'], article"), first("body"))


def _block(x: Column, part: int = 0, **fields: Column | str) -> Column:
    names = [f.split(":")[0] for f in BLOCK[7:-1].replace("array<array<string>>", "a").split(",")]
    value = {"node_id": x["id"], "part": F.lit(part)} | {k: F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    return F.array(F.struct(*[value.get(n, F.lit(None)).alias(n) for n in names])).cast(f"array<{BLOCK}>")


def _none() -> Column:
    return F.array().cast(f"array<{BLOCK}>")


def _file_block(a: Column, part: int = 0) -> Column:
    href = F.coalesce(attr(a, "href"), F.lit(""))
    return _block(a, part, type="filelink", href=href, name=F.coalesce(F.nullif(text_of(a), F.lit("")), F.substring_index(href, "/", -1)), ext=F.lower(F.regexp_extract(href, FILE_LINK, 1)), key=F.concat(F.lit("file:"), href))


def _is_file(a: Column) -> Column:
    return (a["tag"] == "a") & F.coalesce(attr(a, "href").rlike(FILE_LINK), F.lit(False))


def _image(img: Column) -> Column:
    """``struct<keep, alt, needs>``: decorative images are not kept; a missing or file name alternative needs a description."""
    alt, role = attr(img, "alt"), attr(img, "role")
    side = lambda s: F.coalesce(attr(img, s).try_cast("double"), F.lit(0.0))
    tiny = side("width").between(1e-9, 32) | side("height").between(1e-9, 32)
    keep = ~(F.coalesce(alt == "", F.lit(False)) | F.coalesce(role.isin("presentation", "none"), F.lit(False)) | tiny)
    needs = ~filled(F.trim(alt)) | F.coalesce(F.trim(alt).rlike(r"(?i)\.(jpe?g|png|gif|webp|svg|tif)$"), F.lit(False))
    return F.struct(keep.alias("keep"), F.when(needs, "").otherwise(F.trim(alt)).alias("alt"), needs.alias("needs"))


def _table(t: Column) -> Column:
    cells = lambda tr: F.transform(inside(tr, lambda y: tag_in(y, "th", "td")), lambda c: text_of(c))
    trs = inside(t, lambda y: y["tag"] == "tr")
    in_part = lambda tag: F.flatten(F.transform(inside(t, lambda y: y["tag"] == tag), lambda p: inside(p, lambda y: y["tag"] == "tr")))
    head = F.get(F.concat(in_part("thead"), trs), F.lit(0))
    body = F.when(F.size(in_part("tbody")) > 0, in_part("tbody")).otherwise(trs)
    bare = ~any_inside(t, lambda y: y["tag"] == "thead")
    rows = F.filter(F.transform(body, lambda tr, i: F.struct(((i == 0) & bare & any_inside(tr, lambda y: y["tag"] == "th")).alias("head"), cells(tr).alias("cells"))), lambda r: ~r["head"])
    caption = text_of(first_inside(t, lambda y: y["tag"] == "caption"))
    return _block(t, type="table", text=F.coalesce(caption, F.lit("")), headers=F.coalesce(cells(head), F.array().cast("array<string>")), rows=F.transform(rows, lambda r: r["cells"]))


def _skipped(x: Column) -> Column:
    return ~is_visible(x) | tag_in(x, *SKIP_TAGS) | F.coalesce(attr(x, "role").isin(*SKIP_ROLES), F.lit(False))


def _is_graph(x: Column) -> Column:
    return classes(x).rlike("(?i)(chart|graph|plot|visuali[sz]ation)") | (x["tag"] == "canvas")


def _takes(x: Column) -> Column:
    """Whether an element takes what it holds with it, being a block or skipped; else it is walked into. Says so by its own
    fields alone."""
    block = x["tag"].rlike("^(h[1-6]|p|img|figure|table|ul|ol|blockquote|pre)$") | _is_graph(x) | _is_file(x)
    return _skipped(x) | block | (~x["blocky"] & (x["chars"] > 1))


def _blocks_of(x: Column) -> Column:
    """Blocks of an element that takes what it holds; null if it is walked into instead."""
    image, cap = _image(x), first_inside(x, lambda y: y["tag"] == "figcaption")
    pic = node(x["pic"])
    in_figure = _image(pic)
    text = text_of(x)
    figure = F.when(
        pic["id"].isNotNull(),
        _block(x, type="image", src=F.coalesce(attr(pic, "src"), F.lit("")), text=F.when(cap["id"].isNotNull(), text_of(cap)).when(in_figure["keep"], in_figure["alt"]).otherwise(""), needs_desc=F.when(cap["id"].isNotNull(), False).when(in_figure["keep"], in_figure["needs"]).otherwise(True)),
    ).when(cap["id"].isNotNull(), _block(x, type="para", text=text_of(cap), key=F.nullif(text_of(cap), F.lit("")))).otherwise(_none())
    files = F.flatten(F.transform(inside(x, _is_file), lambda a: _file_block(a, 1)))
    items = F.filter(F.transform(children(x, lambda y: y["tag"] == "li"), lambda y: text_of(y)), lambda s: s != "")
    para = lambda: _block(x, type="para", text=text, key=F.concat(F.lit("p:"), text))
    return (
        F.when(x["tag"].rlike("^h[1-6]$"), F.when(text != "", _block(x, type="heading", level=F.substring(x["tag"], 2, 1).cast("int"), text=text)).otherwise(_none()))
        .when(x["tag"] == "img", F.when(image["keep"], _block(x, type="image", src=F.coalesce(attr(x, "src"), F.lit("")), text=image["alt"], needs_desc=image["needs"])).otherwise(_none()))
        .when(x["tag"] == "figure", figure)
        .when(_is_graph(x), _block(x, type="graph", text=F.coalesce(F.nullif(F.substring(text, 1, 80), F.lit("")), F.lit("Data graphic")), needs_desc=F.lit(True)))
        .when(x["tag"] == "table", _table(x))
        .when(tag_in(x, "ul", "ol"), F.when(F.size(items) > 0, _block(x, type="list", ordered=x["tag"] == "ol", items=items)).otherwise(_none()))
        .when(_is_file(x), _file_block(x))
        .when(x["tag"] == "blockquote", _block(x, type="quote", text=text, key=F.concat(F.lit("q:"), text)))
        .when(x["tag"] == "pre", _block(x, type="code", text=text))
        .when(x["tag"] == "p", F.concat(F.when(text != "", para()).otherwise(_none()), files))
        .otherwise(F.concat(files, para()))
    )


def reading_blocks(parsed: DataFrame) -> DataFrame:
    """``(page_id, ix, type, level, text, ...)``: blocks of a page in reading order.

    The scope's elements are walked in document order; hidden ones and page furniture are left out with all they hold, and
    an element that yields blocks takes what it holds with it. An element's own fields say whether it takes what it holds, and
    it is reached unless an element above it does, so only the blocks' own elements are looked into, whose content doesn't overlap.
    Of paragraphs, quotes and file links with one key the first stays; keys are sorted within their page. ``ix`` rises within a page.
    """
    scoped = parsed.select("page_id", "nodes", "bits", reading_scope().alias("scope"))
    scoped = scoped.withColumn("takes", F.transform("nodes", lambda x: (x["id"] > F.col("scope.id")) & (x["id"] <= F.col("scope.end")) & _takes(x)))
    reached = lambda x: F.get("takes", x["id"] - 1) & ~F.exists(x["up"], lambda u: F.get("takes", u - 1)) & ~_skipped(x)
    rows = scoped.select("page_id", "nodes", "bits", F.filter("nodes", reached).alias("roots"))
    rows = rows.select("page_id", F.flatten(F.transform("roots", _blocks_of)).alias("blocks"))
    rows = rows.withColumn("keys", F.array_sort(F.filter(F.transform("blocks", lambda b, i: F.struct(b["key"].alias("key"), i.alias("i"))), lambda k: k["key"].isNotNull())))
    again = F.filter(F.transform("keys", lambda k, i: F.when(k["key"] == F.get("keys", i - 1)["key"], k["i"])), lambda i: i.isNotNull())
    each = rows.select("page_id", "blocks", F.array_sort(again).alias("gone")).select("page_id", _without(F.col("blocks"), F.col("gone")).alias("blocks"))
    return each.select("page_id", F.posexplode_outer("blocks").alias("ix", "b")).where("b is not null").select("page_id", "ix", "b.*").drop("key", "part", "node_id")


def _without(items: Column, gone: Column) -> Column:
    """``items`` without those at the sorted places ``gone``: the runs between them, put together."""
    ends = F.concat(gone, F.array(F.size(items)))
    runs = F.transform(ends, lambda e, k: F.slice(items, F.coalesce(F.get(gone, k - 1) + 2, F.lit(1)), e - F.coalesce(F.get(gone, k - 1) + 1, F.lit(0))))
    return F.flatten(runs)


def outline(blocks: DataFrame) -> DataFrame:
    """``(page_id, seq, level, text, slug)`` of the headings."""
    rows = blocks.where("type = 'heading'")
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy("ix")) - 1
    return rows.select("page_id", seq.alias("seq"), "level", "text").withColumn("slug", slug(F.col("text"), F.col("seq")))


def contents(headings: DataFrame, least: int = 3) -> DataFrame:
    """The outline of pages with at least ``least`` headings, indented by level."""
    n = F.count("*").over(Window.partitionBy("page_id"))
    return headings.withColumn("n", n).where(F.col("n") >= least).drop("n").withColumn("entry", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "text"))


def page_title(parsed: DataFrame, blocks: DataFrame, default: str = "Reading Room") -> DataFrame:
    own = F.nullif(text_of(F.get(F.filter("nodes", lambda x: x["tag"] == "title"), F.lit(0))), F.lit(""))
    heads = blocks.where("type = 'heading'").groupBy("page_id").agg(F.min_by("text", "ix").alias("heading"))
    return parsed.select("page_id", own.alias("own")).join(heads, "page_id", "left").select("page_id", F.coalesce("own", "heading", F.lit(default)).alias("title"))
