"""Page-audit rules: what each finds, what it would change and what it reports.

Rules run over one row per page (see ``sources.pages``) in a fixed order, and later rules see what earlier ones set. A rule
yields changes ``(node_id, attr, old, new)`` and report entries; inserted elements are changes of ``#insert`` and are not
seen by later rules.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as SF

from ..dims import RULES
from ..functions import sqltext as F
from ..functions.elements import (
    any_above, any_inside, attr, children, class_like, classes, displayed, explicit_name, filled, first_inside, has_attr, has_name, inside, is_decorative, next_sibling, node, pixels, selector, tag_in, text_of,
)
from ..functions.sqltext import Sql as Column

CHANGE = "array<struct<node_id:int,attr:string,new:string>>"
ENTRY = "array<struct<kind:string,count:bigint,msg:string>>"
# What is kept of a page: changes, report entries, and how many changes each rule made.
LOG = "array<struct<node_id:int,rule_id:string,code:string,attr:string,old:string,new:string,pack_id:string>>"
SAID = "array<struct<rule_id:string,code:string,level:string,kind:string,count:bigint,msg:string,pack_id:string>>"
COUNTED = "array<struct<rule_id:string,n:bigint>>"
#: Attribute that lists the codes an element was touched for.
MARK = "data-audit"

# File types that links are named for.
FILE_TYPES = {
    "pdf": "PDF", "doc": "Word", "docx": "Word", "ppt": "PowerPoint", "pptx": "PowerPoint", "xls": "Excel", "xlsx": "Excel",
    "csv": "CSV", "txt": "text", "rtf": "rich text", "epub": "EPUB e-book", "zip": "ZIP archive", "mp3": "audio", "mp4": "video",
}
# What an icon's class or id says, first match first.
ICONS = [
    ("search|magnif|fa-search|icon-search", "Search"), ("menu|hamburger|fa-bars|icon-menu", "Menu"), ("close|fa-times|fa-xmark|icon-close", "Close"),
    ("filter|fa-filter", "Filters"), ("download|fa-download", "Download"), ("print|fa-print", "Print"), ("share|fa-share", "Share"),
    ("next|fa-chevron-right|fa-arrow-right", "Next"), ("prev|fa-chevron-left|fa-arrow-left", "Previous"), ("home|fa-home", "Home"), ("info|fa-info|help|fa-question", "Help"),
]
# Selectors.
DISCLOSURE = "[class*='accordion'] [class*='header'], [class~='acc'] [class*='header'], [class*='collaps'] [class*='header'], [class*='toggle'], [data-toggle], [class*='expand'], .collapsible, [class*='read-more']"
SEARCH_BOX = "input[type='search'], input[role='searchbox'], input[name*='search'], input[id*='search'], input[placeholder*='earch']"
SUGGESTIONS = "ul, ol, [role='listbox'], [class*='suggest'], [class*='autocomplete']"
CLEARABLE = "input[type='search'], input[name*='search'], input[id*='search']"
CLEAR = "[class*='clear'], [class*='reset'], .close, [id*='clear' i], .x, [aria-label*='clear' i]"
CLOSE = "[class*='close'], [aria-label*='close' i], .x, button[data-dismiss]"
TITLE = "h1, h2, h3, h4, a, [class*='title']"
RESULT = "[role='listitem'], [class*='result-item'], [class*='result'] li, article[class*='item']"
RESULTS = "[role='list'][class*='result'], [class*='results'], #results, [data-results]"
RESULT_ITEM = "[role='listitem'], li, [class*='result-item'], article"
PAGE_CONTROL = "[class*='page-next'], [class*='next-page'], [class*='page-prev'], [class*='prev-page']"
PLAYER = "iframe[src*='youtube.com'], iframe[src*='youtube-nocookie.com'], iframe[src*='player.vimeo.com']"

# What the report says of each rule; a fix begins with its number where the text begins with a space.
FIXES = {
    "file-links": " file link(s) labelled with format/size.",
    "images-alt": " image(s) reviewed; {} need real descriptions.",
    "graphs-longdesc": " graphic(s) given a role and a long-description slot.",
    "collection-items": " collection/result group(s) exposed as named lists.",
    "disclosure": " disclosure control(s) given expand/collapse semantics.",
    "autocomplete": " search field(s) wired as accessible comboboxes.",
    "landmarks": "Structure landmarks/skip link added and navigation labelled.",
    "filter-groups": " filter group(s) labelled.",
    "result-relevance": " result(s) given descriptive names for relevance judging.",
    "clear-search": " clear-search control(s) made an accessible button.",
    "dialog-escape": " open item/modal(s) marked as dialogs.",
    "back-affordance": " breadcrumb(s) landmarked for retracing.",
    "icon-buttons": " icon-only control(s) given names.",
    "search-regions": " search region(s) given distinct labels.",
    "help-affordance": " help/support link(s) labelled for discoverability.",
    "pagination": " pager(s) landmarked with current-page + announcements.",
    "results-status": "Results status/heading/skip link + per-result position added.",
    "within-item-nav": " item viewer(s) given labelled page controls.",
    "authorized-features": " restricted control(s) marked with reason.",
    "form-fields": " form field(s) labelled or marked required.",
}
FLAGS = {
    "no alt": "Image missing alt text — needs a human/AI description.",
    "large": 'Large image marked decorative (alt="") — confirm it is not conveying content.',
    "file alt": "Alt text looks like a filename, not a description.",
    "graphic": "Graphic needs a text long-description (trend, axes, takeaway).",
    "no h1": "Page has no <h1> — add a top-level heading.",
    "icon": "Icon control with no discernible name.",
    "captions": " lacks captions/transcript",
    "player": "Embedded video (captions live in the player)",
    "non-img": " non-<img> image(s) (SVG / canvas / CSS background) need a text alternative.",
    "no label": " form field(s) still need a human-written label.",
}
# Names given to elements.
LABELS = {
    "image": "Image — description needed", "graphic": "Graphic — data description needed", "button": "Button — label needed", "nav": "Main navigation", "breadcrumb": "Breadcrumb",
    "clear": "Clear search", "close": "Close", "pager": "Pagination", "next": "Next page", "prev": "Previous page", "results": "Search results", "help": "Help and support",
    "collection": "Search within this collection", "library": "Search the whole library", "section": "Search this section", "locked": " — sign in to use this feature", "video": "Embedded video",
}

# Notes behind a link's text, texts that say nothing of what is linked, alternatives that are names of files, and
# classes of cards, of searches within a part, and of searches of all.
LINK_NOTE = r"(?i)\s*\((opens|pdf|docx|word|download).*?\)\s*$"
GENERIC_LINK = r"(?i)^(here|click here|click|read more|more|link|this|download|view|view here|open)$"
FILE_ALT = (r"(?i)\.(jpe?g|png|gif|webp|svg)$", r"(?i)^(image|img|dsc|screenshot)[-_ ]?\d*$")
CARD = "(?i)(card|item|result|tile|entry)"
WITHIN, SITEWIDE = "(?i)collection|within|this", "(?i)all|site|global"
HELP_SAID, HELP_HREF = "(?i)help|faq|support|assist|how to", "(?i)help|faq|support"

#: Fields of an element.
FIELDS = "id parent prev end depth ix tag attrs up t0 tn seen chars a label nav title pic ctl blocky".split()

_numbers = itertools.count()


class Kept(Column):
    """An expression that is worked out once a page and then read as a column."""

    def __init__(self, of: Column):
        super().__init__(f"`__k{next(_numbers)}`")
        self.of = of


Changes = Callable[[Column], Column]


def _sets(x: Column, **values: Column | str | None) -> Column:
    """Changes of one element; a null value changes nothing. ``_`` in a name stands for ``-``."""
    rows = [F.struct(x["id"].alias("node_id"), F.lit(k.replace("_", "-")).alias("attr"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("new")) for k, v in values.items()]
    return F.filter(F.array(*rows).cast(CHANGE), lambda c: c["new"].isNotNull())


def _if(test: Column, value: Column | str) -> Column:
    return F.when(test, F.lit(value) if isinstance(value, str) else value)


def _marked(x: Column, code: str) -> Column:
    return F.coalesce(attr(x, MARK), F.lit("")).contains(code)


def _mark(x: Column, code: str) -> Column:
    """The code to add to the element's list; null if it is there already."""
    return F.when(~F.array_contains(F.split(F.coalesce(attr(x, MARK), F.lit("")), " "), code), code)


def _entries(*rows: tuple[str, Column, Column | None, Column | str]) -> Column:
    """Entries ``(kind, times, count, msg)``: each as often as ``times`` says."""
    made = [F.array_repeat(F.struct(F.lit(kind).alias("kind"), (F.lit(None) if count is None else count).cast("bigint").alias("count"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg")), times.cast("int")) for kind, times, count, msg in rows]
    return F.concat(*made).cast(ENTRY)


def _fix(n: Column, tail: str) -> tuple[str, Column, Column, Column]:
    return ("fix", (n > 0).cast("int"), n, F.concat(n.cast("string"), F.lit(tail)))


def file_extension(href: Column) -> Column:
    """Letters and digits after the last dot of a link, before ``?`` and ``#``; null without."""
    ext = F.lower(F.regexp_extract(F.coalesce(href, F.lit("")), r"\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1))
    return F.when(ext != "", ext)


def file_type(ext: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv]), ext)


def human_size(size: Column) -> Column:
    """1024-based: bytes as they are, the rest with one decimal, up to GB."""
    n = size.cast("double")
    unit = lambda k, u: F.format_string(f"%.1f {u}", n / 1024.0**k)
    whole = F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    return F.when(n < 1024, F.concat(whole, F.lit(" bytes"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def name_from_file(href: Column) -> Column:
    base = F.regexp_replace(F.substring_index(F.regexp_extract(href, r"^[^?#]*", 0), "/", -1), r"(?i)\.[a-z0-9]+$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[-_]+", " "), r"(?U)\s+", " "))


def link_name(x: Column) -> Column:
    """What a file link is called: its text without a trailing note, or the file's name where the text is generic."""
    label = F.coalesce(F.nullif(text_of(x), F.lit("")), F.when(attr(x, "aria-label") != "", attr(x, "aria-label")), F.lit("File"))
    name = F.regexp_replace(label, LINK_NOTE, "")
    generic = F.trim(name).rlike(GENERIC_LINK)
    base = name_from_file(attr(x, "href"))
    return F.when(generic & (base != ""), base).otherwise(name)


def icon_label(text: Column) -> Column:
    out = None
    for pattern, name in ICONS:
        test = text.rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


@dataclass
class Step:
    """What a rule found on a page: the changes, entries from the whole page, how many, and what these read as columns."""

    changes: Column
    entries: Column
    n: Column
    kept: list[Kept] = field(default_factory=list)


def _each(found: Column, of: Changes) -> Column:
    return F.flatten(F.transform(found, of)).cast(CHANGE)


def _nodes(test: Callable[[Column], Column]) -> Column:
    return F.filter("nodes", test)


def file_links() -> Step:
    found = Kept(_nodes(lambda x: (x["tag"] == "a") & has_attr(x, "href") & file_type(file_extension(attr(x, "href"))).isNotNull() & ~_marked(x, "ACC1")))

    def of(x: Column) -> Column:
        size = F.when(filled(attr(x, "data-size")), human_size(attr(x, "data-size").try_cast("double")))
        new = F.coalesce(attr(x, "target") == "_blank", F.lit(False))
        name = F.concat(link_name(x), F.lit(", "), file_type(file_extension(attr(x, "href"))), F.lit(" file"), F.coalesce(F.concat(F.lit(", "), size), F.lit("")), F.when(new, " (opens in new window)").otherwise(""))
        rel = F.coalesce(attr(x, "rel"), F.lit(""))
        return _sets(x, aria_label=name, rel=F.when(new & ~rel.contains("noopener"), F.trim(F.concat(rel, F.lit(" noopener")))), **{MARK: _mark(x, "ACC1")})

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["file-links"])), n, [found])


def _filename_alt(alt: Column) -> Column:
    return F.trim(alt).rlike(FILE_ALT[0]) | F.trim(alt).rlike(FILE_ALT[1])


def images_alt() -> Step:
    def decorative(x: Column) -> Column:
        return F.coalesce(node(x["a"])["chars"] > 0, F.lit(False)) | pixels(x, "width").between(1, 24)

    kind = lambda x: F.when(attr(x, "alt").isNull(), F.when(decorative(x), "aside").otherwise("missing")).when(F.trim(attr(x, "alt")) == "", F.when(~decorative(x) & (pixels(x, "width") >= 150) & (pixels(x, "height") >= 100) & (pixels(x, "width") * pixels(x, "height") >= 30000), "large")).when(_filename_alt(attr(x, "alt")), "file")
    found = Kept(F.filter(F.transform(_nodes(lambda x: x["tag"] == "img"), lambda x: F.struct(x.alias("x"), kind(x).alias("k"))), lambda r: r["k"].isNotNull()))

    def of(r: Column) -> Column:
        x, k = r["x"], r["k"]
        return _sets(x, alt=_if(k == "aside", ""), role=F.when(k == "aside", "presentation").when(k == "missing", "img"), aria_label=_if(k == "missing", LABELS["image"]), data_needs_alt=_if(k != "aside", "1"), **{MARK: F.when(k == "aside", _mark(x, "RED2")).otherwise(_mark(x, "ACC2"))})

    def flag(r: Column) -> Column:
        msg = F.when(r["k"] == "missing", FLAGS["no alt"]).when(r["k"] == "large", FLAGS["large"]).when(r["k"] == "file", FLAGS["file alt"])
        return F.struct(F.lit("flag").alias("kind"), F.lit(None).cast("bigint").alias("count"), msg.alias("msg"))

    flags = F.transform(F.filter(found, lambda r: r["k"] != "aside"), flag).cast(ENTRY)
    n = F.size(found)
    summary = _entries(("fix", (n > 0).cast("int"), n, F.replace(F.concat(n.cast("string"), F.lit(FIXES["images-alt"])), F.lit("{}"), F.size(flags).cast("string"))))
    return Step(_each(found, of), F.concat(flags, summary), n, [found])


def _slot(x: Column) -> Column:
    """Id of the element that takes a graphic's description."""
    return F.concat(F.lit("desc-"), x["id"].cast("string"))


def graphs() -> Step:
    plain = lambda x: tag_in(x, "svg", "canvas", "img")

    def test(x: Column) -> Column:
        asked = (x["tag"] == "canvas") | class_like(x, "chart", "graph", "plot", "visualization")
        text_box = (x["chars"] > 200) | (x["ctl"] > 0)
        return asked & ~tag_in(x, "a", "button", "input", "select") & (plain(x) | ~text_box) & ~_marked(x, "ACC3")

    found = Kept(_nodes(test))

    def of(x: Column) -> Column:
        drawn = tag_in(x, "svg", "canvas")
        slot = _slot(x)
        return _sets(x, role=F.when(drawn | (~plain(x) & ~filled(attr(x, "role"))), "img"), aria_label=_if(drawn & ~has_name(x), LABELS["graphic"]), aria_describedby=F.trim(F.concat(F.coalesce(attr(x, "aria-describedby"), F.lit("")), F.lit(" "), slot)), **{MARK: _mark(x, "ACC3"), "#insert": F.concat(F.lit("details#"), slot)})

    n = F.size(found)
    return Step(_each(found, of), _entries(("flag", n, None, FLAGS["graphic"]), _fix(n, FIXES["graphs-longdesc"])), n, [found])


def collection_items() -> Step:
    kids = lambda x: children(x, lambda y: classes(y).rlike(CARD))
    found = Kept(F.filter(F.transform(_nodes(lambda x: (class_like(x, "results", "collection", "grid") | (x["tag"] == "ul") & class_like(x, "items") | has_attr(x, "data-results")) & ~F.coalesce(attr(x, "role") == "list", F.lit(False))), lambda x: F.struct(x.alias("x"), kids(x).alias("kids"))), lambda r: F.size(r["kids"]) >= 2))

    def of(r: Column) -> Column:
        def kid(y: Column, i: Column) -> Column:
            title = first_inside(y, selector(TITLE))
            name = F.concat(text_of(title), F.lit(", item "), (i + 1).cast("string"), F.lit(" of "), F.size(r["kids"]).cast("string"))
            return _sets(y, role="listitem", aria_label=F.when(~has_name(y), name))

        return F.concat(_sets(r["x"], role="list", **{MARK: _mark(r["x"], "ACC4")}), F.flatten(F.transform(r["kids"], kid)))

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["collection-items"])), n, [found])


def disclosure() -> Step:
    test = selector(DISCLOSURE)
    found = Kept(_nodes(lambda x: test(x) & (x["tag"] != "summary") & ~_marked(x, "ACC5")))
    ids = Kept(F.transform("nodes", lambda y: F.coalesce(attr(y, "id"), F.lit(""))))

    def of(x: Column) -> Column:
        to = F.coalesce(*[F.when(filled(attr(x, a)), attr(x, a)) for a in ("data-target", "aria-controls", "href")])
        named = F.when(to.startswith("#") & (F.length(to) > 1), node(F.array_position(ids, F.substring(to, 2, 1000)).cast("int")))
        # a description slot that an earlier rule put behind a graphic is what follows it now, and is shown
        slot = F.when(named["id"].isNull() & _marked(x, "ACC3") & attr(x, "aria-describedby").endswith(_slot(x)), _slot(x))
        target = F.coalesce(named, next_sibling(x))
        native = tag_in(x, "button", "a")
        panel = F.coalesce(slot, F.when(filled(attr(target, "id")), attr(target, "id")), F.concat(F.lit("panel-"), target["id"].cast("string")))
        shown = slot.isNotNull() | F.coalesce(displayed(target) & target["id"].isNotNull(), F.lit(False))
        return _sets(x, role=_if(~native, "button"), tabindex=_if(~native & ~has_attr(x, "tabindex"), "0"), aria_expanded=shown.cast("string"), aria_controls=panel, **{MARK: _mark(x, "ACC5")})

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["disclosure"])), n, [found, ids])


def _in_parent(x: Column, test: Callable[[Column], Column]) -> Column:
    """First element below the parent of ``x`` that meets ``test``."""
    return first_inside(node(x["parent"]), test)


def autocomplete() -> Step:
    test, listed = selector(SEARCH_BOX), selector(SUGGESTIONS)
    found = Kept(F.filter(F.transform(_nodes(lambda x: test(x) & ~_marked(x, "ACC6")), lambda x: F.struct(x.alias("x"), _in_parent(x, listed).alias("to"))), lambda r: r["to"].isNotNull()))

    def of(r: Column) -> Column:
        x, to = r["x"], r["to"]
        name = F.coalesce(F.when(filled(attr(to, "id")), attr(to, "id")), F.concat(F.lit("suggest-"), to["id"].cast("string")))
        return F.concat(_sets(x, role="combobox", aria_autocomplete="list", aria_expanded="false", aria_controls=name, **{MARK: _mark(x, "ACC6")}), _sets(to, role="listbox"))

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["autocomplete"])), n, [found])


def landmarks() -> Step:
    first = lambda s: Kept(F.get(_nodes(selector(s)), F.lit(0)))
    skip = Kept(F.exists("nodes", selector("a[href='#page-main'], a.skip-link")))
    main, other, body = first("main, [role='main']"), first("#content, .content, #main, article"), first("body")
    target = F.coalesce(main, other, body)
    put = ~skip & target["id"].isNotNull()
    made = F.when(put, F.concat(_sets(target, role=_if(main.isNull() & other.isNotNull(), "main"), **{"#insert": "a.skip-link"}))).otherwise(F.array().cast(CHANGE))
    navs = Kept(F.filter(F.transform(_nodes(lambda x: x["tag"] == "nav"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda r: ~filled(attr(r["x"], "aria-label")) & ~filled(attr(r["x"], "aria-labelledby"))))

    def of(r: Column) -> Column:
        head = first_inside(r["x"], lambda y: tag_in(y, "h1", "h2", "h3"))
        return _sets(r["x"], aria_label=F.when(head["id"].isNotNull(), text_of(head)).when(r["i"] == 0, LABELS["nav"]).otherwise(F.concat(F.lit("Navigation "), (r["i"] + 1).cast("string"))), **{MARK: _mark(r["x"], "COM1")})

    n = F.size(navs) + put.cast("int")
    bare = ~F.exists("nodes", lambda x: x["tag"] == "h1")
    entries = _entries(("flag", bare.cast("int"), None, FLAGS["no h1"]), ("fix", (n > 0).cast("int"), n, FIXES["landmarks"]))
    return Step(F.concat(made, _each(navs, of)), entries, n, [skip, main, other, body, navs])


def filter_groups() -> Step:
    box = selector("input[type='checkbox'], input[type='radio']")
    found = Kept(_nodes(lambda x: (class_like(x, "filter", "facet") | (x["tag"] == "fieldset")) & ~_marked(x, "COM2") & (F.size(inside(x, box)) >= 2)))

    def of(x: Column) -> Column:
        head = first_inside(x, selector("legend, h2, h3, h4, [class*='title'], [class*='label']"))
        bare = ~filled(attr(x, "aria-label")) & ~filled(attr(x, "aria-labelledby"))
        return _sets(x, role=_if((x["tag"] != "fieldset") & (F.coalesce(attr(x, "role"), F.lit("")) != "group"), "group"), aria_label=F.when(bare, F.concat(F.coalesce(text_of(head), F.lit("Filter")), F.lit(" filter"))), **{MARK: _mark(x, "COM2")})

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["filter-groups"])), n, [found])


def result_relevance() -> Step:
    test, title = selector(RESULT), selector(TITLE)
    found = Kept(_nodes(lambda x: test(x) & ~has_attr(x, "data-result-named") & any_inside(x, title)))

    def of(x: Column) -> Column:
        part = lambda s: F.nullif(text_of(first_inside(x, selector(s))), F.lit(""))
        name = F.concat_ws(". ", part(TITLE), part("[class*='format'], [class*='type'], [class*='badge']"), F.nullif(F.substring(part("p, [class*='desc'], [class*='snippet'], [class*='abstract']"), 1, 120), F.lit("")))
        return _sets(x, aria_label=F.when((name != "") & ~has_name(x), name), data_result_named="1", **{MARK: _mark(x, "EVA1")})

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["result-relevance"])), n, [found])


def clear_search() -> Step:
    test, clear = selector(CLEARABLE), selector(CLEAR)
    found = F.filter(F.transform(_nodes(test), lambda x: _in_parent(x, clear)), lambda y: y.isNotNull() & ~_marked(y, "EXE1"))
    found = Kept(F.transform(F.array_distinct(F.transform(found, lambda y: y["id"])), lambda k: node(k)))

    def of(y: Column) -> Column:
        native = y["tag"] == "button"
        return _sets(y, role=_if(~native, "button"), tabindex=_if(~native & ~has_attr(y, "tabindex"), "0"), aria_label=_if(~has_name(y), LABELS["clear"]), **{MARK: _mark(y, "EXE1")})

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["clear-search"])), n, [found])


def dialogs() -> Step:
    test = selector("[role='dialog'], [class*='modal'], [class*='lightbox'], [class*='overlay'], dialog")
    found = Kept(_nodes(lambda x: test(x) & ~_marked(x, "EXE2") & displayed(x)))
    tops = Kept(_nodes(lambda y: F.coalesce(node(y["parent"])["tag"] == "body", F.lit(False))))

    def of(x: Column) -> Column:
        close = first_inside(x, selector(CLOSE))
        return F.concat(_sets(x, role=F.coalesce(F.when(filled(attr(x, "role")), attr(x, "role")), F.lit("dialog")), aria_modal="true", tabindex=_if(~has_attr(x, "tabindex"), "-1"), **{MARK: _mark(x, "EXE2")}), F.when(close["id"].isNotNull() & ~has_name(close), _sets(close, aria_label=LABELS["close"])).otherwise(F.array().cast(CHANGE)))

    n = F.size(found)
    # what lies behind a dialog: all at the top of the page but what holds every dialog, which are in document order
    first, last = F.get(found, F.lit(0)), F.get(found, n - 1)
    behind = F.filter(tops, lambda y: (n > 0) & ~((y["id"] <= first["id"]) & (y["end"] >= last["id"])) & (F.coalesce(attr(y, MARK), F.lit("")) != "COM1"))
    return Step(F.concat(_each(found, of), _each(behind, lambda y: _sets(y, aria_hidden="true", data_inert="1"))), _entries(_fix(n, FIXES["dialog-escape"])), n, [found, tops])


def breadcrumbs() -> Step:
    found = Kept(_nodes(lambda x: class_like(x, "breadcrumb") & (F.coalesce(attr(x, "role"), F.lit("")) != "navigation") & (x["tag"] != "nav") & (x["nav"] == 0)))

    def of(x: Column) -> Column:
        now = first_inside(x, selector("[class*='active'], [aria-current]"))
        return F.concat(_sets(x, role="navigation", aria_label=LABELS["breadcrumb"], **{MARK: _mark(x, "EXE3")}), F.when(now["id"].isNotNull(), _sets(now, aria_current="page")).otherwise(F.array().cast(CHANGE)))

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["back-affordance"])), n, [found])


def icon_buttons() -> Step:
    test = selector("button, a[role='button'], a[href], [role='button']")

    def hint(x: Column) -> Column:
        icon = first_inside(x, selector("i, svg, use, [class*='icon']"))
        use = first_inside(F.coalesce(icon, x), lambda y: y["tag"] == "use")
        words = [F.coalesce(attr(icon, "class"), classes(x)), classes(x), attr(x, "id"), F.coalesce(attr(icon, "id"), F.when(icon["id"].isNull(), attr(x, "id"))), attr(use, "href")]
        return F.concat_ws(" ", *words)

    found = Kept(F.transform(_nodes(lambda x: test(x) & ~has_name(x) & ~_marked(x, "FIL1")), lambda x: F.struct(x.alias("x"), icon_label(hint(x)).alias("name"))))
    of = lambda r: _sets(r["x"], aria_label=F.coalesce(r["name"], F.lit(LABELS["button"])), data_needs_name=_if(r["name"].isNull(), "1"), **{MARK: _mark(r["x"], "FIL1")})
    n, bare = F.size(found), F.size(F.filter(found, lambda r: r["name"].isNull()))
    return Step(_each(found, of), _entries(("flag", bare, None, FLAGS["icon"]), _fix(n, FIXES["icon-buttons"])), n, [found])


def search_regions() -> Step:
    test = selector("form[role='search'], [role='search'], form[class*='search']")
    every = Kept(F.transform(_nodes(test), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    found = F.filter(every, lambda r: (F.size(every) >= 2) & ~filled(attr(r["x"], "aria-label")))
    scope = lambda r: F.when(classes(r["x"]).rlike(WITHIN), LABELS["collection"]).when(classes(r["x"]).rlike(SITEWIDE) | (r["i"] == 0), LABELS["library"]).otherwise(LABELS["section"])
    n = F.size(found)
    return Step(_each(found, lambda r: _sets(r["x"], role="search", aria_label=scope(r), **{MARK: _mark(r["x"], "FIL2")})), _entries(_fix(n, FIXES["search-regions"])), n, [every])


def help_links() -> Step:
    found = Kept(_nodes(lambda x: (x["tag"] == "a") & has_attr(x, "href") & (text_of(x).rlike(HELP_SAID) | attr(x, "href").rlike(HELP_HREF))))
    of = lambda x: _sets(x, aria_label=F.when(~filled(attr(x, "aria-label")), F.coalesce(F.nullif(text_of(x), F.lit("")), F.lit(LABELS["help"]))), **{MARK: _mark(x, "FIL3")})
    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["help-affordance"])), n, [found])


def pagination() -> Step:
    found = Kept(_nodes(lambda x: (class_like(x, "pagination", "pager") | (x["tag"] == "nav") & class_like(x, "page")) & ~_marked(x, "NAV2")))

    def of(x: Column) -> Column:
        now = first_inside(x, selector("[class*='active'], [class*='current'], [aria-current]"))
        turn = lambda y: F.concat_ws(" ", classes(y), attr(y, "rel"))
        links = inside(x, lambda y: tag_in(y, "a", "button") & ~has_name(y))
        named = F.flatten(F.transform(links, lambda y: _sets(y, aria_label=F.when(turn(y).rlike("(?i)next"), LABELS["next"]).when(turn(y).rlike("(?i)prev"), LABELS["prev"]))))
        return F.concat(_sets(x, role=_if(x["tag"] != "nav", "navigation"), aria_label=_if(~filled(attr(x, "aria-label")), LABELS["pager"]), **{MARK: _mark(x, "NAV2")}), F.when(now["id"].isNotNull(), _sets(now, aria_current="page")).otherwise(F.array().cast(CHANGE)), named)

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["pagination"])), n, [found])


def results_status() -> Step:
    found = Kept(F.slice(_nodes(selector(RESULTS)), 1, 1))
    jumps = Kept(F.exists("nodes", selector("a.skip-results")))
    item = selector(RESULT_ITEM)
    status = lambda x: ~any_inside(x, lambda y: has_attr(y, "data-results-status"))
    skip = lambda x: ~jumps

    def of(x: Column) -> Column:
        items = inside(x, item)
        many = F.size(items)
        text = F.when(many > 0, F.concat(many.cast("string"), F.lit(" results found"))).otherwise("No results found")
        places = F.flatten(F.transform(items, lambda y, i: _sets(y, **{"#insert": F.concat(F.lit("span: Result "), (i + 1).cast("string"), F.lit(" of "), many.cast("string"))})))
        own = _sets(x, aria_label=_if(~filled(attr(x, "aria-label")), LABELS["results"]), id=F.when(~filled(attr(x, "id")), "results-region"))
        return F.concat(own, F.when(status(x), F.concat(_sets(x, **{"#insert": F.concat(F.lit("status: "), text)}), places)).otherwise(F.array().cast(CHANGE)), F.when(skip(x), _sets(x, **{"#insert": "a.skip-results"})).otherwise(F.array().cast(CHANGE)))

    n = F.coalesce(F.get(F.transform(found, lambda x: status(x).cast("int") + skip(x).cast("int")), F.lit(0)), F.lit(0))
    return Step(_each(found, of), _entries(("fix", (n > 0).cast("int"), n, FIXES["results-status"])), n, [found, jumps])


def item_navigation() -> Step:
    control = selector(PAGE_CONTROL)
    found = Kept(_nodes(lambda x: class_like(x, "viewer", "reader", "pageview") & any_inside(x, control)))

    def of(x: Column) -> Column:
        named = F.transform(inside(x, control), lambda c: _sets(c, aria_label=F.when(~has_name(c), F.when(classes(c).rlike("(?i)next"), LABELS["next"]).otherwise(LABELS["prev"]))))
        return F.concat(_sets(x, **{MARK: _mark(x, "NAV4")}), F.flatten(named))

    n = F.size(found)
    return Step(_each(found, of), _entries(_fix(n, FIXES["within-item-nav"])), n, [found])


def authorized_features() -> Step:
    found = Kept(_nodes(lambda x: class_like(x, "locked", "disabled", "premium", "auth-required") & ~_marked(x, "RED4")))
    n = F.size(found)
    return Step(_each(found, lambda x: _sets(x, aria_disabled="true", **{MARK: _mark(x, "RED4"), "#insert": f"span: {LABELS['locked']}"})), _entries(_fix(n, FIXES["authorized-features"])), n, [found])


def media_captions(transcribes: bool = False) -> Step:
    caption = lambda y: (y["tag"] == "track") & F.coalesce(attr(y, "kind").isin("captions", "subtitles"), F.lit(False))
    player = selector(PLAYER)
    media = Kept(_nodes(lambda x: tag_in(x, "video", "audio") & ~_marked(x, "MED1")))
    kind = lambda x: F.when(x["tag"] == "video", "Video").otherwise("Audio")
    bare = F.filter(media, lambda x: ~any_inside(x, caption))
    frames = Kept(_nodes(lambda x: player(x) & ~_marked(x, "MED1")))
    changes = F.concat(
        _each(media, lambda x: _sets(x, aria_label=F.when(~has_name(x), F.concat(kind(x), F.lit(" player"))), **{MARK: F.when(~any_inside(x, caption), _mark(x, "MED1"))})),
        _each(frames, lambda x: _sets(x, title=_if(~has_name(x), LABELS["video"]), **{MARK: _mark(x, "MED1")})),
    )
    one = F.lit(1).cast("bigint")
    entries = F.concat(
        F.transform(bare, lambda x: F.struct(F.lit("fix" if transcribes else "flag").alias("kind"), one.alias("count"), F.concat(kind(x), F.lit(FLAGS["captions"])).alias("msg"))).cast(ENTRY),
        _entries(("flag", F.size(frames), one, FLAGS["player"])),
    )
    return Step(changes, entries, F.size(bare) + F.size(frames), [media, frames])


def images_nontag(looked: int | None = None) -> Step:
    """``looked``: how many elements of a page, at most, are looked at for background images; all where it is None."""
    big = lambda x: (pixels(x, "width") >= 48) & (pixels(x, "height") >= 48)
    done = lambda x: _marked(x, "ACC2")
    drawn = lambda x: tag_in(x, "svg", "canvas") & ~done(x) & ~_marked(x, "ACC3") & ~is_decorative(x) & ~explicit_name(x) & ((x["tag"] == "svg") & any_inside(x, lambda y: y["tag"] == "text") | big(x))
    named = lambda x: has_name(x) | F.coalesce(node(x["title"])["chars"] > 0, F.lit(False))
    box = lambda x: (F.lit(True) if looked is None else x["id"] <= looked) & F.coalesce(attr(x, "style").rlike(r"(?i)background(-image)?\s*:[^;]*url\("), F.lit(False)) & ~tag_in(x, "img", "svg", "canvas", "script", "style", "body", "html") & ~done(x) & ~is_decorative(x) & ~named(x) & (x["chars"] <= 2) & big(x) & (pixels(x, "width") * pixels(x, "height") >= 8000)
    found = Kept(_nodes(lambda x: drawn(x) | box(x)))
    n = F.size(found)
    of = lambda x: _sets(x, data_needs_alt="1", role=F.when(~tag_in(x, "svg", "canvas"), F.coalesce(F.nullif(attr(x, "role"), F.lit("")), F.lit("img"))), **{MARK: _mark(x, "ACC2")})
    return Step(_each(found, of), _entries(("flag", (n > 0).cast("int"), n, F.concat(n.cast("string"), F.lit(FLAGS["non-img"])))), n, [found])


def form_fields() -> Step:
    skipped = lambda x: (x["tag"] == "input") & F.coalesce(F.lower(attr(x, "type")).isin("hidden", "submit", "button", "reset", "image"), F.lit(False))

    ids = Kept(F.array_distinct(F.transform(_nodes(lambda y: (y["tag"] == "label") & filled(attr(y, "for")) & (y["chars"] > 0)), lambda y: attr(y, "for"))))

    def labelled(x: Column) -> Column:
        bound = F.coalesce(F.array_contains(ids, attr(x, "id")), F.lit(False))
        return has_name(x) | bound | (x["label"] > 0) & any_above(x, lambda y: (y["tag"] == "label") & (y["chars"] > 0))

    # each look at a field reads what those before it found
    def need(x: Column) -> Column:
        return F.struct(x.alias("x"), (has_attr(x, "required") & (F.coalesce(attr(x, "aria-required"), F.lit("")) != "true")).alias("need"), labelled(x).alias("done"))

    def beside(r: Column) -> Column:
        x = r["x"]
        near = F.filter(F.array(node(x["prev"]), next_sibling(x)), lambda y: (y["tag"] == "label") & ~has_attr(y, "for") & (y["chars"] > 0))
        return F.struct(x.alias("x"), r["need"], r["done"], F.when(~r["done"] & filled(attr(x, "id")), F.get(near, F.lit(0))).alias("label"))

    def hinted(r: Column) -> Column:
        hint = F.when(~r["done"] & r["label"]["id"].isNull(), F.nullif(F.trim(attr(r["x"], "placeholder")), F.lit("")))
        return F.struct(r["x"], r["need"], r["done"], r["label"], hint.alias("hint"))

    def bare(r: Column) -> Column:
        return F.struct(r["x"], r["need"], r["label"], r["hint"], (~r["done"] & r["label"]["id"].isNull() & r["hint"].isNull()).alias("bare"))

    fields = _nodes(lambda x: tag_in(x, "input", "select", "textarea") & ~skipped(x) & ~_marked(x, "FORM1"))
    for look in (need, beside, hinted, bare):
        fields = F.transform(fields, look)
    found = Kept(fields)
    number = lambda f: F.aggregate(found, F.lit(0), lambda a, r: a + f(r).cast("int"))
    fixes, flags = Kept(number(lambda r: r["need"].cast("int") + r["label"]["id"].isNotNull().cast("int") + r["hint"].isNotNull().cast("int"))), Kept(number(lambda r: r["bare"]))

    def of(r: Column) -> Column:
        x = r["x"]
        touched = r["need"] | r["label"]["id"].isNotNull() | r["hint"].isNotNull() | r["bare"]
        own = _sets(x, aria_required=_if(r["need"], "true"), aria_label=r["hint"], data_needs_label=_if(r["bare"], "1"), **{MARK: F.when(touched, _mark(x, "FORM1"))})
        return F.concat(own, F.when(r["label"]["id"].isNotNull(), _sets(r["label"], **{"for": attr(x, "id")})).otherwise(F.array().cast(CHANGE)))

    entries = _entries(("fix", (fixes > 0).cast("int"), fixes, F.concat(fixes.cast("string"), F.lit(FIXES["form-fields"]))), ("flag", (flags > 0).cast("int"), flags, F.concat(flags.cast("string"), F.lit(FLAGS["no label"]))))
    return Step(_each(found, of), entries, fixes + flags, [ids, found, fixes, flags])


BY_ID: dict[str, Callable[[], Step]] = dict(zip([r[0] for r in RULES], [
    file_links, images_alt, graphs, collection_items, disclosure, autocomplete, landmarks, filter_groups, result_relevance, clear_search, dialogs,
    breadcrumbs, icon_buttons, search_regions, help_links, pagination, results_status, item_navigation, authorized_features, media_captions, images_nontag, form_fields,
]))


@dataclass
class Rule:
    rule_id: str
    code: str
    level: str
    step: Step
    pack: str = ""


def _aligned(pages: DataFrame, changes: str) -> DataFrame:
    """Adds ``__own``: for each element the changes of it, in order. Elements and changes are sorted together once, so the
    work follows their number."""
    pages = pages.withColumn("__at", SF.expr(f"array_sort(concat(transform(nodes, n -> named_struct('id', n.id, 'seq', -1)), transform({changes}, (c, i) -> named_struct('id', c.node_id, 'seq', i))))"))
    pages = pages.withColumn("__p", SF.expr("filter(transform(__at, (s, i) -> if(s.seq < 0, i, null)), i -> i is not null)"))
    own = f"filter(transform(slice(__at, __p[k] + 2, coalesce(get(__p, k + 1), size(__at)) - __p[k] - 1), s -> {changes}[s.seq]), c -> c.attr <> '#insert')"
    return pages.withColumn("__own", SF.expr(f"transform(nodes, (n, k) -> {own})")).drop("__at", "__p")


def _with_attrs(attrs: str) -> str:
    """Elements with other attributes, where ``__own`` has changes; ``attrs`` may use ``n``, its changes ``own`` and their ``names``."""
    fields = ", ".join(f"'{f}', n.`{f}`" if f != "attrs" else f"'attrs', {attrs}" for f in FIELDS)
    made = f"transform(array(__own[k]), own -> transform(array(array_distinct(own.attr)), names -> named_struct({fields}))[0])[0]"
    return f"transform(nodes, (n, k) -> if(size(__own[k]) > 0, {made}, n))"


_LAST = "element_at(filter(own, c -> c.attr = a), -1).new"
_MARKS = f"array_join(array_distinct(filter(concat(split(coalesce(n.attrs['{MARK}'], ''), ' '), transform(filter(own, c -> c.attr = '{MARK}'), c -> c.new)), m -> m <> '')), ' ')"
_OTHERS = "map_filter(n.attrs, (a, v) -> not array_contains(names, a))"
_SET = _with_attrs(f"map_concat({_OTHERS}, map_from_entries(transform(filter(names, a -> {_LAST} is not null), a -> struct(a, if(a = '{MARK}', {_MARKS}, {_LAST})))))")
_FIRST = "own[array_position(own.attr, a) - 1].old"
_UNSET = _with_attrs(f"map_concat({_OTHERS}, map_from_entries(transform(filter(names, a -> {_FIRST} is not null), a -> struct(a, {_FIRST}))))")


def _with_kept(pages: DataFrame, kept: Iterable[Kept]) -> DataFrame:
    """Kept expressions as columns; those that read others come after them."""
    left = {k.text: k.of for k in kept}
    while left:
        now = {k for k, of in left.items() if not any(o in of.text for o in left if o != k)}
        pages = pages.select("*", *[F.column(left[k]).alias(k.strip("`")) for k in left if k in now])
        left = {k: of for k, of in left.items() if k not in now}
    return pages


def apply_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add what the rules find to ``changes``, ``report`` and ``counts`` of each page, then set it on ``nodes``.

    The rules of one call see the same elements; where two set one attribute, the later wins, and marks add up.
    """
    keep = [c for c in pages.columns if c not in ("nodes", "changes", "report", "counts")]
    each = list(enumerate(rules))
    found = _with_kept(pages, [k for r in rules for k in r.step.kept])
    found = found.select(*keep, "nodes", "changes", "report", "counts", *[F.column(c).alias(f"__{k}{i}") for i, r in each for k, c in (("c", r.step.changes), ("e", r.step.entries), ("n", r.step.n.cast("bigint")))])
    q = lambda v: F.lit(v).text
    log = [f"transform(__c{i}, c -> named_struct('node_id', c.node_id, 'rule_id', {q(r.rule_id)}, 'code', {q(r.code)}, 'attr', c.attr, 'old', nodes[c.node_id - 1].attrs[c.attr], 'new', c.new, 'pack_id', {q(r.pack)}))" for i, r in each]
    said = [f"transform(__e{i}, e -> named_struct('rule_id', {q(r.rule_id)}, 'code', {q(r.code)}, 'level', {q(r.level)}, 'kind', e.kind, 'count', e.count, 'msg', e.msg, 'pack_id', {q(r.pack)}))" for i, r in each]
    counted = [f"named_struct('rule_id', {q(r.rule_id)}, 'n', __n{i})" for i, r in each]
    out = found.select(*keep, "nodes", "changes", SF.expr(f"concat({', '.join(log)})").alias("__new"), SF.expr(f"concat(report, {', '.join(said)})").alias("report"), SF.expr(f"concat(counts, array({', '.join(counted)}))").alias("counts"))
    out = _aligned(out, "__new")
    return out.select(*keep, SF.expr(_SET).alias("nodes"), SF.expr("concat(changes, __new)").alias("changes"), "report", "counts")


#: Rules of one stage don't read what another of it sets; a stage ends at the given place in the order of rules.
STAGES = (3, 8, 12, 13, 17, 22)


def prepared(parsed: DataFrame) -> DataFrame:
    """Pages with empty results, and the elements as they were in ``original``."""
    empty = lambda kind, c: SF.array().cast(kind).alias(c)
    return parsed.select("page_id", "url", "bits", SF.col("nodes").alias("original"), "nodes", empty(LOG, "changes"), empty(SAID, "report"), empty(COUNTED, "counts"))


def run_rules(parsed: DataFrame, only: list[str] | None = None, looked: int | None = None) -> DataFrame:
    """All rules, or those of the given ids or codes, in order: ``(page_id, url, bits, original, nodes, changes, report,
    counts)``. ``looked`` is for :func:`images_nontag`."""
    pages, start = prepared(parsed), 0
    for end in STAGES:
        chosen = [Rule(r, c, level, images_nontag(looked) if r == "images-nontag" else BY_ID[r]()) for r, c, level, _, _ in RULES[start:end] if only is None or r in only or c in only]
        pages, start = apply_rules(pages, chosen) if chosen else pages, end
    return pages


def _rows(audited: DataFrame, array: str, place: str) -> DataFrame:
    """Items of an array with their places. The outer form, since the plain one makes the optimizer ask for non-empty arrays
    first, which would write every earlier rule into that condition again and again."""
    return audited.select("page_id", SF.posexplode_outer(array).alias(place, "e")).where("e is not null")


def counts(audited: DataFrame) -> DataFrame:
    """``(page_id, rule_id, n)``: what each rule changed on a page."""
    return _rows(audited, "counts", "seq").select("page_id", "e.*")


def audit_report(audited: DataFrame) -> DataFrame:
    """One row per report entry: ``(page_id, seq, rule_id, code, level, kind, count, msg, pack_id)``."""
    return _rows(audited, "report", "seq").select("page_id", "seq", "e.*")


def changes(audited: DataFrame) -> DataFrame:
    """One row per proposed change: ``(page_id, stage, node_id, rule_id, code, attr, old, new, pack_id)``."""
    return _rows(audited, "changes", "stage").select("page_id", "stage", "e.*")


def undo_changes(audited: DataFrame) -> DataFrame:
    """Pages with every changed attribute back at its first old value; what had none loses the attribute."""
    return _aligned(audited, "changes").withColumn("nodes", SF.expr(_UNSET)).drop("__own")


def touched_elements(audited: DataFrame) -> DataFrame:
    """``(page_id, node_id, codes, needs_content)`` of the elements that some rule marked."""
    rows = _rows(audited, "nodes", "seq").select("page_id", "e.id", "e.attrs").where(SF.col("attrs")[MARK].isNotNull())
    codes = SF.array_sort(SF.split(SF.col("attrs")[MARK], " "))
    need = SF.map_contains_key("attrs", "data-needs-alt") | SF.map_contains_key("attrs", "data-needs-label") | SF.exists(codes, lambda c: c.isin("ACC2", "ACC3", "COM3"))
    return rows.select("page_id", SF.col("id").alias("node_id"), codes.alias("codes"), need.alias("needs_content"))
