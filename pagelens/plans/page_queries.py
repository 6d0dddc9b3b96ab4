"""Queries over pages: the given pages, and pages built from parts with one defect each, so that SQL knows the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, packs, rules, scoring
from ..sources import pages as source
from ..sources.shapes import page_parts, table

_HEAD = "<html><head><title>t</title></head><body>"

# For each rule the body of a page with its defect.
DEFECTS = {
    "file-links": "<a href='/f/Annual_Report.pdf' data-size='2048' target='_blank'>here</a>",
    "images-alt": "<img src='a.png'><img src='b.png' alt='IMG_01.jpg'><img src='c.png' alt='A red barn'>",
    "graphs-longdesc": "<div class='chart'>Sales</div>",
    "collection-items": "<div class='collection'><p class='card'>a</p><p class='card'>b</p></div>",
    "disclosure": "<div class='accordion'><b class='header'>More</b><div>Body</div></div>",
    "autocomplete": "<div><input type='search' aria-label='q'><ul></ul></div>",
    "landmarks": "<nav>a</nav>",
    "filter-groups": "<div class='facet'><input type='checkbox' aria-label='a'><input type='radio' aria-label='b'></div>",
    "result-relevance": "<div class='result-item'><h2>One</h2><p>text</p></div>",
    "clear-search": "<div><input name='search' aria-label='q'><span class='clear'>×</span></div>",
    "dialog-escape": "<div class='modal'>open</div><p>behind</p><div class='modal' style='display: none'>shut</div>",
    "back-affordance": "<div class='breadcrumb'><b class='active'>Now</b></div><nav><p class='breadcrumb'>in</p></nav>",
    "icon-buttons": "<button class='fa-search'></button><button class='z'></button>",
    "search-regions": "<form role='search'>a</form><form class='search'>b</form>",
    "help-affordance": "<a href='/faq'>Ask</a>",
    "pagination": "<div class='pager'><a class='next' href='?2'></a></div>",
    "results-status": "<div id='results'><p>none</p></div>",
    "within-item-nav": "<div class='viewer'><b class='page-next'>→</b></div>",
    "authorized-features": "<b class='locked'>x</b>",
    "media-captions": "<video src='v'></video><audio src='a'></audio><video><track kind='captions'></video>",
    "images-nontag": "<svg width='360' height='120'></svg><canvas width='16' height='16'></canvas><div style='width:600px;height:200px;background:url(a.png)'></div>",
    "form-fields": "<label>Name <input required></label><input placeholder='City'><input><input type='submit'>",
}


def _planted(spark: SparkSession, d: str, bodies: list[str], every: int = 1) -> DataFrame:
    """Page i of the parts holds the body of place ``p_partkey mod (number of bodies * every)``, or nothing."""
    pick = F.get(F.array(*[F.lit(b) for b in bodies]), (F.col("p_partkey") % (len(bodies) * every)).cast("int"))
    html = F.concat(F.lit(_HEAD), F.coalesce(pick, F.lit("<h1>x</h1>")), F.lit("</body></html>"))
    return page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://lib"), (F.col("p_partkey") % 40).cast("string")).alias("url"), html.alias("html"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _all_planted(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_rules(source.parse_pages(_planted(spark, d, list(DEFECTS.values()))))


def undo_identity(spark: SparkSession, d: str) -> DataFrame:
    """Elements that differ from the original after all changes are taken back: none."""
    back = rules.undo_changes(_all_planted(spark, d))
    rows = back.select("page_id", F.explode_outer(F.arrays_zip("original", "nodes")).alias("z"))
    sorted_ = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    return rows.where(sorted_(F.col("z.original.attrs")) != sorted_(F.col("z.nodes.attrs"))).select("page_id", F.col("z.nodes.id").cast("long").alias("node_id"))


def _given(spark: SparkSession, d: str) -> DataFrame:
    return source.parse_pages(table(spark, d, "pages"))


def page_report(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the given pages."""
    return rules.audit_report(rules.run_rules(_given(spark, d))).select("page_id", "code", "kind", F.coalesce("count", F.lit(-1)).cast("long").alias("count"), "msg")


def page_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """24 scored situations of each given page."""
    audited = rules.run_rules(_given(spark, d))
    card = detectors.page_scorecard(audited, rules.audit_report(audited), table(spark, d, "pages"))
    return card.select("page_id", "code", "violations", "good", F.col("auto_score").cast("double").alias("auto_score"))


# What pages show of good techniques: an element, and how often it stands on the page of a part.
_SHOWN = {
    "file": ("'<a href=\"/' || p_size || '.pdf\">' || p_name || ', PDF file</a><a href=\"/x.pdf\">' || p_name || '</a>'", "p_size % 3"), "image": ("'<img alt=\"A ' || p_name || '\"><img alt=\"x.png\">'", "p_partkey % 3"),
    "open": ("'<b aria-expanded=true></b>'", "p_size % 4"), "main": ("'<main></main>'", "p_size % 2"), "one": ("'<h1>' || p_name || '</h1>'", "p_partkey % 4"), "skip": ("'<a href=\"#c' || p_size || '\">Skip it</a>'", "p_size % 5"),
    "modal": ("'<div role=dialog aria-modal=true></div>'", "p_partkey % 2"), "shut": ("'<div role=dialog aria-modal=false></div>'", "p_size % 2"), "pager": ("'<div class=pagination role=navigation></div>'", "p_size % 3"),
    "now": ("'<i aria-current=page>' || p_size || '</i>'", "p_partkey % 3"), "live": ("'<p aria-live=polite></p>'", "p_size % 2"), "combo": ("'<input role=combobox>'", "p_partkey % 2"),
}


def good_techniques(spark: SparkSession, d: str) -> DataFrame:
    """Good techniques of pages that show each of them as often as the columns of a part say."""
    body = " || ".join(f"repeat({html}, cast({n} as int))" for html, n in _SHOWN.values())
    pages = page_parts(spark, d).select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), F.expr(f"'<html><body>' || {body} || '</body></html>'").alias("html"))
    return detectors.detect_good(rules.prepared(source.parse_pages(pages))).select("page_id", "token", "msg", "count")


_PACK_BODIES = [
    "<div id='documents'><div class='document'>a</div></div><div id='facets'>f</div><div class='pagination' role='navigation'>p</div>",
    "<ds-root><ds-pagination><ul class='pagination'><li class='active'><a href='?1'>1</a></li></ul></ds-pagination></ds-root>",
    "<div id='mirador'>m</div>", "<ul class='resource-list'><li>a</li></ul>", "<p>none</p>",
]
_PACK_ROWS = [
    (0, "blacklight", "COM2/NAV1", 1, "Facet panel is a labelled region"), (0, "blacklight", "ACC4", 1, "Results list exposed as a list"), (0, "blacklight", "ACC4", 1, "Each result exposed as a list item"),
    (1, "dspace", "NAV2", 1, "Pagination is a labelled nav landmark"), (1, "dspace", "NAV2", 1, "Current page marked"),
    (2, "iiif", "USE1", 1, "Image/manuscript viewer container is a labelled region"), (3, "omeka", "ACC4", 1, "Resource list exposed as a list"),
]


def pack_pages(spark: SparkSession, d: str) -> DataFrame:
    return source.parse_pages(_planted(spark, d, _PACK_BODIES))


def planted_packs(spark: SparkSession, d: str) -> DataFrame:
    out = rules.audit_report(packs.apply_packs(rules.prepared(pack_pages(spark, d)), packs.BUNDLED))
    return out.select("page_id", "pack_id", "code", "count", "msg")


def packs_status(spark: SparkSession, d: str) -> DataFrame:
    return packs.packs_status(packs.bundled_packs(spark), packs.pack_matches(pack_pages(spark, d), packs.BUNDLED)).select("id", "pages", "rules", "source")


QUERIES = {
    "undo_identity": undo_identity,
    "page_report": page_report,
    "page_scorecard": page_scorecard,
    "page_links": lambda s, d: detectors.links(_given(s, d)).select("page_id", "href", "text"),
    "good_techniques": good_techniques,
    "planted_packs": planted_packs,
    "packs_status": packs_status,
}

_N = {k: f"({n})" for k, (_, n) in _SHOWN.items()}
_PARTS = [(f"{_N['main']} > 0", "main"), (f"{_N['one']} = 1", "one"), (f"{_N['skip']} > 0", "skip")]
_SHAPE = f"concat_ws(', ', {', '.join(f'case when {test} then {_q(name)} end' for (test, _), name in zip(_PARTS, detectors.STRUCTURE))})"
_GOOD_COUNTS = {
    "ACC1": _N["file"], "ACC2": _N["image"], "COM3": _N["image"], "ACC5": _N["open"], "COM1": " + ".join(f"({test})::int" for test, _ in _PARTS), "INT1": f"{_N['modal']} + {_N['shut']}", "EXE2": _N["modal"],
    "NAV2": f"least({_N['pager']}, {_N['now']})", "RED1": _N["live"], "ACC6": _N["combo"],
}
_GOOD_MSG = {t: f"{n} || {_q(detectors.GOOD[t])}" if detectors.GOOD[t].startswith(" ") else f"{_q(detectors.GOOD[t])} || {_SHAPE}" if t == "COM1" else _q(detectors.GOOD[t]) for t, n in _GOOD_COUNTS.items()}
PACK_VALUES = ", ".join(f"({i}, {_q(p)}, {_q(c)}, {n}, {_q(m)})" for i, p, c, n, m in _PACK_ROWS)
_HEADINGS = _q(rules.FIXES["landmarks"])

ORACLE_SQL = {
    "undo_identity": "select p_partkey as page_id, 0::bigint as node_id from part where false",
    "page_report": f"select page_id, 'COM1' as code, 'fix' as kind, 2::bigint as count, {_HEADINGS} as msg from pages",
    "page_links": """with l as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>')) as a from pages)
      select page_id, regexp_extract(a, 'href="([^"]*)"', 1) as href, trim(regexp_extract(a, '>([^<]*)<', 1)) as text from l where regexp_extract(a, 'href="([^"]*)"', 1) <> ''""",
    "good_techniques": " union all ".join(f"select p_partkey as page_id, '{t}' as token, {_GOOD_MSG[t]} as msg, ({n})::bigint as count from part where {n} > 0" for t, n in _GOOD_COUNTS.items()),
    "planted_packs": f"select p_partkey as page_id, pack_id, code, n::bigint as count, msg from part join (values {PACK_VALUES}) g(i, pack_id, code, n, msg) on i = p_partkey % 5",
    "packs_status": "select id, coalesce(pages, 0) as pages, rules::bigint as rules, 'bundled' as source from (values ('blacklight', 6, 0), ('dspace', 4, 1), ('iiif', 1, 2), ('islandora', 4, 9), ('omeka', 3, 3)) p(id, rules, i) left join (select p_partkey % 5 as k, count(*) as pages from part group by 1) on k = i",
    "page_scorecard": "select page_id, code, case code when 'COM1' then 2 else 0 end::bigint as violations, case code when 'COM1' then 1 else 0 end::bigint as good, case code when 'COM1' then 3.0 end::double as auto_score from pages, sit",
}
from ..sources.shapes import SHAPES_SQL  # noqa: E402

ORACLE_SQL["page_scorecard"] = f"with {SHAPES_SQL} {ORACLE_SQL['page_scorecard']}"
