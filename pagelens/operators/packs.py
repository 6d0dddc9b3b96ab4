"""Site packs: rules for one platform, as data, on top of the general rules."""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Callable, Iterator

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..functions.elements import attr, chains_of, compound_parts, has_name, selector
from ..sources.pages import NODE
from .rules import CHANGE, COUNTED, FIELDS, LOG, MARK, SAID, Kept, Rule, Step, _entries, _mark, _marked, apply_rules, run_rules

SCHEMA = """id string, title string, enabled boolean, source string, ord int,
match struct<hosts:array<string>,generator:string,selectors:array<string>>,
rules array<struct<code:string,level:string,describe:string,select:string,when:struct<missingName:boolean,hasName:boolean,notRole:string>,set:map<string,string>,remove:array<string>>>"""
#: Attribute that names the pack that changed an element last.
PACK_MARK = "data-pack"
#: Characters of packs that one pass over the pages takes, as a literal of its plan; more packs take more passes.
PASS_CHARS = 2 << 20

# Packs as the interpreter reads them: chains of steps, each with a link to the step before and tests of an element.
_PART = "struct<kind:string,name:string,op:string,value:string,fold:boolean>"
_CHAINS = f"array<array<struct<link:string,tests:array<struct<no:boolean,all:array<{_PART}>>>>>>"
_PUT = "struct<key:string,value:string>"
_RULES = f"array<struct<rule_id:string,code:string,level:string,msg:string,pack_id:string,chains:{_CHAINS},missing:boolean,named:boolean,not_role:string,sets:array<{_PUT}>,puts:array<{_PUT}>,gone:array<string>,names:array<string>>>"
COMPILED = f"array<struct<id:string,hosts:array<string>,generator:string,chains:{_CHAINS},asks:boolean,needs:array<string>,open:boolean,rules:{_RULES}>>"
# Places of the packs of a pass, counted from 0, by what a page must have for them.
_PLACES = "array<struct<key:string,at:array<int>>>"
FINDERS = {"packs": COMPILED, "any": "array<int>", "hosts": _PLACES, "generators": _PLACES, "signs": f"array<{_PLACES}>"}


def _rule(code: str, level: str, describe: str, select: str, role: str | None = None, label: str | None = None, missing: bool = False, **more: str) -> dict:
    values = {**({"role": role} if role else {}), **({"aria-label": label} if label else {}), **{k.replace("_", "-"): v for k, v in more.items()}}
    when = {"missingName": True} if missing else {"notRole": role} if role and role != "listitem" else {}
    return {"code": code, "level": level, "describe": describe, "select": select, "when": when, "set": values}


# The packs that come with the library.
BUNDLED = [
    {"id": "blacklight", "title": "Blacklight / Samvera", "match": {"selectors": ["body.blacklight-catalog", "#facets", "#documents .document", ".blacklight-catalog"]}, "rules": [
        _rule("NAV2", "AA", "Pagination is a labelled nav landmark", "nav.pagination, .pagination", "navigation", "Search results pages"),
        _rule("NAV2", "AA", "Current results page marked", ".pagination .page-item.active a, .pagination li.active a, .page.current", aria_current="page"),
        _rule("COM2/NAV1", "AAA", "Facet panel is a labelled region", "#facets", "region", "Search filters"),
        _rule("ACC4", "AA", "Results list exposed as a list", "#documents", "list", "Search results"),
        _rule("ACC4", "AA", "Each result exposed as a list item", "#documents .document", "listitem"),
        _rule("FIL1", "A", "Search submit button named", "button.search-btn, .search-query-form button[type=submit]", label="Search", missing=True),
    ]},
    {"id": "dspace", "title": "DSpace 7 (Angular)", "match": {"selectors": ["ds-root", "ds-app", "ds-search-page", "ds-pagination"]}, "rules": [
        _rule("NAV2", "AA", "Pagination is a labelled nav landmark", "ds-pagination nav, ds-pagination .pagination", "navigation", "Pagination"),
        _rule("NAV2", "AA", "Current page marked", "ds-pagination .page-item.active a, ds-pagination li.active a", aria_current="page"),
        _rule("COM2/NAV1", "AAA", "Search filters region labelled", "ds-search-filters, ds-search-sidebar", "region", "Search filters"),
        _rule("FIL1", "A", "Search button named", "button.search-button, ds-search-form button[type=submit]", label="Search", missing=True),
    ]},
    {"id": "iiif", "title": "IIIF viewers (Mirador / UV)", "match": {"selectors": [".mirador-viewer", "#mirador", ".uv", "#uv", ".openseadragon-container"]}, "rules": [
        _rule("USE1", "AAA", "Image/manuscript viewer container is a labelled region", ".mirador-viewer, #mirador, .uv, #uv", "region", "Image viewer"),
    ]},
    {"id": "islandora", "title": "Islandora / Drupal", "match": {"generator": "Drupal", "selectors": ["nav.pager", ".pager__items", "body.path-node"]}, "rules": [
        _rule("NAV2", "AA", "Drupal pager is a labelled nav landmark", "nav.pager, .pager", "navigation", "Pagination"),
        _rule("NAV2", "AA", "Current pager item marked", ".pager__item.is-active a, .pager-current", aria_current="page"),
        _rule("EXE3", "AA", "Breadcrumb is a labelled nav landmark", "nav.breadcrumb, .breadcrumb", "navigation", "Breadcrumb"),
        _rule("COM2/NAV1", "AAA", "Facets block is a labelled region", ".facets-widget, .block-facets, #block-facets", "region", "Facets"),
    ]},
    {"id": "omeka", "title": "Omeka S", "match": {"generator": "Omeka", "selectors": ["body.omeka", ".resource-list", "#search"]}, "rules": [
        _rule("NAV2", "AA", "Pagination is a labelled nav landmark", ".pagination", "navigation", "Pagination"),
        _rule("ACC4", "AA", "Resource list exposed as a list", ".resource-list", "list", "Items"),
        _rule("FIL1", "A", "Search button named", "#search button[type=submit], .search-form button[type=submit]", label="Search", missing=True),
    ]},
]


def as_packs(spark: SparkSession, packs: list[dict]) -> DataFrame:
    """Packs given as dicts as rows, in their order."""
    rows = [({"enabled": True, "ord": i} | p,) for i, p in enumerate(packs)]
    return spark.createDataFrame([(json.dumps(r[0]),) for r in rows], "j string").select(F.from_json("j", SCHEMA).alias("p")).select("p.*")


def bundled_packs(spark: SparkSession) -> DataFrame:
    return as_packs(spark, [{"source": "bundled"} | p for p in BUNDLED])


def read_site_packs(spark: SparkSession, path: str) -> DataFrame:
    """Packs from JSON files, one document each, in order of the files' names; rows without id or rules are left out, and the
    last read of an id counts. Packs without ``enabled`` are on."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("at", F.input_file_name())
    rows = latest_packs(rows.where("id is not null and rules is not null"), "at")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "id")) - 1
    return rows.withColumn("ord", F.coalesce("ord", place)).withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("source", F.coalesce("source", F.lit("file"))).drop("at")


def latest_packs(packs: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc(order))
    return packs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def register_pack(packs: DataFrame, pack: dict) -> DataFrame:
    """The packs with one more; it takes the place of any of its id, else the last."""
    if not pack.get("id") or not pack.get("rules"):
        raise ValueError("a pack has an id and rules")
    row = as_packs(packs.sparkSession, [pack]).drop("ord")
    place = packs.agg(F.coalesce(F.max(F.when(F.col("id") == pack["id"], F.col("ord"))), F.max("ord") + 1, F.lit(0)).alias("ord"))
    return unregister_pack(packs, pack["id"]).unionByName(row.crossJoin(F.broadcast(place)))


def unregister_pack(packs: DataFrame, pack_id: str) -> DataFrame:
    return packs.where(F.col("id") != pack_id)


def enable_pack(packs: DataFrame, pack_id: str, on: bool = True) -> DataFrame:
    return packs.withColumn("enabled", F.when(F.col("id") == pack_id, on).otherwise(F.col("enabled")))


def meta_generator(nodes: str = "nodes") -> Column:
    """Content of the first ``meta`` that names the generator; empty without."""
    first = F.get(F.filter(nodes, lambda x: (x["tag"] == "meta") & F.coalesce(F.lower(attr(x, "name")) == "generator", F.lit(False))), F.lit(0))
    return F.coalesce(attr(first, "content"), F.lit(""))


def selector_steps(text: str) -> list[list[dict]]:
    """A selector list as data: for each of its chains the steps from left to right. Empty if it isn't supported, as such a
    selector selects nothing."""
    try:
        return [[{"link": link, "tests": compound_parts(part)} for link, part in chain] for chain in chains_of(text)]
    except ValueError:
        return []


def _needs(chains: list[list[dict]]) -> tuple[list[str], bool]:
    """An id, else a class, else a tag that each chain's last element has, as a page's tokens name it, since fewer pages have such an
    id or class than such a tag; and whether a chain asks for none of these."""
    sign = {"id": "#", "class": ".", "tag": ""}
    found = [next((sign[kind] + p["value"] for kind in sign for t in c[-1]["tests"] if not t["no"] for p in t["all"] if p["kind"] == kind), None) for c in chains]
    return [f for f in found if f], None in found


def compile_pack(pack: dict, known_pattern: Callable[[str], bool], only: list[str] | None = None) -> dict:
    """A pack as the interpreter reads it. A generator that is no pattern is left out, as if it weren't given."""
    match, rules = pack.get("match") or {}, []
    chains = [c for s in match.get("selectors") or [] for c in selector_steps(s)]
    needs, open_ = _needs(chains)
    for r in pack["rules"]:
        code, own = r.get("code") or "PACK", f"{pack['id']}:{r.get('code') or 'rule'}"
        if only is not None and code not in only and own not in only:
            continue
        when, gone = r.get("when") or {}, r.get("remove") or []
        sets = [{"key": k, "value": v} for k, v in (r.get("set") or {}).items() if k not in (MARK, PACK_MARK)]
        rules.append({
            "rule_id": own, "code": code, "level": r.get("level") or "", "msg": r.get("describe") or f"[{pack['id']}] {r.get('code') or 'fix'}", "pack_id": pack["id"],
            "chains": selector_steps(r.get("select") or ""), "missing": bool(when.get("missingName")), "named": bool(when.get("hasName")), "not_role": when.get("notRole") or None,
            "sets": sets, "puts": [s for s in sets if s["key"] not in gone], "gone": gone, "names": [*{MARK: 0, PACK_MARK: 0, **{s["key"]: 0 for s in sets}, **dict.fromkeys(gone, 0)}],
        })
    generator = match.get("generator") or None
    generator = generator if generator and known_pattern(f"(?i){generator}") else None
    return {"id": pack["id"], "hosts": match.get("hosts") or [], "generator": generator, "chains": chains, "asks": bool(generator or match.get("selectors")), "needs": needs, "open": open_, "rules": rules}


def _known_pattern(spark: SparkSession) -> Callable[[str], bool]:
    def known(pattern: str) -> bool:
        try:
            return spark._jvm.java.util.regex.Pattern.compile(pattern) is not None
        except IllegalArgumentException:
            return False

    return known


def _finders(held: list[dict]) -> dict[str, list]:
    """Compiled packs and where to look for those that may be for a page. A pack that has to be asked for stands under its generator
    and under each sign (tag, class or id) that its selectors need; one that any page could match stands under its hosts or, without,
    under ``any``. Signs are dealt by ``crc32`` over as many lists as there are signs."""
    any_, hosts, generators, signs = [], {}, {}, {}
    for i, p in enumerate(held):
        if p["asks"] and not p["open"]:
            keys = [(generators, f"(?i){p['generator']}")] if p["generator"] is not None else []
            keys += [(signs, k) for k in p["needs"]]
        else:
            keys = [(hosts, h) for h in p["hosts"]]
            any_ += [] if keys else [i]
        for known, key in keys:
            known.setdefault(key, {})[i] = None
    places = lambda known: [{"key": k, "at": [*at]} for k, at in known.items()]
    dealt = [[] for _ in range(max(1, len(signs)))]
    for one in places(signs):
        dealt[zlib.crc32(one["key"].encode("utf-8", "surrogatepass")) % len(dealt)].append(one)
    return {"packs": held, "any": any_, "hosts": places(hosts), "generators": places(generators), "signs": dealt}


def _passes(packs: DataFrame, only: list[str] | None) -> Iterator[dict[str, Column]]:
    """The enabled packs in their order, compiled, as literals of one pass, see ``FINDERS``. Packs are configuration: they come to
    the driver one partition at a time, and a pass takes ``PASS_CHARS`` of them, or one that is longer."""
    known, held, size = _known_pattern(packs.sparkSession), [], 0
    literals = lambda: {k: F.from_json(F.lit(json.dumps(v)), FINDERS[k]) for k, v in _finders(held).items()}
    for r in packs.where("coalesce(enabled, true)").orderBy("ord", "id").toLocalIterator():
        pack = compile_pack(r.asDict(recursive=True), known, only)
        more = len(json.dumps(pack))
        if held and size + more > PASS_CHARS:
            yield literals()
            held, size = [], 0
        held.append(pack)
        size += more
    if held:
        yield literals()


# The interpreter: a part of a selector ``p``, and a step after the elements ``kept`` that the steps before it select.
_VALUE = "if(p.fold, lower(x.attrs[p.name]), x.attrs[p.name])"
_IS = f"""CASE p.kind WHEN 'tag' THEN x.tag = p.value WHEN 'id' THEN coalesce(x.attrs['id'] = p.value, false) WHEN 'any' THEN true
 WHEN 'class' THEN array_contains(split(coalesce(x.attrs['class'], ''), '\\\\s+'), p.value)
 ELSE x.attrs[p.name] IS NOT NULL AND CASE p.op WHEN 'has' THEN true WHEN '=' THEN {_VALUE} = p.value WHEN '*' THEN contains({_VALUE}, p.value) WHEN '^' THEN startswith({_VALUE}, p.value)
 WHEN '$' THEN endswith({_VALUE}, p.value) ELSE array_contains(split({_VALUE}, '\\\\s+'), p.value) END END"""
_LINK = """CASE step.link WHEN '' THEN true WHEN ' ' THEN exists(x.up, u -> kept[u - 1]) WHEN '>' THEN coalesce(get(kept, x.parent - 1), false) WHEN '+' THEN coalesce(get(kept, x.prev - 1), false)
 ELSE exists(slice({n}, x.parent + 1, x.id - x.parent - 1), y -> y.parent = x.parent AND kept[y.id - 1]) END"""


def _selected(nodes: str, chains: str) -> str:
    """SQL: for each chain an array that says of each element whether it is selected. A chain's steps are taken from the left, each
    keeping the elements that pass its tests and have one that the step before kept above, before or around them."""
    step = f"transform({nodes}, x -> forall(step.tests, t -> forall(t.all, p -> {_IS}) <> t.no) AND {_LINK.format(n=nodes)})"
    return f"transform({chains}, chain -> aggregate(chain, cast(NULL AS array<boolean>), (kept, step) -> {step}))"


def _with_live(pages: DataFrame, found: dict[str, Column]) -> DataFrame:
    """Adds ``__live``: the places, in the literal of a pass, of the packs that are for the page, in order.

    Hosts must hold; then any of generator and selectors, if either is given. Only packs that stand under a host, the generator, a
    tag, a class or an id of the page are tried, so that few are. They are named by their places, as ``transform`` copies what it makes.
    """
    tokens = "array_distinct(flatten(transform(nodes, x -> concat(array(x.tag, '#' || coalesce(x.attrs['id'], '')), transform(split(coalesce(x.attrs['class'], ''), '\\\\s+'), c -> '.' || c)))))"
    pages = pages.withColumn("__generator", meta_generator()).withColumn("__tokens", F.expr(tokens)).withColumns({f"__in_{k}": c for k, c in found.items()})
    signs = "flatten(transform(own.tokens, t -> flatten(filter(__in_signs[int(crc32(cast(t AS binary)) % size(__in_signs))], k -> k.key = t).at)))"
    places = f"array_sort(array_distinct(concat(__in_any, flatten(filter(__in_hosts, h -> contains(own.url, h.key)).at), flatten(filter(__in_generators, g -> rlike(own.generator, g.key)).at), {signs})))"
    p = "__in_packs[i]"
    hosts = f"(size({p}.hosts) = 0 OR exists({p}.hosts, h -> contains(own.url, h)))"
    picked = f"(({p}.open OR arrays_overlap({p}.needs, own.tokens)) AND exists({_selected('nodes', f'{p}.chains')}, kept -> exists(kept, k -> k)))"
    asked = f"(NOT {p}.asks OR ({p}.generator IS NOT NULL AND rlike(own.generator, '(?i)' || {p}.generator)) OR {picked})"
    # bound by a lambda: a column used in the filter of the packs would be written into it, and so worked out for each pack
    live = f"transform(array(named_struct('url', coalesce(url, ''), 'generator', __generator, 'tokens', __tokens)), own -> filter({places}, i -> {hosts} AND {asked}))[0]"
    return pages.withColumn("__live", F.expr(live)).drop("__generator", "__tokens", *[f"__in_{k}" for k in found])


def _has_name(nodes: str) -> str:
    return has_name(S.Sql("x"), S.Sql(nodes)).text


def _interpret(pages: DataFrame, found: dict[str, Column]) -> DataFrame:
    """Run the rules of the packs of ``__live`` one after the other, each on what the one before left."""
    state = "struct<nodes:array<{n}>,changes:{c},report:{e},counts:{k}>".format(n=NODE, c=LOG, e=SAID, k=COUNTED)
    marks = f"array_join(array_distinct(filter(concat(split(coalesce(x.attrs['{MARK}'], ''), ' '), array(r.code)), m -> m <> '')), ' ')"
    new = f"map_concat(map_filter(x.attrs, (a, v) -> NOT array_contains(r.names, a)), map_from_entries(concat(r.puts, array(named_struct('key', '{PACK_MARK}', 'value', r.pack_id), named_struct('key', '{MARK}', 'value', {marks})))))"
    done = f"(contains(coalesce(x.attrs['{MARK}'], ''), r.code) AND coalesce(x.attrs['{PACK_MARK}'] = r.pack_id, false))"
    name = f"(NOT (r.missing OR r.named) OR ({_has_name('s.nodes')} = r.named AND NOT (r.missing AND r.named)))"
    chosen = f"transform(array({_selected('s.nodes', 'r.chains')}), sets -> transform(s.nodes, x -> exists(sets, kept -> kept[x.id - 1]) AND NOT {done} AND (r.not_role IS NULL OR coalesce(x.attrs['role'], '') <> r.not_role) AND {name}))[0]"
    log = lambda attr, new: f"named_struct('node_id', x.id, 'rule_id', r.rule_id, 'code', r.code, 'attr', {attr}, 'old', x.attrs[{attr}], 'new', {new}, 'pack_id', r.pack_id)"
    mark = f"if(array_contains(split(coalesce(x.attrs['{MARK}'], ''), ' '), r.code), array(), array({log(repr(MARK), 'r.code')}))"
    each = f"concat(transform(r.sets, e -> {log('e.key', 'e.value')}), array({log(repr(PACK_MARK), 'r.pack_id')}), {mark}, transform(filter(r.gone, a -> map_contains_key(x.attrs, a)), a -> {log('a', 'cast(NULL AS string)')}))"
    fields = ", ".join(f"'{f}', x.`{f}`" if f != "attrs" else f"'attrs', {new}" for f in FIELDS)
    nodes = f"transform(s.nodes, x -> if(sel[x.id - 1], named_struct({fields}), x))"
    said = "if(n > 0, array(named_struct('rule_id', r.rule_id, 'code', r.code, 'level', r.level, 'kind', 'fix', 'count', cast(n AS bigint), 'msg', r.msg, 'pack_id', r.pack_id)), array())"
    step = f"""transform(array({chosen}), sel -> transform(array(size(filter(sel, b -> b))), n -> if(n = 0, named_struct('nodes', s.nodes, 'changes', s.changes, 'report', s.report, 'counts', s.counts), named_struct('nodes', {nodes},
      'changes', concat(s.changes, flatten(transform(filter(s.nodes, x -> sel[x.id - 1]), x -> {each}))), 'report', concat(s.report, {said}), 'counts', concat(s.counts, array(named_struct('rule_id', r.rule_id, 'n', cast(n AS bigint)))))))[0])[0]"""
    start = "named_struct('nodes', nodes, 'changes', changes, 'report', report, 'counts', counts)"
    run = f"if(size(__live) = 0, {start}, aggregate(flatten(transform(__live, i -> __packs[i].rules)), cast({start} AS {state}), (s, r) -> cast({step} AS {state})))"
    keep = [c for c in pages.columns if c not in ("nodes", "changes", "report", "counts", "__live")]
    return pages.withColumn("__packs", found["packs"]).select(*keep, F.expr(run).alias("__s")).select(*keep, "__s.*")


def _step(pack: dict, rule: dict) -> Step:
    """A rule of a pack as columns; one with ``fix`` sets what that function of an element, as SQL text, returns."""
    test, when, code = selector(rule["select"]), rule.get("when") or {}, rule.get("code") or "PACK"

    def chosen(x: S.Sql) -> S.Sql:
        out = S.col(f"__{pack['id']}") & test(x)
        if when.get("missingName"):
            out = out & ~has_name(x)
        if when.get("hasName"):
            out = out & has_name(x)
        if when.get("notRole"):
            out = out & (S.coalesce(attr(x, "role"), S.lit("")) != when["notRole"])
        return out & ~(_marked(x, code) & S.coalesce(attr(x, PACK_MARK) == pack["id"], S.lit(False)))

    found = Kept(S.filter("nodes", chosen))

    def of(x: S.Sql) -> S.Sql:
        values = rule["fix"](x) if callable(rule.get("fix")) else rule.get("set") or {}
        item = lambda a, v: S.struct(x["id"].alias("node_id"), S.lit(a).alias("attr"), (v if isinstance(v, S.Sql) else S.lit(v)).cast("string").alias("new"))
        sets = S.array(*[item(a, v) for a, v in values.items()], item(PACK_MARK, pack["id"])).cast(CHANGE)
        mark = S.filter(S.array(item(MARK, _mark(x, code))).cast(CHANGE), lambda c: c["new"].isNotNull())
        gone = S.array(*[item(a, None) for a in rule.get("remove") or []]).cast(CHANGE)
        return S.concat(sets, mark, S.filter(gone, lambda c: S.map_contains_key(x["attrs"], c["attr"])))

    n = S.size(found)
    return Step(S.flatten(S.transform(found, of)).cast(CHANGE), _entries(("fix", (n > 0).cast("int"), n, rule.get("describe") or f"[{pack['id']}] {rule.get('code') or 'fix'}")), n, [found])


def apply_packs(audited: DataFrame, packs: DataFrame | list[dict], only: list[str] | None = None) -> DataFrame:
    """Enabled packs on the pages that they match, each rule after the one before; ``only`` names codes or rules.

    Packs are rows, see ``SCHEMA``. They are read into steps as data, which one interpreter runs over a page's elements, so the
    plan is the same for any number of packs. Packs given as dicts may have rules with ``fix``, a function of an element as
    SQL text; such packs become columns, the others rows.
    """
    if isinstance(packs, DataFrame):
        for found in _passes(packs, only):
            audited = _interpret(_with_live(audited, found), found)
        return audited
    live = [p for p in packs if p.get("enabled", True)]
    for made, run in itertools.groupby(live, lambda p: any(callable(r.get("fix")) for r in p["rules"])):
        audited = _apply_made(audited, list(run), only) if made else apply_packs(audited, as_packs(audited.sparkSession, list(run)), only)
    return audited


def _apply_made(audited: DataFrame, packs: list[dict], only: list[str] | None) -> DataFrame:
    for p in packs:
        head = as_packs(audited.sparkSession, [{"id": p["id"], "match": p.get("match"), "rules": []}])
        out = _with_live(audited, next(_passes(head, None))).withColumn(f"__{p['id']}", F.size("__live") > 0).drop("__live")
        for r in p["rules"]:
            code, own = r.get("code") or "PACK", f"{p['id']}:{r.get('code') or 'rule'}"
            if only is None or code in only or own in only:
                out = apply_rules(out, [Rule(own, code, r.get("level") or "", _step(p, r), p["id"])])
        audited = out.drop(f"__{p['id']}")
    return audited


def run_audit(parsed: DataFrame, packs: DataFrame | list[dict], only: list[str] | None = None) -> DataFrame:
    """A whole audit: the general rules, then the packs that match the page, into one report; ``only`` names codes or rules of either."""
    return apply_packs(run_rules(parsed, only), packs, only)


def pack_matches(pages: DataFrame, packs: DataFrame | list[dict]) -> DataFrame:
    """``(page_id, pack_id)`` of the enabled packs that match a page."""
    packs, out = packs if isinstance(packs, DataFrame) else as_packs(pages.sparkSession, packs), None
    for found in _passes(packs, None):
        rows = _with_live(pages.select("page_id", "url", "nodes"), found).withColumn("__packs", found["packs"])
        rows = rows.select("page_id", F.explode_outer(F.expr("transform(__live, i -> __packs[i].id)")).alias("pack_id")).where("pack_id is not null")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else pages.select("page_id", F.lit("").alias("pack_id")).limit(0)


def packs_status(packs: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, title, enabled, pages, rules, source)``: how many pages each pack matches."""
    n = found.groupBy(F.col("pack_id").alias("id")).agg(F.count("*").alias("pages"))
    return packs.join(n, "id", "left").select("id", F.coalesce("title", "id").alias("title"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.coalesce(F.size("rules"), F.lit(0)).cast("long").alias("rules"), F.coalesce("source", F.lit("bundled")).alias("source"))
