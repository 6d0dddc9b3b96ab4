"""From page source to elements.

A page becomes one row with an array of its elements in document order and one of its pieces of text; an element says which
pieces it holds. Rules read these arrays with higher-order functions, so auditing moves no rows between tasks;
:func:`page_nodes` gives the same as a relation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sized
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import text_of

#: An element: its number in document order, its parent, previous sibling and last descendant (0 for none), the numbers of
#: all above it, outermost first, its pieces of text, whether some of that is a word and not hidden, and how many characters it is;
#: then what is near it: the ``a``, ``label`` and ``nav`` that it lies in, and the first title, image, and control that it
#: holds (0 for none), and whether it holds an element of ``BLOCKS``.
NODE = "struct<id:int,parent:int,prev:int,end:int,depth:int,ix:int,tag:string,attrs:map<string,string>,up:array<int>,t0:int,tn:int,seen:boolean,chars:int,a:int,label:int,nav:int,title:int,pic:int,ctl:int,blocky:boolean>"
#: Elements that lie deeper are put beside each other, as browsers do; the markup may forget to close them.
DEEPEST = 512

# Fixed values of HTML: elements without content, and the open elements that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
CLOSES = {t: frozenset(["p"]) for t in _BLOCK.split()} | {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
#: Elements that an implied end doesn't reach through.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
# Elements that make a container more than a paragraph, and controls.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol table figure img li section article div".split())
CONTROLS = frozenset("input select textarea a button".split())
_WORD = re.compile(r"[^\W_]")


# Places in the row of an element while its page is read: the fields of an element, then what only the reader needs.
PARENT, PREV, END, DEPTH, IX, TAG, ATTRS, UP, T0, TN, SEEN, CHARS, A, LABEL, NAV, TITLE, PIC, CTL, BLOCKY, KIDS, LAST, HIDDEN = range(1, 23)
_NEAR = {"a": A, "label": LABEL, "nav": NAV}
_HELD = {"title": TITLE, "img": PIC} | dict.fromkeys(CONTROLS, CTL)


def _attributes(given: list[tuple[str, str | None]]) -> tuple[tuple[tuple[str, str], ...], bool]:
    """Attributes as they are kept, the first of a name; and whether they hide the element from assistive technology."""
    attrs = {k: v if v is not None else "" for k, v in reversed(given)}
    return tuple(attrs.items()), attrs.get("aria-hidden") == "true"


class _Tree:
    """Elements of one page with parents, ends, attributes and text, numbered from 1."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []
        self.bits: list[str] = []
        self.upto = [0]

    def _hold(self, place: int, value: int | bool) -> None:
        """Tell the open elements what they hold; those around one that knows of such an element know of one too."""
        for k in reversed(self.open):
            if self.rows[k - 1][place]:
                break
            self.rows[k - 1][place] = value

    def start(self, tag: str, attrs: tuple[tuple[str, str], ...], hidden: bool) -> None:
        rows, open_ = self.rows, self.open
        ends = CLOSES.get(tag)
        if ends:
            walls = WALLS.get(tag, {"button", "table"})
            for i in range(len(open_) - 1, -1, -1):
                t = rows[open_[i] - 1][TAG]
                if t in ends:
                    self._close(i)
                elif t in walls:
                    break
        at, parent, prev, ix, a, label, nav = len(rows) + 1, 0, 0, 0, 0, 0, 0
        if open_:
            parent = open_[-1]
            above = rows[parent - 1]
            prev, ix, a, label, nav = above[LAST], above[KIDS], above[A], above[LABEL], above[NAV]
            above[KIDS], above[LAST] = ix + 1, at
            near = _NEAR.get(above[TAG])
            if near:
                a, label, nav = parent if near == A else a, parent if near == LABEL else label, parent if near == NAV else nav
        rows.append([at, parent, prev, 0, len(open_), ix, tag, attrs, open_.copy(), len(self.bits) + 1, 0, False, 0, a, label, nav, 0, 0, 0, False, 0, 0, hidden])
        if tag in _HELD:
            self._hold(_HELD[tag], at)
        if tag in BLOCKS:
            self._hold(BLOCKY, True)
        if tag not in VOID and len(open_) < DEEPEST:
            open_.append(at)
        else:
            rows[-1][END] = at

    def start_end(self, tag: str, attrs: tuple[tuple[str, str], ...], hidden: bool) -> None:
        self.start(tag, attrs, hidden)
        if self.open[-1:] == [len(self.rows)] and tag in ("svg", "path", "use", "circle", "rect", "line", "g"):
            self._close(len(self.open) - 1)

    def end(self, tag: str) -> None:
        rows, open_ = self.rows, self.open
        for i in range(len(open_) - 1, -1, -1):
            if rows[open_[i] - 1][TAG] == tag:
                self._close(i)
                return

    def data(self, data: str) -> None:
        bits, bit = self.bits, " ".join(data.split())
        after = bool(bits) and bits[-1].endswith(" ")
        if data[:1].isspace() and bit and not after:
            bit = f" {bit}"
        if data[-1:].isspace() and (bit or not after):
            bit = f"{bit} "
        if bit:
            bits.append(bit)
            self.upto.append(self.upto[-1] + len(bit))
        if _WORD.search(data):
            for k in reversed(self.open):
                row = self.rows[k - 1]
                if row[SEEN]:
                    break
                row[SEEN] = True
                if row[HIDDEN]:
                    break

    def _close(self, i: int) -> None:
        bits, upto = self.bits, self.upto
        for k in self.open[i:]:
            row = self.rows[k - 1]
            t0 = row[T0] - 1
            row[END], row[TN] = len(self.rows), len(bits) - t0
            n = upto[-1] - upto[t0]
            if n:  # white space is single, and ends are trimmed
                n -= bits[t0].startswith(" ")
                n -= n > 0 and bits[-1].endswith(" ")
            row[CHARS] = n
        del self.open[i:]

    def finish(self) -> tuple[list[list], list[str]]:
        self._close(0)
        return self.rows, self.bits


class _Markup(HTMLParser):
    """Any markup, told to a tree."""

    def __init__(self, tree: _Tree) -> None:
        super().__init__(convert_charrefs=True)
        self.tree, self.handle_endtag, self.handle_data = tree, tree.end, tree.data

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tree.start(tag, *_attributes(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tree.start_end(tag, *_attributes(attrs))


# Plain markup: a start tag whose attributes stand apart and hold no entities, an end tag, a document type, or text.
_VALUE = r"""(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'=<>`&/]+)"""
_PLAIN = re.compile(rf"""<(?:([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z_][-\w:.]*(?:={_VALUE})?)*)[ \t\n\r\f]*>|/([a-zA-Z][a-zA-Z0-9-]*)>|![dD][oO][cC][tT][yY][pP][eE][^<>]*>)|([^<]+)""", re.ASCII)
_PLAIN_ATTR = re.compile(rf"([a-zA-Z_][-\w:.]*)(?:=({_VALUE}))?", re.ASCII)
# Fixed values of HTML: elements whose content is no markup.
RAW = frozenset("script style textarea iframe noembed noframes noscript xmp plaintext".split())
#: Sources of up to so many characters are remembered, so many of them, as pages often repeat; and a batch of elements ends there.
SHORT, REMEMBERED, BATCH_NODES, BATCH_PAGES = 4096, 256, 8192, 1024


@lru_cache(4096)
def _plain_attributes(text: str) -> tuple[tuple[tuple[str, str], ...], bool]:
    return _attributes([(k.lower(), v[1:-1] if v[:1] in ("'", '"') else v) for k, v in _PLAIN_ATTR.findall(text)])


def _read_plain(html: str) -> _Tree | None:
    """The tree of a page of plain markup, told as ``HTMLParser`` would, which takes several times as long; null for a page that
    holds anything else."""
    tree, at, in_title = _Tree(), 0, False
    start, end, data = tree.start, tree.end, tree.data
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at, kind = m.end(), m.lastindex
        if kind == 4:
            text = m[4]
            data(unescape(text) if "&" in text else text)
        elif kind == 3:
            tag = m[3].lower()
            if in_title and tag != "title":
                return None
            in_title = False
            end(tag)
        elif in_title:
            return None
        elif kind:
            tag, attrs = m[1].lower(), m[2]
            if tag in RAW:
                return None
            start(tag, *(((), False) if not attrs else _plain_attributes(attrs) if len(attrs) < 256 else _plain_attributes.__wrapped__(attrs)))
            in_title = tag == "title"
    return tree if at == len(html) and not in_title else None


def _read(html: str) -> tuple[list[list], list[str]]:
    """Elements of one page as rows of their fields, see ``PARENT``, and its pieces of text."""
    tree = _read_plain(html)
    if tree is None:
        tree = _Tree()
        markup = _Markup(tree)
        markup.feed(html)
        markup.close()
    return tree.finish()


@lru_cache(REMEMBERED)
def _read_short(html: str) -> tuple[list[list], list[str]]:
    return _read(html)


def parse_page(html: str) -> tuple[list[dict], list[str]]:
    """Elements of one page and its pieces of text."""
    rows, bits = _read(html)
    names = [f.name for f in FIELDS]
    return [dict(zip(names, r)) for r in rows], bits


def parse_html(html: str) -> list[dict]:
    """Elements with their ``text``, and ``vis``, that text where a word of it is not hidden."""
    nodes, bits = parse_page(html)
    for n in nodes:
        n["text"] = "".join(bits[n["t0"] - 1 : n["t0"] - 1 + n["tn"]]).strip()
        n["vis"] = n["text"] if n["seen"] else ""
    return nodes


#: The fields of an element as Arrow types, in the order of ``NODE``.
FIELDS = [
    *[pa.field(n, pa.int32()) for n in ("id", "parent", "prev", "end", "depth", "ix")], pa.field("tag", pa.string()), pa.field("attrs", pa.map_(pa.string(), pa.string())), pa.field("up", pa.list_(pa.int32())),
    *[pa.field(n, pa.int32()) for n in ("t0", "tn")], pa.field("seen", pa.bool_()), *[pa.field(n, pa.int32()) for n in ("chars", "a", "label", "nav", "title", "pic", "ctl")], pa.field("blocky", pa.bool_()),
]


def _offsets(items: Iterable[Sized]) -> pa.Array:
    return pa.array(accumulate(map(len, items), initial=0), pa.int32())


def _arrays(read: list[tuple[list[list], list[str]]]) -> tuple[pa.Array, pa.Array]:
    """Elements and pieces of text of some pages as Arrow lists, made field by field."""
    pages, bits = zip(*read)
    columns = list(zip(*chain.from_iterable(pages))) or [()] * len(FIELDS)

    def made(field: pa.Field, column: tuple) -> pa.Array:
        if pa.types.is_map(field.type):
            pairs = list(chain.from_iterable(column))
            return pa.MapArray.from_arrays(_offsets(column), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()))
        if pa.types.is_list(field.type):
            return pa.ListArray.from_arrays(_offsets(column), pa.array(list(chain.from_iterable(column)), pa.int32()))
        return pa.array(column, field.type)

    nodes = pa.StructArray.from_arrays([made(f, c) for f, c in zip(FIELDS, columns)], fields=FIELDS)
    return pa.ListArray.from_arrays(_offsets(pages), nodes), pa.ListArray.from_arrays(_offsets(bits), pa.array(list(chain.from_iterable(bits)), pa.string()))


def _repeated(read: list[tuple[list[list], list[str]]], places: list[int]) -> list[pa.Array]:
    """The arrays of some pages, each as often as its place is named."""
    made = _arrays(read)
    return list(made) if len(read) == len(places) else [a.take(pa.array(places, pa.int32())) for a in made]


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, nodes, bits)``, one row per page; a null or empty source has no elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read, at, places, first, n = [], {}, [], 0, 0
            for k, html in enumerate(b.column(2), 1):
                html = html.as_py() or ""
                page = _read_short(html) if len(html) <= SHORT else _read(html)
                # what was remembered is the same object
                if at.setdefault(id(page), len(read)) == len(read):
                    read.append(page)
                places.append(at[id(page)])
                n += len(page[0])
                if n >= BATCH_NODES or len(places) >= BATCH_PAGES or k == b.num_rows:
                    ids, urls = b.column(0).slice(first, k - first), b.column(1).slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([ids, urls, *_repeated(read, places)], names=["page_id", "url", "nodes", "bits"])
                    read, at, places, first, n = [], {}, [], k, 0

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, f"page_id long, url string, nodes array<{NODE}>, bits array<string>")


def page_nodes(parsed: DataFrame) -> DataFrame:
    """One row per element: ``(page_id, node_id, parent_id, end_id, depth, child_ix, ancestors, tag, attrs, text, vis_name)``;
    ``vis_name`` is the text where a word of it is not hidden, else empty."""
    rows = parsed.select("page_id", "bits", F.explode("nodes").alias("n"))
    text = text_of(F.col("n"))
    return rows.select("page_id", F.col("n.id").alias("node_id"), F.col("n.parent").alias("parent_id"), F.col("n.end").alias("end_id"), "n.depth", F.col("n.ix").alias("child_ix"), F.col("n.up").alias("ancestors"), "n.tag", "n.attrs", text.alias("text"), F.when(F.col("n.seen"), text).otherwise("").alias("vis_name"))
