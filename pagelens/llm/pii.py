"""Personal data in texts, and terms that give it away, by DataFrame functions alone.

Base spans are found by patterns. Beyond them, the corpus says how strongly a term reveals an entity: a term that the
documents with an entity use, in several different surroundings, and hardly any document without it, discloses the entity
although the entity itself is masked. Each use of such a term in a document with the entity becomes a span of the kind
``term``, wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_facts

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
# Stands for a mark that joins two characters of a match, and what stands for that character itself.
_JOINED, _OTHER = "", ""
#: Share of the documents with a term that must have the entity.
LEAST_SHARE = 0.5
#: Bits by which the term must raise the chance of the entity.
LEAST_BITS = 4.0
TERM = r"[\p{L}\p{M}\p{N}]+"
#: Texts are searched for terms in pieces that end where no term goes on; pieces cover a text without gaps.
PIECE = r"[\s\S]{1,200}[\p{L}\p{M}\p{N}]*+"


#: Values that a fold takes at a time: what it appends to stays short, so that a text of any number of matches takes linear time.
FOLD = 256
#: Characters of a text's parts from which pieces are cut, as a piece is looked for from the start of what it is cut from.
PART = 4096


def _before(values: Column, op) -> Column:
    """For each of ``values`` what ``op`` makes of 0 and all values before it."""

    def fold(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, state, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    zero = F.lit(0).cast("int")
    within = lambda blocks: F.flatten(F.zip_with(blocks, fold(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero), fold))
    parted = lambda v: F.transform(F.sequence(F.lit(0), F.greatest((F.ceil(F.size(v) / FOLD) - 1).cast("int"), F.lit(0))), lambda b: F.slice(v, b * FOLD + 1, F.lit(FOLD)))
    return F.get(F.transform(F.transform(F.array(values), parted), within), F.lit(0))


def _pieces(text: Column, bounds: Column) -> Column:
    """The pieces of ``text`` given by ``bounds``, an array of ``struct<s, e>`` in code points; empty where e isn't over s."""
    parts = F.array(F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{PART}}}"), F.lit(0)))

    def piece(p: Column, x: Column) -> Column:
        part = lambda k: F.substring(F.get(p, k), F.greatest(x["s"] - k * PART, F.lit(0)) + 1, F.least(x["e"] - k * PART, F.lit(PART)) - F.greatest(x["s"] - k * PART, F.lit(0)))
        which = F.sequence(F.floor(x["s"] / PART).cast("int"), F.floor((x["e"] - 1) / PART).cast("int"))
        return F.when(x["e"] > x["s"], F.array_join(F.transform(which, part), "")).otherwise("")

    return F.get(F.transform(parts, lambda p: F.transform(bounds, lambda x: piece(p, x))), F.lit(0))


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with something else in place of ``spans``, sorted ``struct<s, e, ...>`` that may overlap: ``by`` says what, from a
    span and the end of what is behind already."""
    last = F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0))
    ends = F.concat(_before(F.transform(spans, lambda x: x["e"]), lambda a, x: F.greatest(a, x)), F.array(last))
    starts = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text)))
    kept = lambda ends: _pieces(text, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("s"), s.alias("e"))))
    put = lambda ends: F.concat(F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), by), F.array(F.lit("")))
    both = lambda ends: F.array_join(F.zip_with(kept(ends), put(ends), lambda a, b: F.concat(a, b)), "")
    return F.get(F.transform(F.array(ends), both), F.lit(0))


def _matches(text: Column, pattern: str, valid, few: bool = False) -> Column:
    """Array of ``struct<s, e, v>`` of the valid matches of ``pattern``; what parts them says where they lie. Start and
    end count code points. ``few``: there are no more than a fold may append."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), F.length(v).alias("n"), F.length(g).alias("gap")))
    if not few:
        span = lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["v"].alias("v"))
        all_ = lambda pairs: F.zip_with(pairs, _before(F.transform(pairs, lambda x: x["gap"] + x["n"]), lambda a, x: a + x), span)
        return F.filter(F.get(F.transform(F.array(pairs), all_), F.lit(0)), lambda x: valid(x["v"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        one = F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v")))
        return F.struct((s + x["n"]).alias("at"), F.when(valid(x["v"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def _when(cond: Column, spans: Column) -> Column:
    return F.when(cond, spans).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


def _joined(text: Column, pattern: str) -> Column:
    """``text`` with one mark in place of each character that ``pattern`` matches; places stay as they are."""
    return F.regexp_replace(F.translate(text, _JOINED, _OTHER), pattern, _JOINED)


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled, is a multiple of ten."""
    back = F.split(F.reverse(digits), "")
    worth = F.transform(F.slice(back, F.lit(1), F.length(digits)), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans by kind; within a kind leftmost and not overlapping, matches that fail their test dropped.

    The patterns are those of the contract with loops over groups written as loops over characters, so that a match of
    any length takes no stack, and started only where a run starts, so that long runs take linear time.
    """
    word = "A-Za-z0-9._%+" + _JOINED + "-"
    email = rf"(?:\G|(?<![{word}]))[{word}]+@[A-Za-z0-9-]+{_JOINED}[A-Za-z0-9{_JOINED}-]+"
    dotted = _joined(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])")
    ip = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    short = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(short(p)) < 3) | (F.length(short(p)) == 3) & (short(p) <= "255"))
    spaced = _joined(text, r"(?<=[0-9])[ -](?=[0-9])")
    card = lambda v: F.length(digits(v)).between(16, 19) & _luhn(digits(v))
    return {
        "email": _when(text.contains("@"), _matches(dotted, email, lambda v: F.lit(True))),
        "ip": _when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), _matches(text, ip, small)),
        "card": _when(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _matches(spaced, rf"[0-9][0-9{_JOINED}]+", card)),
        "phone": _when(text.rlike(r"\+[0-9]"), _matches(text, r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(digits(v)).between(8, 15))),
    }


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(F.translate(value, _JOINED, "."))).otherwise(F.regexp_replace(value, "[^0-9.]", "")))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _mark(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text))


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, base array<struct<kind, k, s, e, entity>>, rest, hidden array<string>)`` of every row.
    ``mark`` tells texts apart. Where there are entities, ``rest`` is the text with blanks in their place, and ``hidden``
    holds the words that stand within entities only; elsewhere both are null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(F.col(id_col).alias("id"), text.alias("t"), _mark(text).alias("mark")).select("*", *[c.alias(k) for k, c in base_spans(F.col("t")).items()])

    def named(i: int, k: str) -> Column:
        return F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"), _entity(F.lit(k), x["v"]).alias("entity")))

    each = [named(i, k) for i, k in enumerate(KINDS)]
    got = got.select("id", "mark", "t", F.concat(*each).alias("base"))

    spans = F.array_sort(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    rest = _replaced(F.col("t"), F.col("spans"), lambda x, at: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], at), F.lit(0))))
    got = got.withColumn("spans", spans)
    got = got.withColumn("rest", F.when(F.size("base") > 0, rest))
    hidden = F.when(F.size("base") > 0, F.array_except(_words(F.col("t")), _words(F.col("rest"))))
    return got.select("id", "mark", "base", "rest", hidden.alias("hidden"))


def _places(text: Column) -> Column:
    """Terms of a text with their places, lower-cased."""
    every = lambda v: F.lit(True)
    within = lambda p: F.transform(_matches(p["v"], TERM, every, few=True), lambda x: F.struct((p["s"] + x["s"]).alias("s"), (p["s"] + x["e"]).alias("e"), F.lower(x["v"]).alias("term")))
    return F.flatten(F.transform(_matches(text, PIECE, every), within))


def _texts(base: DataFrame) -> DataFrame:
    """``(mark, rest, hidden, entities, n)`` of the different texts that hold entities, each in ``n`` rows."""
    some = base.where(F.size("base") > 0).select("mark", "rest", "hidden", F.array_distinct(F.transform("base", lambda x: x["entity"])).alias("entities"))
    return some.groupBy("mark").agg(*[F.first(c).alias(c) for c in ("rest", "hidden", "entities")], F.count("*").alias("n"))


def disclosing_terms(docs: DataFrame, texts: DataFrame, total: int, text_col: str = "text") -> DataFrame:
    """``(mark, term)`` of the terms that give an entity of a text away.

    A term gives an entity away by two figures over all ``total`` documents, whole texts without what is masked: ``share``, how
    many of those with the term have the entity, must reach LEAST_SHARE, and ``bits``, the pointwise mutual information of the two,
    LEAST_BITS. The words next to a term are its surroundings; of the documents with the entity the term needs two
    different ones, in one text or in several, so that a single use or copies of one text prove nothing.

    A text whose own rows are enough settles its terms with its rarest entity, without pairs. What is left can only pass with an
    entity and a term that two texts share, so pairs are made of shared ones alone: a text's other entities and terms, however
    many, make none. The documents' words are counted in each partition before they are dealt by word, and meet the terms of texts
    with entities as counts.
    """
    entities = texts.select("mark", "n", F.explode("entities").alias("entity"))
    known = entities.groupBy("entity").agg(F.sum("n").alias("with_entity"), F.count("*").alias("texts"))
    known = cut(known.where(F.col("with_entity") * F.lit(2.0**LEAST_BITS) <= F.lit(float(total))))
    most = (known.agg(F.max("with_entity")).first()[0] or 0) / LEAST_SHARE
    held = cut(entities.join(known, "entity"))
    words = texts.select("mark", "n", _words(F.col("rest")).alias("w"))
    used = words.select("mark", "n", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("term"), F.xxhash64(*[F.coalesce(F.get("w", k), F.lit("")) for k in (i - 1, i + 1)]).alias("place")))).alias("x"))
    used = used.groupBy("mark", "n", F.col("x.term").alias("term")).agg(F.min("x.place").alias("low"), F.max("x.place").alias("high"))
    used = cut(used.join(held.select("mark").distinct(), "mark", "left_semi"))
    again = cut(used.groupBy("term").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("texts")).where("low <> high").select("term", "texts"))
    every = docs.select(F.explode(F.array_distinct(_words(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"), F.lit(1).cast("long").alias("c"))
    hidden = texts.select(F.explode("hidden").alias("term"), (-F.col("n")).alias("c"))
    counts = every.unionByName(hidden).groupBy("term").agg(F.sum("c").alias("with_term")).where(F.col("with_term") <= most)
    rare = cut(used.join(cut(counts.join(again, "term")), "term"))
    # texts that settle a term by themselves
    best = held.groupBy("mark").agg(F.min("with_entity").alias("with_entity"))
    bits = lambda share: F.log2(share * F.lit(float(max(total, 1))) / F.col("with_entity"))
    share = F.col("n") / F.col("with_term")
    settled = rare.where("low <> high").where(share >= LEAST_SHARE).join(best, "mark").where(bits(share) >= LEAST_BITS).select("mark", "term")
    # pairs of what texts share
    pairs = rare.where("texts > 1").drop("texts").join(held.where("texts > 1").select("mark", "entity", "with_entity"), "mark").where(F.col("with_term") * F.lit(LEAST_SHARE) <= F.col("with_entity"))
    pairs = pairs.groupBy("entity", "term").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("together"), F.first("with_term").alias("with_term"), F.first("with_entity").alias("with_entity"))
    share = F.col("together") / F.col("with_term")
    given = pairs.where("low <> high").where(share >= LEAST_SHARE).where(bits(share) >= LEAST_BITS).select("entity", "term")
    shared = held.where("texts > 1").select("mark", "entity").join(given, "entity").select("mark", "term")
    return settled.unionByName(shared).distinct()


def _with_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, base, terms array<struct<s, e>>)`` of every row."""
    base = cut(find_base(docs, id_col, text_col))
    texts = cut(_texts(base))
    total = base.count()
    said = disclosing_terms(docs, texts, total, text_col).groupBy("mark").agg(F.collect_set("term").alias("said"))
    hits = F.transform(F.filter(_places(F.col("rest")), lambda x: F.array_contains("said", x["term"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    terms = cut(texts.join(said, "mark").select("mark", "n", hits.alias("terms")))
    # copies of one text may be a large part of all rows
    return with_facts(base, terms, "mark", "n", total, "left").select("id", "mark", "base", F.coalesce("terms", F.array().cast("array<struct<s:int,e:int>>")).alias("terms"))


def _listed(spans: Column, kind) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"], x["e"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data and of disclosing terms in every whole text.

    Returns ``(id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)``, one row per input row. ``spans`` lists
    ``kind:start:end`` in code points, end exclusive, by kind (email, ip, card, phone, term), then start;
    ``base_sha256`` is the digest of that list without terms. A null text is empty and has no spans; null ids and repeated
    rows are rows like others; an empty table gives no rows; other columns are left out.
    """
    got = _with_terms(docs, id_col, text_col)
    base, terms = _listed(F.col("base"), lambda x: x["kind"]), _listed(F.col("terms"), lambda x: F.lit("term"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    nonempty = lambda c: F.when(c != "", c)
    return got.select(F.col("id").alias(id_col), *counts, F.size("terms").cast("long").alias("n_term"), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", nonempty(base), nonempty(terms)).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of :func:`find` replaced by its kind in brackets; all columns kept, null texts null.

    Overlapping spans are replaced as one, by the kind of the first. A disclosing term is generalised to ``[TERM]``.
    """
    got = _with_terms(docs, id_col, text_col)
    spans = F.concat(F.transform("base", lambda x: F.struct(x["s"], x["e"], F.upper(x["kind"]))), F.transform("terms", lambda x: F.struct(x["s"], x["e"], F.lit("TERM"))))
    spans = F.array_sort(spans.cast("array<struct<s:int,e:int,kind:string>>"))
    marked = got.where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), spans.alias("__spans")).dropDuplicates(["__id", "__mark"])
    own = docs.withColumn("__own", _mark(F.coalesce(F.col(text_col), F.lit(""))))
    both = own.join(marked, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    done = _replaced(F.col(text_col), F.col("__spans"), lambda x, at: F.when(x["s"] >= at, F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(""))
    return both.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(done)).select(*docs.columns)
