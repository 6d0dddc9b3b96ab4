"""Queries of the training-data operators, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hnsw, lexical, licenses, manifest, ngram_join, packing, pii, quality, sharding, token_counts, warc
from .common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op2 over ``embeddings`` with copies that are scaled, mixed with the next vector, or cut to half their
    length, so that there are links to find."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    made = lambda add, every, v: e.where(F.col("vec_id") % every == 0).select((F.col("vec_id") + add).alias("vec_id"), v.alias("embedding"))
    scaled = made(10_000_000, 4, F.transform("embedding", lambda x: x * 3))
    half = F.slice("embedding", 1, 32)
    cut, again = made(30_000_000, 10, half), made(40_000_000, 10, F.transform(half, lambda x: x / 2))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = e.join(following, "vec_id").where("vec_id % 3 = 0").select((F.col("vec_id") + 20_000_000).alias("vec_id"), F.zip_with("embedding", "other", lambda x, y: x + y * 0.25).alias("embedding"))
    return hnsw.near_duplicates(e.unionByName(scaled).unionByName(cut).unionByName(again).unionByName(mixed)).select("vec_id", "n_links", "component_id", "kept")


def _length_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = token_counts.token_lengths(docs.select(F.col("lang").alias("id"), "text"), RANKS, PATTERN, "id")
    return token_counts.suffix_sums(token_counts.length_histogram(lengths.withColumnRenamed("id", "lang"), by=["lang"]), by=["lang"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths by language with its suffix sums: one row per language and length."""
    return _length_sums(spark, sf_dir)


def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays and what is cut by language at stated context limits, from the suffix sums of op3."""
    return token_counts.truncated_totals(_length_sums(spark, sf_dir), [128, 512, 2048, 8192, 32768], by=["lang"])


def token_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of encoded lengths by language, from the suffix sums of op3."""
    return token_counts.quantiles(_length_sums(spark, sf_dir), [0.1, 0.5, 0.9, 0.99, 1.0], by=["lang"])


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in documents with their wording differences as text."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "start", "end", F.round("saved", 6).alias("saved"), F.array_join("missing", " ").alias("missing"), F.array_join("added", " ").alias("added"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of every record read back from the archives; ``problem`` is empty where a record is as it was written."""
    return warc.through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("problem", F.lit("")).alias("problem"))


def page_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op6 over ``pages`` with copies of their html, empty and missing ones, so that there are revisits."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    again = p.where("page_id % 3 = 0").select((F.col("page_id") + 10_000_000).alias("page_id"), F.lit(None).cast("string").alias("url"), "html")
    html = F.when(F.col("page_id") % 2 == 0, "").when(F.col("page_id") % 5 == 0, F.concat(F.lit("<p>"), (F.col("page_id") % 7).cast("string")))
    rest = p.select((F.col("page_id") + 20_000_000).alias("page_id"), "url", html.alias("html"))
    return warc.through_archives(p.unionByName(again).unionByName(rest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("problem", F.lit("")).alias("problem"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the shingles of question and answer that were found."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "question_shingles", "question_found", "answer_shingles", "answer_found")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN, offsets=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; texts of a third of the ids are tampered with before they are verified."""
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    own, changed = manifest.leaf(*map(F.col, LEAF_COLUMNS)), manifest.leaf(*map(F.col, LEAF_COLUMNS[:-1]), tampered)
    proved = manifest.prove(docs.select("doc_id", "lang", own.alias("leaf"), changed.alias("changed")))
    return manifest.verify(proved, "changed").select("doc_id", "leaf", "subroot", "root", manifest.siblings(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_hnsw, op3_token_counts, op4_sampled_splitters, op5_licenses, op6_warc, op7_ngram_join, op8_decontaminate, op9_byte_bpe, op10_pii, op11_packing, op12_manifest, op13_lexical_search, vector_copies, page_copies, token_limits, token_quantiles)}

#: Word shingles as the join reads them, and the smallest id that links reach.
JACCARD_SQL = r"""
with recursive w as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) >= 5 then [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, len(sh)::bigint as n from s),
g as (select doc_id, unnest(sh) as sh from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as met from g a join g b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * met >= 75 * (x.n + y.n - met)),
r as (select a as node, b as reach from e union select r.node, e.b from r join e on e.a = r.reach)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(r.reach), n.doc_id)) as component_id
from n left join r on r.node = n.doc_id group by n.doc_id, n.n"""

#: Distinct shingles of each item's question and answer, and how many of them a document holds. What the search retrieves
#: is a superset of this, or the two differ.
OVERLAP_SQL = r"""
with items as (select item_id, trim(text) as t, regexp_extract(trim(text), '(?s)^(.*[.!?])\s+(.+)$', ['q', 'a']) as qa from benchmark),
parts as (select item_id, 'q' as part, case when qa.q = '' then t else qa.q end as t from items union all select item_id, 'a', qa.a from items),
iw as (select item_id, part, regexp_extract_all(lower(t), '[a-z0-9\x{80}-\x{10FFFF}]+') as ws from parts),
ish as (select item_id, part, greatest(1, least(5, len(ws))) as k,
    unnest(list_distinct([array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') for i in range(1, len(ws) - least(5, len(ws)) + 2)])) as sh
  from iw where len(ws) > 0),
dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') as ws from documents),
dsh as (select doc_id, k, unnest(list_distinct([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)])) as sh
  from dw, (select distinct k from ish)),
need as (select item_id, count(*) filter (part = 'q') as nq, count(*) filter (part = 'a') as na from ish group by item_id),
got as (select doc_id, item_id, count(*) filter (part = 'q') as fq, count(*) filter (part = 'a') as fa
  from ish join dsh using (k, sh) group by doc_id, item_id)
select doc_id, item_id, nq as question_shingles, fq as question_found, na as answer_shingles, fa as answer_found
from got join need using (item_id) where 100 * fq >= 75 * nq and 100 * fa >= 75 * na"""

#: All pairs by cosine in double precision, and the smallest id that links reach.
COSINE_SQL = """
with recursive given as ({given}),
v as (select vec_id, x from given
  where x is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and case when len(a.x) = len(b.x) then list_cosine_similarity(a.x, b.x) >= 0.95 else false end),
r as (select a as node, b as reach from e union select r.node, e.b from r join e on e.a = r.reach),
n as (select a, count(*) as n from e group by a),
c as (select node, min(reach) as low from r group by node)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id <= coalesce(low, vec_id) as kept
from given left join n on a = vec_id left join c on node = vec_id"""
GIVEN_SQL = "select vec_id, embedding::double[] as x from embeddings"
COPIES_SQL = f"""with e as ({GIVEN_SQL}) select * from e union all select vec_id + 10000000, list_transform(x, lambda c: c * 3) from e where vec_id % 4 = 0
  union all select vec_id + 30000000, x[1:32] from e where vec_id % 10 = 0 union all select vec_id + 40000000, list_transform(x[1:32], lambda c: c / 2) from e where vec_id % 10 = 0
  union all select a.vec_id + 20000000, list_transform(list_zip(a.x, b.x), lambda z: z[1] + z[2] * 0.25) from e a join e b on b.vec_id = a.vec_id + 1 where a.vec_id % 3 = 0"""

#: Digests in base 32, five hexadecimal digits to four characters; of equal payloads the largest page is the response.
WARC_SQL = """
with given as ({given}), p as (select page_id, coalesce(html, '') as t from given),
h as (select *, list_transform(range(8), lambda g: ('0x' || sha1(t)[5 * g + 1:5 * g + 5])::int) as fives, max(page_id) over (partition by t) as last from p)
select page_id, octet_length(encode(t))::bigint as payload_bytes,
  array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (v >> k) % 32]), '')), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id < last then last end as refers_to, '' as problem from h"""

#: Levels of eight by language, then of the languages' tops; a CRC bit by bit; proofs and folded roots level by level.
MANIFEST_SQL = r"""
with recursive f as (select doc_id, lang, source, n_chars, text, coalesce('=' || lang, '') as k from documents),
fld as (select *, [case when x is null then '-' else octet_length(encode(x)) || ':' || x end for x in [doc_id::varchar, source, lang, n_chars::varchar]] as head from f),
crc as (select *, list_reduce([4294967295::bigint] || list_transform(range(8 * len(doc_id::varchar)),
    lambda b: ((ord((doc_id::varchar)[1 + b // 8]) >> (b % 8)) & 1)::bigint), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))) as c from fld),
chg as (select *, case when xor(c, 4294967295) % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as t2 from crc),
lf as (select doc_id, k, sha256(array_to_string(head, '') || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) as leaf,
    sha256(array_to_string(head, '') || case when t2 is null then '-' else octet_length(encode(t2)) || ':' || t2 end) as changed from chg),
l as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by k) as n from lf),
tree as (select k, 0 as lvl, i, n, leaf as h from l union all
  select k, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by k, lvl, i // 8, (n + 7) // 8),
tops as (select k, max(lvl) as high, arg_max(h, lvl) as subroot, row_number() over (order by k) - 1 as place, count(*) over () as n from tree group by k),
above as (select 0 as lvl, place as i, n, subroot as h from tops union all
  select lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from above where n > 1 group by lvl, i // 8, (n + 7) // 8),
root as (select max(lvl) as high, arg_max(h, lvl) as root from above),
sibs as (
  select k, lvl, i, coalesce((select string_agg(b.h, '' order by b.i) from tree b where b.k = a.k and b.lvl = a.lvl and b.i // 8 = a.i // 8 and b.i < a.i), '') as lo,
    coalesce((select string_agg(b.h, '' order by b.i) from tree b where b.k = a.k and b.lvl = a.lvl and b.i // 8 = a.i // 8 and b.i > a.i), '') as hi
  from tree a where n > 1),
rsibs as (
  select lvl, i, coalesce((select string_agg(b.h, '' order by b.i) from above b where b.lvl = a.lvl and b.i // 8 = a.i // 8 and b.i < a.i), '') as lo,
    coalesce((select string_agg(b.h, '' order by b.i) from above b where b.lvl = a.lvl and b.i // 8 = a.i // 8 and b.i > a.i), '') as hi
  from above a where n > 1),
walk as (
  select l.k, l.i, l.doc_id, l.leaf, 0 as step, l.changed as h, '' as proof, t.high, t.subroot, t.place from l join tops t using (k) union all
  select w.k, w.i, w.doc_id, w.leaf, w.step + 1, sha256(s.lo || w.h || s.hi), w.proof || s.lo || s.hi, w.high, w.subroot, w.place
  from walk w join sibs s on s.k = w.k and s.lvl = w.step and s.i = w.i // (8 ** w.step)::bigint where w.step < w.high),
rise as (
  select doc_id, leaf, subroot, 0 as step, h, proof, place from walk where step = high union all
  select r.doc_id, r.leaf, r.subroot, r.step + 1, sha256(s.lo || r.h || s.hi), r.proof || s.lo || s.hi, r.place
  from rise r join rsibs s on s.lvl = r.step and s.i = r.place // (8 ** r.step)::bigint)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from rise, root where step = high"""

#: Scores in 64-bit integers, weights in doubles.
SEARCH_SQL = r"""
with low as (select translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, doc_id, row_number() over () as d from documents),
w as (select d, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from low),
tf as (select d, doc_id, term, count(*) as tf from w group by all),
len as (select d, count(*)::bigint as n from w group by d),
tot as (select count(*)::bigint as docs, sum(n)::bigint as words from len),
dfs as (select term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1)))::bigint as weight from tf, tot group by term, docs),
ask as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select item_id, d, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::bigint as score
  from ask join tf using (term) join dfs using (term) join len using (d), tot group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50"""

COPIED_PAGES_SQL = """select page_id, html from pages union all select page_id + 10000000, html from pages where page_id % 3 = 0
  union all select page_id + 20000000, case when page_id % 2 = 0 then '' when page_id % 5 = 0 then '<p>' || (page_id % 7) end from pages"""

ORACLE_SQL: dict[str, str] = {"op2_hnsw": COSINE_SQL.format(given=GIVEN_SQL), "vector_copies": COSINE_SQL.format(given=COPIES_SQL), "op6_warc": WARC_SQL.replace("{given}", "select * from pages"), "page_copies": WARC_SQL.replace("{given}", COPIED_PAGES_SQL), "op7_ngram_join": JACCARD_SQL, "op8_decontaminate": OVERLAP_SQL, "op12_manifest": MANIFEST_SQL, "op13_lexical_search": SEARCH_SQL}
