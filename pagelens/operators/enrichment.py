"""Descriptions, text recognition and transcripts as a batch: plan, run once per content, label, apply."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import any_inside, attr, filled, first_inside, has_attr, tag_in, text_of

# What can be asked for, and what happens with requests of each unless it is said otherwise.
POLICIES = {"ocr": "ask", "describeImage": "ask", "describeGraph": "ask", "reflowPdf": "auto", "transcribe": "ask"}

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def content_key(text: Column) -> Column:
    """FNV-1a of a text's UTF-16 units, so a character beyond the basic plane counts as two: 32 bits as eight hexadecimal digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), F.lit(0))
    h = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda a, u: (a.bitwiseXOR(F.conv(u, 16, 10).cast("bigint")) * 16777619) % 4294967296)
    return F.lpad(F.lower(F.hex(h)), 8, "0")


@dataclass
class Registered:
    """A provider of a capability: its name, what runs it, and whether it can be used now."""

    cap: str
    name: str
    run: Provider | None = None
    available: Callable[[], bool] = lambda: True


class Providers:
    """Providers by capability and what is done with requests of each; the last one registered counts."""

    def __init__(self, **policies: str):
        self.known: dict[str, Registered] = {}
        self.policy = POLICIES | policies

    def register(self, provider: Registered) -> Providers:
        if provider.cap not in POLICIES:
            raise ValueError(f"unknown capability: {provider.cap}")
        self.known[provider.cap] = provider
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(cap, name, available, policy)`` of every capability."""
        one = lambda c: self.known.get(c)
        return spark.createDataFrame([(c, one(c) and one(c).name, bool(one(c) and one(c).available()), p) for c, p in self.policy.items()], "cap string, name string, available boolean, policy string")


def node_requests(audited: DataFrame) -> DataFrame:
    """``(page_id, ix, cap, src, label, hash_source)`` for elements anywhere on an audited page: images that the rules marked as
    in need of words, and video or audio without captions. ``ix`` is the element's number."""
    image = lambda x: (x["tag"] == "img") & has_attr(x, "data-needs-alt") & filled(attr(x, "src"))
    caption = lambda y: (y["tag"] == "track") & F.coalesce(attr(y, "kind").isin("captions", "subtitles"), F.lit(False))
    media = lambda x: tag_in(x, "video", "audio") & ~any_inside(x, caption)

    def request(x: Column) -> Column:
        source = F.coalesce(F.nullif(attr(x, "src"), F.lit("")), attr(first_inside(x, lambda y: y["tag"] == "source"), "src"), F.lit(""))
        label = F.coalesce(F.nullif(attr(x, "aria-label"), F.lit("")), attr(x, "title"), text_of(x))
        return F.struct(x["id"].alias("ix"), F.when(image(x), "describeImage").otherwise("transcribe").alias("cap"), source.alias("src"), label.alias("label"), source.alias("hash_source"))

    # made on the page: a row for each element would carry the whole page
    asked = F.transform(F.filter("nodes", lambda x: image(x) | media(x)), request)
    return audited.select("page_id", F.explode_outer(asked).alias("r")).where("r is not null").select("page_id", "r.*")


def requests_of(blocks: DataFrame) -> DataFrame:
    """``(page_id, ix, cap, src, label, hash_source)`` for each image and graphic of a reading model that needs words."""
    cap = F.when(F.col("type") == "graph", "describeGraph").otherwise("describeImage")
    rows = blocks.where("type in ('image', 'graph') and needs_desc")
    return rows.select("page_id", "ix", cap.alias("cap"), F.coalesce("src", F.lit("")).alias("src"), F.coalesce("text", F.lit("")).alias("label"), F.coalesce(F.nullif("src", F.lit("")), "text", F.lit("")).alias("hash_source"))


def with_key(requests: DataFrame) -> DataFrame:
    """Adds ``key``: the capability, a digest of the content, and its :func:`content_key`. Of some 100,000 contents two have one
    content key, so that alone would give one of them the other's words."""
    content = F.coalesce("hash_source", F.lit(""))
    return requests.withColumn("key", F.concat_ws(":", "cap", F.sha2(content, 256), content_key(content)))


def plan_requests(requests: DataFrame, providers: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``state`` and ``note``: done if the key is cached, skipped without a provider or when turned off, held if a
    person must ask for it, else queued. ``providers(cap, name, available, policy)``, ``cache(key, ...)``."""
    known = cache.select("key").distinct().withColumn("cached", F.lit(True))
    rows = requests.join(known, "key", "left").join(F.broadcast(providers.select("cap", "available", "policy")), "cap", "left")
    none = ~F.coalesce("available", F.lit(False))
    state = F.when(F.col("cached"), "done").when(none | (F.col("policy") == "off"), "skipped").when(F.col("policy") == "ask", "held").otherwise("queued")
    note = F.when(F.col("cached"), "").when(none, "no provider configured").when(F.col("policy") == "off", "turned off").when(F.col("policy") == "ask", "waiting for you to run it").otherwise("")
    return rows.withColumn("state", state).withColumn("note", note).withColumn("cached", F.coalesce("cached", F.lit(False))).drop("available", "policy")


def call_provider(planned: DataFrame, provider: Provider, name: str, concurrency: int) -> DataFrame:
    """``(key, result, error, generated, verified, provider)``: each queued key once, in ``concurrency`` tasks: as many as
    the service takes at a time. ``provider`` maps batches of ``(key, cap, src, label)`` to ``(key, result, error)``."""
    todo = planned.where("state = 'queued'").groupBy("key").agg(F.first("cap").alias("cap"), F.min("src").alias("src"), F.min("label").alias("label"))
    done = todo.repartition(concurrency).mapInPandas(_guarded(provider), "key string, result string, error string")
    return stamp_provenance(done, name)


#: Keys that a provider gets at a time; when a call fails as a whole, so many fail with it.
CALL_KEYS = 32


def _guarded(provider: Provider) -> Provider:
    """A provider whose failures are rows: a call that raises, or gives no row for a key, is an error of its keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CALL_KEYS):
                asked = b.iloc[at : at + CALL_KEYS].reset_index(drop=True)
                try:
                    got = pd.concat([pd.DataFrame({"key": [], "result": [], "error": []}), *provider(iter([asked]))])
                    got = got.drop_duplicates("key")
                except Exception as e:  # noqa: BLE001 - what a service raises is its own affair
                    got = pd.DataFrame({"key": asked["key"], "result": None, "error": str(e) or type(e).__name__})
                out = asked[["key"]].merge(got[["key", "result", "error"]], "left", "key")
                out["error"] = out["error"].where(out["error"].notna() | out["result"].notna(), "no result")
                yield out.astype(object).where(out.notna(), None)

    return run


def per_item(call: Callable[[str, str, str], str]) -> Provider:
    """A provider from a function of ``(cap, src, label)``; what it raises is the error of that key alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    rows.append((r.key, call(r.cap, r.src, r.label), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.key, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["key", "result", "error"])

    return run


_CALLS = "key string, result string, error string, generated boolean, verified boolean, provider string"


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every call of the runs kept in ``folder``, with ``run`` and ``attempt``."""
    return spark.read.schema(f"{_CALLS}, run string, attempt int").parquet(f"{folder}/calls")


def enrichment_cache(calls: DataFrame) -> DataFrame:
    """What has succeeded, a row a key: of two runs that both called for a key the first by name counts."""
    good = calls.where("error is null and result is not null")
    return good.groupBy("key").agg(F.min_by(F.struct("result", "generated", "verified", "provider"), F.struct("run", "attempt")).alias("c")).select("key", "c.*")


def run_enrichment(requests: DataFrame, providers: Providers, folder: str, run: str, concurrency: int = 2, attempts: int = 2) -> DataFrame:
    """Run what can be run of ``requests`` with keys, keep it in ``folder``, and say how each request ended.

    Each attempt plans anew against the cache, so a key is called for once an attempt until it succeeds, whatever number of
    requests have it, and never again in later runs. Capabilities run one after the other, each in ``concurrency`` tasks, so a service has no
    more callers than that. Calls are written before they are read, a folder an attempt and capability, which the same run
    writes over if it is repeated; a failure is a row with its error. Adds ``state``, ``note``, ``result`` and ``provider``:
    done, failed with the last error, or as planned.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], _CALLS).write.mode("overwrite").parquet(f"{folder}/calls/run=none/attempt=0/cap=none")
    live = {c: p for c, p in providers.known.items() if p.run and p.available() and providers.policy[c] == "auto"}
    known = providers.rows(spark)
    for attempt in range(1, attempts + 1):
        planned = plan_requests(requests, known, enrichment_cache(read_calls(spark, folder))).where(F.col("cap").isin(list(live)))
        if planned.where("state = 'queued'").isEmpty():
            break
        for cap, p in live.items():
            call_provider(planned.where(F.col("cap") == cap), p.run, p.name, concurrency).write.mode("overwrite").parquet(f"{folder}/calls/run={run}/attempt={attempt}/cap={cap}")
    calls = read_calls(spark, folder)
    cache = enrichment_cache(calls)
    errors = calls.where((F.col("run") == run) & F.col("error").isNotNull()).groupBy("key").agg(F.max_by("error", "attempt").alias("error"))
    ended = plan_requests(requests, known, cache).join(cache.select("key", "result", "provider"), "key", "left").join(errors, "key", "left")
    failed = (F.col("state") == "queued") & F.col("error").isNotNull()
    return ended.withColumn("note", F.when(failed, F.col("error")).otherwise(F.col("note"))).withColumn("state", F.when(failed, "failed").otherwise(F.col("state"))).drop("error")


def stamp_provenance(results: DataFrame, name: str) -> DataFrame:
    return results.withColumn("generated", F.lit(True)).withColumn("verified", F.lit(False)).withColumn("provider", F.lit(name))


def enrichment_status(planned: DataFrame) -> DataFrame:
    return planned.groupBy("cap", "state").agg(F.count("*").alias("n"))


def apply_descriptions(blocks: DataFrame, requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``blocks`` with words filled in where they are still needed; blank results change nothing. Adds ``generated``."""
    found = requests.select("page_id", "ix", "key").join(cache.where("trim(result) <> ''").select("key", F.trim("result").alias("result")), "key").drop("key")
    rows = blocks.join(found, ["page_id", "ix"], "left")
    use = F.col("needs_desc") & F.col("result").isNotNull()
    return rows.withColumn("text", F.when(use, F.col("result")).otherwise(F.col("text"))).withColumn("generated", F.coalesce(use, F.lit(False))).withColumn("needs_desc", F.col("needs_desc") & ~F.coalesce(use, F.lit(False))).drop("result")
