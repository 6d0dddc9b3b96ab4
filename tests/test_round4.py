"""What the findings of the fourth round were about, on tables made for them."""

import re
import time

from pagelens.operators import scoring
from pagelens.plans import audit_queries
from pagelens.sources import audits as store
from pagelens.sources import shapes

from .test_round3 import against_sql, write


def orders(folder):
    """Orders of which some are there twice or have no lines; lines without an order."""
    key = "(i // 2 * (1 + i % 2))::bigint"
    write(folder / "orders.parquet", f"select {key} as o_orderkey, i::bigint as o_custkey, 'p' as o_orderpriority, 'O' as o_orderstatus, date '2024-01-01' + i::int as o_orderdate from range(60) t(i)")
    write(folder / "lineitem.parquet", """select (i // 5)::bigint as l_orderkey, (1 + i % 7)::int as l_linenumber, (i * 31)::bigint as l_partkey, (i * 17)::bigint as l_suppkey, (i % 50)::double as l_quantity,
      i * 1.5::double as l_extendedprice, (i % 4) / 100.0::double as l_tax, case when i % 3 = 0 then 'R' else 'N' end as l_returnflag, case when i % 2 = 0 then 'O' else 'F' end as l_linestatus, date '2024-02-01' + (i % 300)::int as l_shipdate from range(400) t(i)""")
    return str(folder)


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def let_go(spark, before):
    """Whether what was shuffled since is gone, or goes soon."""
    return any(time.sleep(0.1) or not shuffled(spark) - before for _ in range(50))


def test_a_page_is_shuffled_as_its_lines_not_as_its_24_rows(spark, tmp_path):
    d = orders(tmp_path)
    for q in ("scorecard", "auto_summary"):
        against_sql(spark, q, d, "orders", "lineitem")
    meta = shapes.table(spark, d, "orders").selectExpr("o_orderkey as page_id", "'u' as dl_url").repartition("page_id")
    plan = scoring.to_assessment(audit_queries.audit_card(spark, d), meta)._jdf.queryExecution().executedPlan().toString()
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, \d+\)", plan)) == ["l_orderkey", "l_orderkey", "page_id", "page_id"] and plan.count("Exchange hashpartitioning") == 4


def test_what_a_save_shuffles_goes_with_it(spark, tmp_path):
    d = orders(tmp_path)
    meta = shapes.table(spark, d, "orders").selectExpr("o_orderkey as page_id", "'u' as dl_url")
    before, key = shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to = spark.conf.get(key)
    store.save_assessments(scoring.to_assessment(audit_queries.audit_card(spark, d), meta), f"file://{tmp_path}/store", "b")
    assert let_go(spark, before) and spark.conf.get(key) == set_to
    assert store.read_audit_tables(spark, f"file://{tmp_path}/store")["situation_result"].count() % 24 == 0
    assert all(".zstd." in p.name for p in (tmp_path / "store" / "situation_result" / "batch=b").glob("*.parquet"))


def test_an_export_is_compressed_and_counted_as_it_is_written(spark, tmp_path):
    d = orders(tmp_path)
    tables = [f(spark, d) for f in (shapes.assessment, shapes.situation_result, shapes.evidence)]
    nested = store.nest_assessments(*tables)
    kept = nested.collect()
    seen, before = spark.sparkContext.accumulator(0), shuffled(spark)
    meet = lambda rows: (seen.add(1) or r for r in rows)
    store.export_audits_json(spark.createDataFrame(nested.rdd.mapPartitions(meet), nested.schema), f"file://{tmp_path}/json")
    assert seen.value == len(kept) == 60  # no row is made again for the count
    files = [p.name for p in (tmp_path / "json" / "audits").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = {r.id: r for r in store.read_nested(spark, f"file://{tmp_path}/json/audits").collect()}
    assert {k: [(s.code, len(s.evidence)) for s in r.situations] for k, r in back.items()} == {r.id: [(s.code, len(s.evidence)) for s in r.situations] for r in kept}
    manifest = spark.read.json(f"file://{tmp_path}/json/manifest")
    assert [r["count"] for r in manifest.collect()] == [60] and set(manifest.columns) == {"exported_at", "count"}
    store.export_audits_json(nested, f"file://{tmp_path}/json")  # over the last one
    assert let_go(spark, before) and spark.read.json(f"file://{tmp_path}/json/manifest").first()["count"] == 60
    store.export_audits_json(nested.where("id = 'none'"), f"file://{tmp_path}/none")
    assert spark.read.json(f"file://{tmp_path}/none/manifest").first()["count"] == 0
