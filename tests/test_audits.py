"""Golden cases of audits, storage, wire payloads and scorecards."""

from pyspark.sql import functions as F

from pagelens.operators import audits, scoring
from pagelens.sources import audits as store
from pagelens.sources import wire
from pagelens.streaming import audits as stream

# Four audits: two of each library, those of the second at one time, one of which has a code twice.
ROWS = [
    (audit, name, url, f"{day}T08:30:00Z", code, level, score)
    for audit, name, url, day, found in [
        ("m-1", "Map Room", "https://maps.example", "2025-02-03", [("COM1", "A", 2), ("FIL2", "AA", 5), ("NAV4", "AAA", 2)]),
        ("m-2", "Map Room", "https://maps.example", "2025-09-30", [("COM1", "A", 6), ("FIL2", "AA", 7), ("NAV4", "AAA", 5)]),
        ("s-1", "Sound Archive", "https://sound.example", "2025-04-12", [("COM1", "A", 1)]),
        ("s-2", "Sound Archive", "https://sound.example", "2025-04-12", [("COM1", "A", 3), ("COM1", "A", 4)]),
    ]
    for code, level, score in found
]


def situations(spark, more=()):
    return spark.createDataFrame(ROWS + list(more), "assessment_id string, dl_name string, dl_url string, created_at string, code string, level string, compliance_score int")


def test_aggregates(spark):
    maps, sound = "https://maps.example", "https://sound.example"
    rows = situations(spark, [("s-1", "Sound Archive", sound, "2025-04-12T08:30:00Z", "RED2", "A", None), ("s-1", "Sound Archive", sound, "2025-04-12T08:30:00Z", None, None, 4)])
    mean = lambda df: {r.code: (r.avg_score, r.n) for r in df.collect()}
    assert mean(audits.compliance_by_situation(rows, maps)) == {"COM1": (4.0, 2), "FIL2": (6.0, 2), "NAV4": (3.5, 2)}
    assert mean(audits.compliance_by_situation(rows, "All"))["COM1"] == (3.2, 5)
    assert [(r.level, r.avg_score) for r in audits.level_rollup(rows, maps).collect()] == [("A", 4.0), ("AA", 6.0), ("AAA", 3.5)]
    assert [r.avg_score for r in audits.trend_over_time(rows, maps).collect()] == [3.0, 6.0]
    assert [(r.assessment_id, r.avg_score) for r in audits.trend_over_time(rows, sound).collect()] == [("s-1", 2.5), ("s-2", 3.5)]
    assert mean(audits.compliance_by_code_sql(rows))["RED2"] == (None, 1)
    assert audits.compliance_by_situation(rows, "https://none").count() == 0
    tiles = {r.level: (r.avg_score, r.n) for r in audits.level_tiles(audits.compliance_by_code_sql(rows.where("level = 'AAA'"))).collect()}
    assert tiles == {"A": (None, 0), "AA": (None, 0), "AAA": (3.5, 2)}
    assert audits.headline_metrics(rows, maps).first() == (2, 2, "2025-09-30")
    assert {r.dl_url: r.dl_name for r in audits.library_names(rows).collect()} == {maps: "Map Room", sound: "Sound Archive"}


def test_store_round_trip(spark, tmp_path):
    findings = {"violations": [("x", 5, "fix")], "goodTechniques": []}
    nested = [("n1", "Lib", "https://l", None, "2026-01-01T00:00:00Z", None, None, None, (1, 2), [("ACC1", "A", "t", 4, 3, findings, None, "g", [("good", "e.png", None, "data:image/png;base64,AA")]), ("NAV2", "AA", "t", 6, None, None, None, None, [])]), ("n2", "Lib", None, None, None, None, None, None, None, [])]
    df = spark.createDataFrame(nested, store.NESTED)
    folder = f"file://{tmp_path}/store"
    store.save_assessments(df, folder)
    tables = store.read_audit_tables(spark, folder)
    assert [tables[k].count() for k in ("assessment", "situation_result", "evidence")] == [2, 2, 1]
    back = {r.id: r for r in store.nest_assessments(*(tables[k] for k in ("assessment", "situation_result", "evidence"))).collect()}
    assert back["n2"].situations == [] and back["n2"].dl_url == "" and back["n1"].dl_name == "Lib"
    first, second = back["n1"].situations
    assert (first.code, first.compliance_score, first.auto_findings.violations[0].msg, first.auto_findings.violations[0]["count"]) == ("ACC1", 4, "x", 5)
    assert first.evidence[0].filename == "e.png" and second.evidence == [] and second.auto_score is None
    store.export_audits_json(store.nest_assessments(*(tables[k] for k in ("assessment", "situation_result", "evidence"))), f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json/manifest").first()["count"] == 2
    a, s = tables["assessment"], tables["situation_result"]
    store.export_compliance_csv(audits.compliance_by_code_sql(audits.fetch_situations(a, s)), f"file://{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect())) == [("ACC1", "A", "4.000", "1"), ("NAV2", "AA", "6.000", "1")]


def test_wire(spark):
    payloads = [("r", '[{"type":"ok","response":{"type":"execute","result":{"cols":[{"name":"code"},{"name":"n"},{"name":"x"}],"rows":[[{"type":"text","value":"ACC1"},{"type":"integer","value":"4"},{"type":"null"}],[{"type":"text","value":"B"},{"type":"integer","value":"z"},{"type":"float","value":"1.5"}]]}}},{"type":"ok"}]'), ("e", '[{"type":"error","error":{"message":"no such table"}},{"type":"error"}]'), ("j", "nonsense"), ("n", None)]
    parsed = wire.parse_results(spark.createDataFrame(payloads, "id string, payload string"))
    assert [r["values"] for r in wire.decode_pipeline_results(parsed).orderBy("row").collect()] == [{"code": "ACC1", "n": "4", "x": None}, {"code": "B", "n": None, "x": "1.5"}]
    assert [(r.id, r.message) for r in wire.decode_pipeline_errors(parsed).collect()] == [("e", "no such table")]
    one = spark.createDataFrame([(None, 5, True, "hi", 3.14)], "a int, i int, b boolean, t string, f double")
    got = one.select(*[wire.encode_value(F.col(c), k) for c, k in (("a", "integer"), ("i", "integer"), ("b", "boolean"), ("t", "text"), ("f", "float"))]).first()
    assert list(got) == ['{"type":"null"}', '{"type":"integer","value":"5"}', '{"type":"integer","value":"1"}', '{"type":"text","value":"hi"}', '{"type":"float","value":"3.14"}']
    urls = spark.createDataFrame([("libsql://x.io/",), ("x.io",), ("https://x.io",), (None,)], "u string").select(wire.normalize_url(F.col("u"))).collect()
    assert [r[0] for r in urls] == ["https://x.io"] * 3 + [""]


def test_scorecard(spark):
    report = spark.createDataFrame([(1, 0, "FIL1/USE1", "flag", None, "no name"), (1, 1, "FIL1/USE1", "fix", 3, "named"), (1, 2, "FIL1/USE1", "flag", 2, "no name"), (1, 3, "MED1", "flag", 1, "x"), (1, 4, "ACC1", "error", 1, "y")], "page_id long, seq int, code string, kind string, count long, msg string")
    good = spark.createDataFrame([(1, "ACC1", "states the type", 2), (1, "ACC2", "alt", 1), (1, "COM3", "alt", 1)], "page_id long, token string, msg string, count long")
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")
    card = scoring.scorecard(pages, report, good).cache()
    assert card.count() == 48 and card.where("page_id = 2 and auto_score is not null").count() == 0
    by = {r.code: r for r in card.where("page_id = 1").collect()}
    assert (by["FIL1"].violations, by["FIL1"].auto_score, by["FIL1"].violations_note) == (5, 1, "• no name (×2)\n• named (×3)")
    assert by["USE1"].violations == 5 and by["USE1"].level == "AAA" and by["ACC1"].auto_score == 7 and by["ACC2/COM3"].good == 1
    meta = spark.createDataFrame([(1, "Lib", "https://l")], "page_id long, dl_name string, dl_url string")
    nested = scoring.to_assessment(card, meta)
    assert nested.first().auto_summary == (10, 3) and len(nested.first().situations) == 24
    assert store.flatten_audits(nested)["situation_result"].count() == 24


def test_ingest_is_exactly_once(spark, tmp_path):
    """Repeats within a batch, in a later one and long after; times that are none; lines that are no audit; a batch that comes again."""
    place = f"file://{tmp_path}"
    audit = lambda i, at="2025-01-01", code="A": f'{{"id": "{i}", "created_at": {at if at == "null" else chr(34) + at + chr(34)}, "situations": [{{"code": "{code}", "evidence": [{{"kind": "good"}}]}}], "new": {{"x": 1}}}}'
    batches = [
        [audit("a"), audit("a", "2024-01-01", "first"), audit("b", "never"), '{"id": "cut', "[1]", "", '"text"'],
        [audit("a", "2030-01-01"), audit("old", "1990-01-01"), audit("c", "null"), '{"dl_url": "no id"}', '{"dl_url": "no id"}'],
        [audit("old", "1980-01-01"), audit("b"), audit("d")],
    ]

    def state():
        got = store.read_audit_tables(spark, f"{place}/store")
        rows = got["situation_result"].join(got["assessment"].select(F.col("id").alias("assessment_id"), "created_at"), "assessment_id")
        return sorted((r.assessment_id, r.code, r.created_at) for r in rows.collect() if r.assessment_id != "c"), got["assessment"].count(), got["evidence"].count(), sorted(r.value for r in spark.read.parquet(f"{place}/store/rejected").collect())

    def run():
        stream.stream_audit_ingest(spark.readStream.text(f"{place}/in"), f"{place}/store", f"{place}/state").awaitTermination()

    for lines in batches:
        spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(f"{place}/in")
        run()
    want = ([("a", "first", "2024-01-01"), ("b", "A", "never"), ("d", "A", "2025-01-01"), ("old", "A", "1990-01-01")], 6, 5, sorted(["", '"text"', "[1]", '{"id": "cut']))
    assert state() == want
    # the last batch was stored but not marked as done, so it comes again
    last = max((int(p.name), p) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())[1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert state() == want
    run()
    assert state() == want


def test_half_a_batch_is_not_seen(spark, tmp_path):
    """A writer that dies before the headers leaves rows that no header names; the batch that comes again takes their place."""
    place = f"file://{tmp_path}/store"
    store.save_assessments(spark.createDataFrame([], store.NESTED), place, "none")
    lines = spark.createDataFrame([('{"id": "a", "situations": [{"code": "A"}]}',)], "value string")
    stream.ingest(lines, 0, place)
    stream.ingest(spark.createDataFrame([('{"id": "b", "situations": [{"code": "B"}]}',)], "value string"), 1, place)
    spark.createDataFrame([], store.SCHEMAS["assessment"]).write.mode("overwrite").parquet(f"{place}/assessment/batch=1")
    tables = lambda: store.read_audit_tables(spark, place)
    nested = lambda: sorted((r.id, [s.code for s in r.situations]) for r in store.nest_assessments(*(tables()[k] for k in ("assessment", "situation_result", "evidence"))).collect())
    assert nested() == [("a", ["A"])]
    stream.ingest(spark.createDataFrame([('{"id": "b", "situations": [{"code": "B"}]}',)], "value string"), 1, place)
    assert nested() == [("a", ["A"]), ("b", ["B"])]


def test_stored_text(spark):
    texts = ['{"violations": [{"msg": "m", "count": 2, "kind": "fix", "more": {}}], "goodTechniques": [{"msg": "g", "count": "3"}]}', '{"violations": "none"}', '{"violations": [1, {"msg": 5, "count": "x"}]}', '{"viol', "[]", "null", "", None, '{"goodTechniques": null}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, auto_findings string").withColumn("auto_summary", F.lit('{"violations": "4", "good": 1.0, "x": []}'))
    got = store.parse_stored_text(rows).orderBy("id").collect()
    plain = lambda x: None if x is None else [tuple(e) for e in x]
    assert [None if r.auto_findings is None else (plain(r.auto_findings.violations), plain(r.auto_findings.goodTechniques)) for r in got] == [
        ([("m", 2, "fix")], [("g", 3)]), (None, None), ([(None, None, None), ("5", None, None)], None), None, None, None, None, None, (None, None),
    ]
    assert [r.auto_findings_text for r in got] == [None, None, None, '{"viol', "[]", "null", "", None, None] and {tuple(r.auto_summary) for r in got} == {(4, 1)}
