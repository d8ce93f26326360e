"""Round trips of sources, sinks and the stream."""

import json

from pyspark.sql import functions as F

from lexisift.sinks import reports
from lexisift.sources import corpus
from lexisift.streaming import scorer


def test_case_files(spark, tmp_path):
    case = {"id": "a", "input": "x “y”", "expected_changes": ["“"], "domain": "casual"}
    (tmp_path / "pattern_019.json").write_text(json.dumps({"pattern_id": 19, "pattern_name": "q", "lang": "en", "cases": [case, {"id": "b"}]}, indent=1))
    (tmp_path / "other.json").write_text("{}")
    from lexisift.operators.evals import flat_cases

    got = {r.id: r for r in flat_cases(corpus.pattern_files(spark, str(tmp_path))).collect()}
    assert got["a"].expected_changes == ["“"] and got["b"].expected_unchanged == [] and got["b"].true_negative is False


def test_texts(spark, tmp_path):
    for name, text in {"a.md": "---\ndomain: legal\n---\nBody\n", "b.txt": "plain", "c.json": '{"input": "in"}', "d.json": "not json", "_skip.md": "no"}.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in corpus.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "---\ndomain: legal\n---\nBody\n", "b.txt": "plain", "c.json": "in", "d.json": "not json"}
    assert {(r.domain, r.body) for r in corpus.samples(spark, str(tmp_path)).collect()} == {("legal", "Body"), ("casual", "plain")}


def test_xml_records(spark, tmp_path):
    record = "<record><header><identifier>{}</identifier></header><metadata><dc><title>T</title><description>D</description><language>{}</language></dc></metadata></record>"
    (tmp_path / "r.xml").write_text("<all>" + record.format(1, "ger") + record.format(2, "en") + "</all>")
    assert [(r.id, r.text) for r in corpus.records(spark, str(tmp_path / "r.xml")).collect()] == [("1", "T D")]


def test_corpus_round_trip(spark, tmp_path):
    rows = [("1", "http://x", "PD", "open", "2024-01-01", {"domain": "a: b"}, "Text\n", "s1"), ("2", None, None, "open", None, None, None, "s1")]
    docs = spark.createDataFrame(rows, "id string, source_url string, license string, license_class string, fetch_date string, metadata map<string,string>, text string, source string")
    reports.write_corpus(docs, str(tmp_path / "out"))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()}
    assert got["1"].content.startswith("---\nid: 1\nsource_url: \"http://x\"\n") and '  domain: "a: b"\n---\n\nText' in got["1"].content
    assert spark.read.json(str(tmp_path / "out/sources")).first().doc_count == 2


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "results")
    for _ in range(2):
        reports.append_results(spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, v int"), path, ["id"])
    assert spark.read.parquet(path).count() == 2


def test_reports_and_candidates(spark, tmp_path):
    summary = spark.createDataFrame([(3, 0.5)], "cases int, rate double").first()
    a, b = reports.write_report(str(tmp_path), "r", summary, spark.createDataFrame([(7, 0.9)], "pattern_id int, rate double").collect())
    assert json.loads(a.read_text())["summary"]["cases"] == 3 and "| #7 | 0.9 |" in b.read_text()
    reports.write_candidates(spark.createDataFrame([(1, "x y")], "rank int, ngram string"), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first().ngram == "x y"


def test_log_skips_bad_lines(spark, tmp_path):
    reports.append_log(spark.createDataFrame([("a", 1)], "id string, rep int"), str(tmp_path / "log"))
    (tmp_path / "log" / "more.json").write_text('{"id": "b", "rep": 2}\n{broken\n')
    assert corpus.json_lines(spark, str(tmp_path / "log")).count() == 2


def test_rule_pack(spark):
    text = "# P\n### 7. Words\n**Words to watch:** a, b; `c`\n\n**Before:**\n> one\n> two\n\n**After:**\n> x\n### 8. Next\nbody"
    s = corpus.rule_sections(spark.createDataFrame([("en", text)], "pack string, text string"))
    assert [(r.rule_id, r.name) for r in s.orderBy("rule_id").collect()] == [(7, "Words"), (8, "Next")]
    c = reports.seeded_cases(s, "en").first()
    assert c.pattern_id == 7 and c.cases[0].input == "one two" and c.cases[0].expected_changes == ["a", "b"]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "robust"), (1, "robust"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    docs.write.parquet(str(tmp_path / "in/a"))
    scored = scorer.scored_stream(spark, str(tmp_path / "in/*"))
    for _ in range(2):
        scorer.run(scored, str(tmp_path / "out"), str(tmp_path / "cp"), ["doc_id"]).awaitTermination(60)
    assert {(r.doc_id, r.tier1) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1), (2, 0)}
