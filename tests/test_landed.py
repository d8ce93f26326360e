"""Landed material, the registry and the files of a corpus."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from lexisift.sinks import reports
from lexisift.sources import landed

PROSE = "Das ist ein Text, der von der Stadt und den Leuten in der Stadt handelt, und er ist nicht kurz. "


def answers(spark, *items):
    return spark.createDataFrame([(json.dumps(x),) for x in items], "raw string")


def test_registry(spark):
    r = landed.registry(spark)
    assert r.count() == 24 and r.select("name").distinct().count() == 24
    totals = {x.license_class: (x[1], x[2]) for x in r.groupBy("license_class").agg(F.count("*"), F.sum("n")).collect()}
    assert totals == {"redistributable": (14, 81), "research_only": (10, 34)}
    assert landed.registry(spark, "research_only").count() == 10


def test_wiki_answers(spark):
    a = answers(spark, {"query": {"embeddedin": [{"title": "B"}, {"title": "A"}]}, "continue": {"eicontinue": "x"}}, {"query": {"embeddedin": [{"title": "A"}]}}, {"error": 1})
    assert [r.title for r in landed.wiki_titles(a, "raw", "embeddedin").collect()] == ["A", "B"] and landed.wiki_titles(a, "raw").count() == 0
    p = answers(spark, {"query": {"pages": {"1": {"title": "A", "revisions": [{"timestamp": "2021", "*": "x"}, {"timestamp": "2020", "content": "y"}]}, "-1": {"title": "B"}}}})
    assert {(r.title, r.timestamp, r.text) for r in landed.wiki_revisions(p, "raw").collect()} == {("A", "2021", "x"), ("A", "2020", "y")}
    assert spark.range(1).select(landed.wiki_url(F.lit("Rom am See/ä"), "https://w.example/")).first()[0] == "https://w.example/wiki/Rom_am_See/%C3%A4"


def test_other_answers(spark):
    docs = answers(spark, {"documents": [{"titel": "T", "text": "x", "fundstelle": {"pdf_url": "u"}}, {"title": "S", "inhalt": "y", "downloadUrl": "v"}, {"text": "z"}]}, {"items": [{"title": "I"}]})
    assert {tuple(r) for r in landed.parliament(docs, "raw", "api").collect()} == {("T", "u", "T\n\nx"), ("S", "v", "S\n\ny"), ("", "api", "z"), ("I", "api", "I")}
    users = answers(spark, {"items": [{"user_id": 7, "about_me": "<p>Hi</p>"}, {"user_id": 8, "about_me": ""}]})
    assert [tuple(r) for r in landed.profiles(users, "raw", "https://s.example").collect()] == [("7", "https://s.example/users/7", "<p>Hi</p>")]
    p = answers(spark, {"data": {"children": [{"data": {"id": "a", "title": "T", "selftext": "x", "url": "u"}}, {"data": {"id": "b", "title": "only"}}]}})
    assert {(r.title, r.raw) for r in landed.posts(p, "raw").collect()} == {("a", "T. x"), ("b", "only")}
    r = answers(spark, {"content": base64.encodebytes("Grüße".encode()).decode(), "encoding": "base64"}, {"content": "plain"}, {"content": None})
    assert {x.text for x in landed.readme(r, "raw").collect()} == {"Grüße", "plain"}


def test_collected(spark):
    rows = [("reddit_de_casual", f"t{i}", "u", PROSE * 20) for i in range(9)] + [("reddit_de_casual", "short", "u", "kurz"), ("reddit_de_casual", "english", "u", "some words " * 80), ("reddit_de_casual", "t1", "v", PROSE * 20), ("reddit_de_casual", "null", "u", None)]
    rows += [("apple_marketing", "h", "u", "<p>" + PROSE * 30 + "</p><nav><p>" + PROSE * 9 + "</p></nav>"), ("unknown", "x", "u", PROSE * 99)]
    got = landed.collected(spark.createDataFrame(rows, "name string, title string, source_url string, raw string"), landed.registry(spark), "2026-01-01").collect()
    per = {n: [r for r in got if r.metadata["source"] == n] for n in ("reddit_de_casual", "apple_marketing")}
    assert len(per["reddit_de_casual"]) == 5 and len(per["apple_marketing"]) == 1 and len(got) == 6
    assert all(len(r.text.split()) == 200 for r in per["reddit_de_casual"]) and len(per["apple_marketing"][0].text.split()) == 250
    assert per["apple_marketing"][0].source == "apple_marketing" and per["reddit_de_casual"][0].source == "reddit_casual" and got[0].fetch_date == "2026-01-01"
    few = landed.registry(spark).filter("name = 'reddit_de_casual'").withColumn("n", F.lit(1))
    many = spark.createDataFrame([("reddit_de_casual", f"t{i}", "u", PROSE * 20) for i in range(60)], "name string, title string, source_url string, raw string")
    once, again = (landed.collected(many, few, "d", seed=7, oversample=True).collect() for _ in range(2))
    assert len(once) == 1 and once == again


def test_inputs_and_names(spark, tmp_path, monkeypatch):
    assert {tuple(r) for r in landed.literal_inputs(spark, {"a": {"text": "x"}, "b": {"text": "y", "lang": "de", "domain": "legal"}}).collect()} == {("a", "x", "en", "casual"), ("b", "y", "de", "legal")}
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert landed.single_text(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    monkeypatch.setenv("SAMPLES", str(tmp_path))
    assert landed.personal_samples(spark, "SAMPLES", ".none").first().body == "one\ntwo"
    monkeypatch.setenv("SAMPLES", "")
    monkeypatch.chdir(tmp_path)
    with pytest.raises(FileNotFoundError):
        landed.personal_samples(spark, "SAMPLES", ".none-of-these")
    key = lambda p: spark.range(1).select(landed.result_key(F.lit(p), "/base")).first()[0]
    assert key("/base/open/x/a.b.md") == "open_x_a.b" and key("c.md") == "c"
    assert landed.listed("a, b", ("a", "b", "c")) == ["a", "b"] and landed.listed("all", ("a", "b")) == ["a", "b"]
    with pytest.raises(ValueError):
        landed.listed("x", ("a",))
    assert [r[0] for r in spark.createDataFrame([("s",), ("t",)], "m string").select(landed.short_names(F.col("m"), {"s": "long-s"})).collect()] == ["long-s", "t"]


def test_corpus_files(spark, tmp_path):
    rows = [("1", "http://x", "PD", "open", "2024-01-01", {"domain": "legal"}, "Text", "s1"), ("2", "http://y", "copyright", "research_only", None, None, "More", "s2"), ("3", "http://z", "PD", "open", "2024-01-01", None, None, "s1")]
    docs = spark.createDataFrame(rows, "id string, source_url string, license string, license_class string, fetch_date string, metadata map<string,string>, text string, source string")
    for _ in range(2):
        assert reports.write_files(reports.corpus_files(docs), str(tmp_path)) == 7
    assert (tmp_path / "open/s1/1.md").read_text().endswith("---\n\nText\n") and (tmp_path / "open/s1/_SOURCE").read_text().splitlines()[4] == "doc_count: 2"
    assert "No-redistribution" in (tmp_path / "research_only/s2/_LICENSE").read_text() and "No-redistribution" not in (tmp_path / "open/s1/_LICENSE").read_text()


def test_texts_of_scores(spark, tmp_path):
    df = spark.createDataFrame([(1, "A robust plan. It is robust and it works.\n\nשלום עולם — **טוב**", "A plan. It works — well."), (2, None, None)], "id int, text string, after string")
    got = {r.id: r.report.splitlines() for r in reports.score_texts(df, "id", "text").collect()}
    assert "    - puffery: 2" in got[1] and got[1][-2].startswith("P 1    9w   2 hits") and got[1][-1].endswith("[Hebrew]") and "Words:           0" in got[2]
    c = {r.id: r.report.splitlines() for r in reports.compare_texts(df, "id", "text", "after").collect()}
    assert "    - puffery: -2" in c[1] and any("removed" in x for x in c[1]) and "(No new tells.)" in c[2]
    assert "cases:" in reports.audit_text({"cases": 3}, "AUDIT", ["- x"])
    audited = reports.sample_audit(spark.createDataFrame([(1, "---\na: b\n---\nrobust robust"), (2, "fine words here")], "id int, text string"), "id", "text")
    assert {(r.id, r.band, r.top) for r in audited.collect()} == {(1, "HIGH", "puffery: 2"), (2, "LOW", "")}
    cases = spark.createDataFrame([(7, "n", "en", [("pattern_007_en_01", "x")])], "pattern_id int, pattern_name string, lang string, cases array<struct<id:string, input:string>>")
    assert reports.write_cases(cases, str(tmp_path)) == 1 and json.loads((tmp_path / "pattern_007.json").read_text())["cases"][0]["input"] == "x"
