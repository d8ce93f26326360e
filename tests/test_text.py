"""Worked values and hard cases of the text functions and scores."""

import pytest
from pyspark.sql import functions as F

from lexisift import lexicon
from lexisift.functions import text as T
from lexisift.operators import evals, mining, rewrite, scan, trials


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()[0]


C = None


@pytest.fixture(autouse=True)
def column(spark):
    """The tested column, which needs a session."""
    global C
    C = F.col("t")


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("don't stop", 2), ("''a''b'' c-d", 3), ("Größe don't l'été naïve 42 a_b", 6), (None, None)])
def test_word_count(spark, text, n):
    assert value(spark, T.word_count(C), text) == n


@pytest.mark.parametrize("hits,words,want", [(3, 100, 3.0), (1, 50, 2.0), (5, 0, 0.0)])
def test_density(spark, hits, words, want):
    assert value(spark, T.density(F.lit(hits), F.lit(words))) == want


def test_clean_text(spark):
    assert value(spark, T.clean_text(C), "a ```x\ny``` b\n> quoted\nc > d") == "a  b\n\nc > d"
    assert value(spark, T.clean_text(C), "a\r\n> q\r\nb") == "a\r\n\nb"


def test_paragraphs_and_sentences(spark):
    assert value(spark, T.paragraphs(C), "a\n \nb\n\n\n c ") == ["a", "b", "c"]
    assert value(spark, T.sentences(C), "One is. Two is! no? Äh. Three") == ["One is.", "Two is! no? Äh.", "Three"]
    assert value(spark, T.sentences(C), "") == []


def test_tokens_and_ngrams(spark):
    assert value(spark, T.tokens(C), "The, QUICK 42 x -- b-c ✅ „Ärger“") == ["the", "quick", "b-c", "ärger"]
    assert value(spark, T.ngrams(T.tokens(C), 2), "aa bb cc") == ["aa bb", "bb cc"]
    assert value(spark, T.ngrams(T.tokens(C), 3), "aa bb") == []


# One text that fires and one that doesn't, for rules with a catch.
CASES = [
    ("en", "em_dash_overuse", "a — b -- c --- d", 3), ("en", "em_dash_overuse", "w--x ---- y", 1), ("en", "boldface_overuse", "**a** **b\nc**", 1),
    ("en", "rule_of_three", "red, green, and blue", 1), ("en", "rule_of_three", "red and blue", 0), ("en", "transitional_cliche", "- Moreover, x\nso moreover, y", 1),
    ("en", "title_case_heading", "## The Big Plan\n## the big plan", 1), ("en", "not_just_X_its_Y", "Not just a plan, it's hope", 1),
    ("en", "trailing_emphasis_fragment", "It ended. Quiet win here.", 1), ("en", "puffery", "robustness is robust", 1), ("en", "curly_quotes", "“a”", 2),
    ("en", "emoji_bullet", "✅ x\n y ✅", 1), ("en", "placeholder_text", "[INSERT X] 2024-xx-xx", 2), ("en", "ultimately_starter", "Ultimately, x", 1),
    ("de", "de_filler", "An dieser Stelle", 1), ("de", "de_sycophancy", "Ja. Gerne! Natürlich!", 1), ("de", "de_ai_vocab", "ÜBERALL DARÜBER HINAUS", 1),
    ("de", "de_puffery", "robuste Robustheit", 1), ("de", "de_copula_avoidance", "stellt etwas dar", 1), ("de", "de_fake_candid_opener", "Mal ehrlich, ja", 1),
    ("en", "hedging", "Arguably, it is important to note this; it is important.", 2), ("en", "vague_attribution", "Experts say and studies suggest; experts eat", 2), ("en", "explainer_voice", "Let me explain. Lets dive into it. Let me eat.", 2),
    ("en", "summary_loop", "In conclusion, all in all, to wrap up. In all.", 3), ("en", "sycophantic_opener", "Great question! Yes.\nCertainly.\nNot certainly", 2), ("en", "aphorism_formula", "It becomes a trap. It is a trap.", 1),
    ("en", "chatbot_closer", "Want me to go on? Should I continue? Want me.", 2), ("en", "fake_candid_opener", "Look, it rains\n- Honestly? yes\nlooks, fine", 2), ("en", "vocabulary_tells", "A myriad of tapestry; navigate the landscape", 3),
    ("en", "ai_apology", "I apologize for the confusion. I apologize.", 1), ("en", "significance_inflation", "It stands as a testament to a pivotal role.", 2), ("en", "fake_ing_analysis", "They met, highlighting trust, and left", 1),
    ("en", "filler_phrases", "I hope this helps. Let me know if not. It's important to note", 3), ("en", "reference_markup_artifact", "turn0search1 utm_source=chatgpt.com", 2), ("en", "markdown_contamination", "```markdown\nHere's the revised version", 2),
    ("en", "fragmented_header", "# A head\n\nOne line restates it.\n\nMore", 1), ("en", "challenges_section", "## Challenges and Limits\n## Meals", 1),
    ("de", "de_aphorism_formula", "Es ist kein Werkzeug, sondern ein Spiegel und wird zur Falle", 2), ("de", "de_significance_inflation", "steht für eine wichtige Rolle", 2), ("de", "de_vague_attribution", "laut Experten, Quellen zufolge", 2),
    ("de", "de_signposting", "Schauen wir uns das an. Im Folgenden wird es klar.", 2), ("de", "de_sentence_opener_intensifier", "Letztendlich, ja.\n- Tatsächlich, nein.\nja, letztlich", 2), ("de", "de_quantity_vagueness", "eine Vielzahl von Dingen, zahlreiche, unzähligen", 3),
    ("de", "de_academic_frame", "im Rahmen der vorliegenden Studie", 1), ("de", "de_impersonal_reflexive", "es lässt sich sagen, es sagt", 1), ("de", "de_denglisch", "wir performen und pitchen die Customer Journey", 3),
    ("de", "de_chatbot_closer", "Soll ich fortfahren? Möchten Sie, dass ich schreibe?", 2), ("de", "em_dash_overuse", "a — b", 1), ("de", "boldface_overuse", "**a**", 1), ("de", "emoji_bullet", "✨ neu", 1),
]


@pytest.mark.parametrize("lang,key,text,n", CASES)
def test_rule(spark, lang, key, text, n):
    rule = next(r for r in lexicon.pack(lang) if r.key == key)
    assert value(spark, scan.hits_of(C, rule), text) == n


def test_unknown_pack():
    with pytest.raises(KeyError):
        lexicon.pack("xx")


def test_packs():
    assert len(lexicon.EN) == 29 and len(lexicon.DE) == 19
    assert {r.key for r in lexicon.EN} & {r.key for r in lexicon.DE} == set(lexicon.UNIVERSAL)
    assert all(k in {r.key for r in lexicon.EN} for x in lexicon.BRIDGE.values() for k in x.split())


@pytest.mark.parametrize("words,want", [(1000, 2), (50, 3)])
def test_threshold(spark, words, want):
    hits = F.create_map(*(x for r in lexicon.EN for x in (F.lit(r.key), F.lit({"boldface_overuse": 1, "puffery": 2}.get(r.key, 0)).cast("long"))))
    assert value(spark, scan.tier1(hits, F.lit(words))) == want


def test_score_of_hard_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "robust " * 20000)], "id int, text string")
    got = {r.id: r for r in scan.score(df, "text").collect()}
    assert (got[1].words, got[1].tier1, got[1].density, got[1].band) == (0, 0, 0.0, "LOW")
    assert got[4].words == got[4].tier1 == 20000 and got[4].band == "HIGH"
    assert scan.score(df.limit(0), "text").count() == 0


def test_rhythm_needs_three(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, "A b. C d. E f.")], "id int, text string")
    got = {r.id: r for r in scan.rhythm(df, "id", "text").collect()}
    assert got[1].verdict == "n/a" and got[1].cv is None and got[2].verdict == "METRONOMIC"


@pytest.mark.parametrize(
    "values,threshold,want",
    [
        ([0.02, 0.05, 0.08, 0.40, 0.50], 0.10, (True, 0.08, "3/5", True)), ([0.05, 0.06, 0.11, 0.12, 0.13], 0.10, (False, 0.11, "2/5", True)),
        ([0.02, 0.05, None, None, None], 0.10, (None, 0.035, "2/2", False)), ([0.10, 0.10, 0.10], 0.10, (True, 0.10, "3/3", False)), ([None, None], 0.1, (None, None, "0/0", False)),
    ],
)
def test_continuous_trials(spark, values, threshold, want):
    df = spark.createDataFrame([("c", v) for v in values], "id string, v double")
    r = trials.continuous(df, ["id"], "v", threshold, 5).first()
    assert (r.verdict, r.median, r.passed_fraction, r.flaky) == want


def test_binary_trials(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 0.0, 0.0)] + [("b", None)], "id string, v double")
    got = {r.id: r for r in trials.binary(df, ["id"], "v", 4).collect()}
    assert (got["a"].verdict, got["a"].fraction, got["a"].flaky) == (True, 0.5, True)
    assert got["b"].verdict is None and got["b"].fraction is None


def test_length_verdict(spark):
    for before, after, want in ((100, 40, "TRUNCATED"), (100, 85, "SHORTENED"), (100, 95, "OK"), (100, 120, "EXPANDED"), (0, 5, "OK")):
        assert value(spark, rewrite.length_verdict(rewrite.length_change(F.lit(before), F.lit(after)))) == want


def test_guard(spark):
    assert value(spark, rewrite.guarded_edit_ratio(C, F.concat(C, F.lit("\n\nNo changes."))), "abc") == 0.0
    assert value(spark, rewrite.guarded_edit_ratio(C, F.lit("abd")), "abc") == pytest.approx(1 / 3)
    assert value(spark, rewrite.edit_ratio(C, F.lit("abcdefgh")), "a") == 7.0


RESPONSES = [
    ("**Final rewrite:**\n> a\n> b\n**Changes made:** x", "a\nb"), ("**Rewrite:**\nab\n\n**x**", "ab"), ("note\n> q1\n\n> q2\n", "q2"), ("banner\n---\nrest", "rest"),
    ("plain", "plain"), ("Pre-flight: 0\nnothing", ""), ("**Final rewrite:**\ntext\n<!--REWRITE-AUDIT-->\nmore", "text"), ("", ""), (None, ""),
]


@pytest.mark.parametrize("raw,final", RESPONSES)
def test_parse_response(spark, raw, final):
    df = spark.createDataFrame([(raw,)], "r string")
    assert rewrite.parse_response(df, "r", "<!--REWRITE-AUDIT-->").first().final == final


@pytest.mark.parametrize("text,want", [("ok text", False), ("", True), ("a -> b\nc → d", True), ("#7 x\npattern 8 y", True), ("Änderungen: z", True), ("**Wesentliche Änderungen:**", True), ("wurde entfernt", False)])
def test_change_log(spark, text, want):
    assert value(spark, rewrite.is_change_log(C), text) == want


def test_commentary(spark):
    df = spark.createDataFrame([("x body tail", "body"), ("x body", "body"), ("x", "zz"), ("raw", "")], "r string, f string")
    assert [r[0] for r in df.select(rewrite.has_commentary(F.col("r"), F.col("f"))).collect()] == [True, False, False, True]


def test_mining(spark):
    rows = [(True, "in der tat gut"), (True, "in der tat neu"), (True, "in der tat"), (False, "nur anders hier"), (None, "in der tat"), (True, None)]
    df = spark.createDataFrame(rows, "ai boolean, t string")
    got = mining.mine(df, "t", F.col("ai"), min_n=2, max_n=3, min_count=3).collect()
    assert [(r.ngram, r.ai_count, r.human_count) for r in got] == [("der tat", 3, 0), ("in der", 3, 0), ("in der tat", 3, 0)]
    assert mining.mine(df.limit(0), "t", F.col("ai")).count() == 0


def test_balanced_ratio(spark):
    assert abs(value(spark, mining.llr(F.lit(10), F.lit(10), F.lit(1000), F.lit(1000)))) < 1
    assert value(spark, mining.llr(F.lit(0), F.lit(10), F.lit(1000), F.lit(1000))) == 0.0


def test_plan_and_resume(spark):
    plan = evals.plan_grid(spark, d=["a", "b"], m=["x", "y", "z"])
    done = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z")], "d string, m string")
    assert plan.count() == 6 and evals.pending(plan, done, ["d", "m"]).count() == 4 and evals.reused(plan, done, ["d", "m"]).count() == 2


def test_wilson(spark):
    df = spark.createDataFrame([("a", True)] * 20 + [("b", False)], "g string, ok boolean")
    got = {r.g: r for r in evals.rate_with_interval(df, "g", F.col("ok")).collect()}
    assert (got["a"].low, got["a"].high) == (0.8389, 1.0) and got["b"].low == 0.0


def test_html_and_markup(spark):
    html = "<nav><p>one two three four five six seven eight</p></nav><P>a b c d e f &amp; <b>g</b></P><p>short</p>"
    assert value(spark, T.html_paragraphs(C), html) == "a b c d e f & g"
    assert value(spark, T.strip_wikitext(C), "{{a|{{b}}}}'''x''' [[B|H]] [[R]]<ref>q</ref>\n== h ==\n") == "x B H R"
    assert value(spark, T.markdown_plain(C), "# A\n`c` [l](u) ![i](v)") == "A l"
    assert value(spark, T.slug(F.lit("p"), C), "Ärger & Co. -- neu") == "p_ärger_co_--_neu"
    assert value(spark, T.yaml_scalar(C), 'a: "b"') == '"a: \\"b\\""'
    assert value(spark, T.sample_domain(C), "---\nmetadata:\n  domain: legal\n---\nBody") == "legal"
    assert value(spark, T.decode_base64(C), "w4RyZ2Vy\n") == "Ärger"
    assert value(spark, T.looks_german(C), "der die das und")


def test_edit_ratios_of_all_pairs_match_brute_force(spark, tmp_path):
    from lexisift.plans import queries

    rows = [("a", "Grüße an Jörg", "Gruß an Jörg"), ("b", "“One” – two", '"One" - two'), ("c", "plain", "plane"), ("d", "año", "año y más"), ("e", None, "x"), ("f", "x", None), ("g", "𝒳 y", "x y"), ("a", "Grüße an Jörg", "Gruß an Jörg")]
    spark.createDataFrame([(*r, "de", "career", "s") for r in rows], "id string, input string, reference_rewrite string, lang string, domain string, source string").write.parquet(str(tmp_path / "ai_career_01.parquet"))

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {k: 0.0 if b.startswith(a) and len(b) > len(a) else round(distance(a, b) / len(a), 4) for k, a, b in rows if a and b}
    assert {r.id: r.ratio for r in queries.edit_ratio(spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-4)
