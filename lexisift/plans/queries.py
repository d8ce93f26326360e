"""Queries over the test tables, each with its SQL where another engine can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.lexicon import BRIDGE, DIMENSIONS, EN, PACKS, any_of, levels, modes, pack, rules
from lexisift.operators import evals, external, mining, rewrite, scan, summaries, trials
from lexisift.plans import sqlgen as g
from lexisift.session import balanced, table
from lexisift.sinks import reports
from lexisift.sources import corpus, landed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Fixed test phrases, one or more for each rule; every document gets one appended, chosen by its id.
SEEDS = {
    "en": [
        "It should be noted that arguably some might say so.", "Experts say that studies show a lot.", "Moreover, we left.\nIndeed , we did.", "This is not just a plan, it's a promise, and not only a plan but also a map.",
        "Let me explain. Let's unpack the box.", "In conclusion, overall we won.", "Great question! Certainly we can.", "The map is not a tool but a mirror.", "Want me to go on? Should I continue?",
        "Look, it rains.\nHonestly? Yes.", "A robust, seamless and cutting-edge paradigm.", "A myriad of paths to navigate the complex landscape.", "I apologize for the confusion.", "It stands as a testament to a pivotal role.",
        "They met, highlighting trust, and left, creating value.", "Ultimately, it held.", "I hope this helps. Please let me know if not.", "One — two -- three --- four – five word-- six----", "**Bold** and **bolder** words", "✅ done\n🚀 up\n- ✅ no",
        "Red, green, and blue; up, down and out.", "“Quoted” and ‘so’", "## The Great Big Plan\n\nNext", "[INSERT NAME] on 2024-xx-xx with ___ and XXXX", "see turn0search1 and [web:12] via utm_source=chatgpt.com", "```markdown\nHere's the revised version",
        "It ended. A quiet win.\n", "# A head\n\nOne line restates it.\n\nMore", "## Challenges and Limits\nDespite its challenges the town continues to thrive.", "> Moreover, this is quoted.\n```\nrobust code\n```\nplain",
    ],
    "de": [
        "Das ist kein Werkzeug, sondern ein Spiegel. Es wird zur Falle.", "Er steht für Mut und spielt eine wichtige Rolle.", "Laut Experten, Quellen zufolge.", "Ein robustes, nahtloser und lebendig gemachtes Haus.", "Darüber hinaus ganzheitlich und maßgeblicher.",
        "Es gilt als groß, stellt etwas dar.", "Nun gut. Gerne! Das ist eine gute Frage", "Ich hoffe das hilft. An dieser Stelle Schluss.", "Schauen wir uns das an. Im Folgenden wird es klar.", "Letztendlich, ja.\n- Tatsächlich, nein.", "Eine Vielzahl von Dingen, zahlreiche, unzähligen.",
        "im Rahmen der vorliegenden Studie", "Es lässt sich sagen, dass es geht.", "Wir performen und pitchen die Customer Journey.", "Soll ich fortfahren? Möchten Sie, dass ich schreibe?", "Mal ehrlich, nein.\nGanz ehrlich? Ja.", "**Fett** — und ✅", "✨ neu",
    ],
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents; dealt out to all cores where they lie in fewer splits than there are."""
    return balanced(table(spark, d, "documents"))


def seeded(df: DataFrame, lang: str) -> DataFrame:
    phrases = SEEDS[lang]
    pick = F.element_at(F.array(*map(F.lit, phrases)), (F.pmod("doc_id", F.lit(len(phrases))) + 1).cast("int"))
    return df.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), pick))


def seeded_sql(lang: str) -> str:
    return f"(SELECT * REPLACE (concat(coalesce(text, ''), {g.q(chr(10) * 2)}, [{', '.join(map(g.q, SEEDS[lang]))}][CAST(doc_id % {len(SEEDS[lang])} AS INT) + 1]) AS text) FROM documents)"


# --- scoring -----------------------------------------------------------------------------------


def _density(source: str, lang: str) -> str:
    return f"SELECT doc_id, words, tier1, round(d, 2) AS density, {g.band('d')} AS band FROM ({g.scored(source, 'doc_id', 'text', lang)})"


@query("doc_density", _density("documents", "en"))
def doc_density(spark: SparkSession, d: str) -> DataFrame:
    return scan.score(docs(spark, d), "text").select("doc_id", "words", "tier1", "density", "band")


@query("doc_density_seeded", _density(seeded_sql("en"), "en"))
def doc_density_seeded(spark: SparkSession, d: str) -> DataFrame:
    return scan.score(seeded(docs(spark, d), "en"), "text").select("doc_id", "words", "tier1", "density", "band")


@query("doc_density_de", _density(seeded_sql("de"), "de"))
def doc_density_de(spark: SparkSession, d: str) -> DataFrame:
    return scan.score(seeded(docs(spark, d), "de"), "text", "de").select("doc_id", "words", "tier1", "density", "band")


@query("density_band_counts", f"SELECT lang, origin, band, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, {g.band('d')} AS band FROM ({g.scored('documents', 'doc_id', 'text', 'en', ', lang, origin')})) GROUP BY ALL")
def density_band_counts(spark: SparkSession, d: str) -> DataFrame:
    return scan.score(docs(spark, d), "text").groupBy("lang", "origin", "band").agg(F.count(F.lit(1)).alias("n"))


for _lang in PACKS:

    @query(f"rule_hits_{_lang}", f"SELECT * FROM ({g.long_hits(f'({g.scored(seeded_sql(_lang), 'doc_id', 'text', _lang)})', 'doc_id', _lang)}) WHERE hits > 0")
    def rule_hits(spark: SparkSession, d: str, lang: str = _lang) -> DataFrame:
        return scan.rule_hits(seeded(docs(spark, d), lang), "doc_id", "text", lang)


@query("rule_totals", f"SELECT rule, CAST(sum(hits) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS docs FROM ({g.long_hits(f'({g.scored('documents', 'doc_id', 'text', 'en')})', 'doc_id', 'en')}) WHERE hits > 0 GROUP BY rule")
def rule_totals(spark: SparkSession, d: str) -> DataFrame:
    return scan.rule_hits(docs(spark, d), "doc_id", "text").groupBy("rule").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("docs"))


_HEBREW = f"(CASE WHEN {g.count('p', r'\p{L}')} > 0 THEN CAST({g.count('p', r'[\x{590}-\x{5FF}]')} AS DOUBLE) / {g.count('p', r'\p{L}')} ELSE 0.0 END)"
_FORM = ", ".join(f"{g.q(r.key)}: " + (g.hits("p", r) if r.key in ("em_dash_overuse", "boldface_overuse", "emoji_bullet") else f"CASE WHEN {_HEBREW} > 0.4 THEN 0 ELSE {g.hits('p', r)} END") for r in EN)
_MIXED = f"(SELECT * REPLACE (concat(text, {g.q(chr(10) * 2 + 'שלום עולם — **טוב** robust' + chr(10) + ' ' + chr(10) + 'End, stop.')}) AS text) FROM {seeded_sql('en')})"


@query(
    "paragraph_density",
    f"""WITH a AS (SELECT doc_id, {g.paragraphs(g.clean('text'))} AS ps FROM {_MIXED}), b AS (SELECT doc_id, generate_subscripts(ps, 1) AS paragraph, unnest(ps) AS p FROM a),
c AS (SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, {g.words('p')} AS words, {{{_FORM}}} AS h FROM b), e AS (SELECT *, {g.tier1('h', 'words', 'en')} AS tier1 FROM c)
SELECT doc_id, paragraph, words, tier1, round({g.density('tier1', 'words')}, 2) AS density, {g.band(g.density('tier1', 'words'))} AS band FROM e""",
)
def paragraph_density(spark: SparkSession, d: str) -> DataFrame:
    df = seeded(docs(spark, d), "en").withColumn("text", F.concat("text", F.lit("\n\nשלום עולם — **טוב** robust\n \nEnd, stop.")))
    return scan.paragraph_scores(df, "doc_id", "text")


_PARA = f"""WITH a AS (SELECT doc_id, {g.paragraphs(g.clean('text'))} AS ps FROM {_MIXED}), b AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) AS BIGINT) AS paragraph, unnest(ps) AS p FROM a), c AS (SELECT doc_id, paragraph, {{{_FORM}}} AS h FROM b)"""


@query("paragraph_hits", f"{_PARA} SELECT * FROM ({g.long_hits('c', 'doc_id, paragraph', 'en')}) WHERE hits > 0")
def paragraph_hits(spark: SparkSession, d: str) -> DataFrame:
    df = seeded(docs(spark, d), "en").withColumn("text", F.concat("text", F.lit("\n\nשלום עולם — **טוב** robust\n \nEnd, stop.")))
    return scan.paragraph_hits(df, "doc_id", "text")


_DIM = ", ".join(f"{{'dimension': {g.q(x)}, 'hits': CAST({' + '.join(f'h.{r.key}' for r in EN if r.dimension == x)} AS BIGINT)}}" for x in DIMENSIONS)


@query("dimension_rollup", f"SELECT doc_id, u.dimension AS dimension, u.hits AS hits, round({g.density('u.hits', 'words')}, 2) AS density FROM (SELECT doc_id, words, unnest([{_DIM}]) AS u FROM ({g.scored(seeded_sql('en'), 'doc_id', 'text', 'en')}))")
def dimension_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scan.dimension_scores(seeded(docs(spark, d), "en"), "doc_id", "text")


@query(
    "sentence_rhythm",
    f"""WITH a AS (SELECT doc_id, list_transform({g.sentences(g.clean('text'))}, lambda s: CAST({g.words('s')} AS DOUBLE)) AS x FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n, CASE WHEN len(x) >= 3 THEN list_avg(x) END AS m, CASE WHEN len(x) >= 3 THEN list_aggregate(x, 'stddev_samp') END AS s FROM a)
SELECT doc_id, n AS sentences, coalesce(round(m, 1), 0.0) AS mean, coalesce(round(s, 1), 0.0) AS stdev, round(s / m, 2) AS cv,
CASE WHEN n < 3 THEN 'n/a' WHEN s / m < 0.35 THEN 'METRONOMIC' WHEN s / m > 0.6 THEN 'VARIED' ELSE 'OK' END AS verdict FROM b""",
)
def sentence_rhythm(spark: SparkSession, d: str) -> DataFrame:
    return scan.rhythm(docs(spark, d), "doc_id", "text")


@query(
    "top_rules",
    f"""WITH l AS ({g.long_hits(f"({g.scored(seeded_sql('en'), 'doc_id', 'text', 'en')})", 'doc_id', 'en')}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rule) AS place FROM l WHERE hits > 0)
SELECT doc_id, CAST(place AS BIGINT) AS place, rule, hits FROM r WHERE place <= 5""",
)
def top_rules(spark: SparkSession, d: str) -> DataFrame:
    return scan.top_rules(seeded(docs(spark, d), "en"), "doc_id", "text")


@query("em_dash_hits", f"SELECT doc_id, {g.hits('text', next(r for r in EN if r.key == 'em_dash_overuse'))} AS hits FROM {seeded_sql('en')}")
def em_dash_hits(spark: SparkSession, d: str) -> DataFrame:
    return seeded(docs(spark, d), "en").select("doc_id", scan.hits_of(F.col("text"), next(r for r in EN if r.key == "em_dash_overuse")).alias("hits"))


@query("em_dash_literal", f"SELECT doc_id, {g.count('text', '—')} AS dashes FROM documents WHERE text IS NOT NULL")
def em_dash_literal(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", T.count(F.col("text"), "—").alias("dashes"))


@query("language", f"SELECT doc_id, CASE WHEN coalesce({g.german('text')}, FALSE) THEN 'de' ELSE 'en' END AS language FROM documents")
def language(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.language(F.col("text")).alias("language"))


# --- words, tokens, n-grams ----------------------------------------------------------------------


@query("word_counts", f"SELECT doc_id, {g.words('text')} AS words, CAST(len({g.spaced('text')}) AS BIGINT) AS pieces, CAST(len({g.paragraphs('text')}) AS BIGINT) AS paragraphs, CAST(len({g.sentences('text')}) AS BIGINT) AS sentences FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return docs(spark, d).filter("text is not null").select("doc_id", T.word_count(c).alias("words"), T.spaced_word_count(c).alias("pieces"), F.size(T.paragraphs(c)).cast("long").alias("paragraphs"), F.size(T.sentences(c)).cast("long").alias("sentences"))


@query("token_counts", f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({g.tokens('text')}) AS token FROM documents) GROUP BY token")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("top_tokens", f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({g.tokens('text')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(spark, d).orderBy(F.desc("n"), "token").limit(50)


_GRAMS = " UNION ALL ".join(f"SELECT {n} AS n, unnest({g.ngrams('t', n)}) AS ngram, a FROM t" for n in (1, 2, 3))


@query(
    "ngram_counts",
    f"WITH t AS (SELECT {g.tokens('text')} AS t, origin = 'ai' AS a FROM documents WHERE text IS NOT NULL AND origin IS NOT NULL), x AS ({_GRAMS}) SELECT ngram, n, CAST(count(*) FILTER (a) AS BIGINT) AS a, CAST(count(*) FILTER (NOT a) AS BIGINT) AS b FROM x GROUP BY ngram, n",
)
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    df = docs(spark, d).filter("text is not null and origin is not null")
    return mining.gram_counts(df, "text", F.col("origin") == "ai", 1, 3).select("ngram", "n", "a", "b")


_MINED = " UNION ALL ".join(f"SELECT {n} AS n, unnest({g.ngrams('t', n)}) AS ngram, a FROM t" for n in (2, 3, 4))


@query(
    "llr_top_ngrams",
    f"""WITH t AS (SELECT {g.tokens('text')} AS t, origin = 'ai' AS a FROM documents WHERE text IS NOT NULL AND origin IN ('ai', 'human')), x AS ({_MINED}),
s AS (SELECT CAST(sum(CASE WHEN a THEN len(t) ELSE 0 END) AS DOUBLE) AS ta, CAST(sum(CASE WHEN a THEN 0 ELSE len(t) END) AS DOUBLE) AS tb FROM t),
c AS (SELECT ngram, n, CAST(count(*) FILTER (a) AS BIGINT) AS a, CAST(count(*) FILTER (NOT a) AS BIGINT) AS b FROM x GROUP BY ngram, n HAVING count(*) FILTER (a) >= 3),
e AS (SELECT *, (a + b) * ta / (ta + tb) AS ea, (a + b) * tb / (ta + tb) AS eb FROM c, s),
f AS (SELECT ngram, n, a AS ai_count, b AS human_count, round(a / (ta / 1e6), 2) AS ai_freq_ppm, round(b / (tb / 1e6), 2) AS human_freq_ppm,
round((CASE WHEN a / ta >= b / tb THEN 1 ELSE -1 END) * 2.0 * (a * ln(a / ea) + CASE WHEN b = 0 THEN 0 ELSE b * ln(b / eb) END), 4) AS llr FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY llr DESC, ai_count DESC, n, ngram) AS rank FROM f)
SELECT ngram, n, ai_count, human_count, ai_freq_ppm, human_freq_ppm, llr, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 100""",
)
def llr_top_ngrams(spark: SparkSession, d: str) -> DataFrame:
    df = docs(spark, d).filter(F.col("origin").isin("ai", "human"))
    return mining.mine(df, "text", F.col("origin") == "ai", top_k=100, digits=4)


@query("german_predicate", f"SELECT doc_id, {g.german('text')} AS german FROM documents WHERE text IS NOT NULL")
def german_predicate(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", T.looks_german(F.col("text")).alias("german"))


@query("hebrew_share", f"SELECT doc_id, round({_HEBREW}, 4) AS share FROM (SELECT doc_id, concat(text, CASE WHEN doc_id % 2 = 0 THEN 'שלום עולם' ELSE '' END) AS p FROM documents WHERE text IS NOT NULL)")
def hebrew_share(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "שלום עולם").otherwise(""))
    return docs(spark, d).filter("text is not null").select("doc_id", F.round(T.hebrew_share(t), 4).alias("share"))


# --- rewrites ----------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return balanced(table(spark, d, "ai_career_01").filter("input is not null").distinct())


_PAIRS = "(SELECT DISTINCT * FROM ai_career_01 WHERE input IS NOT NULL)"


def _side(text: str, name: str) -> str:
    return f"SELECT id, words AS {name}_words, tier1 AS {name}_tier1, round(d, 2) AS {name}_density, h AS {name}_h FROM ({g.scored(_PAIRS, 'id', text, 'en')})"


_PCT = "(CASE WHEN before_words > 0 THEN CAST(after_words - before_words AS DOUBLE) / before_words * 100 ELSE 0.0 END)"


def _gain(a: str, b: str) -> str:
    return "CAST(" + " + ".join(f"greatest({a}_h.{r.key} - {b}_h.{r.key}, 0)" for r in EN) + " AS BIGINT)"


@query(
    "rewrite_diff",
    f"""WITH a AS ({_side('input', 'before')}), b AS ({_side('reference_rewrite', 'after')}), j AS (SELECT * FROM a JOIN b USING (id))
SELECT id, before_words, after_words, before_tier1, after_tier1, before_density, after_density, round({_PCT}, 1) AS length_pct,
CASE WHEN abs({_PCT}) <= 10 THEN 'OK' WHEN {_PCT} < -25 THEN 'TRUNCATED' WHEN {_PCT} < -10 THEN 'SHORTENED' ELSE 'EXPANDED' END AS length_verdict,
before_tier1 - after_tier1 AS tier1_removed, {_gain('before', 'after')} AS cleaned, {_gain('after', 'before')} AS introduced FROM j""",
)
def rewrite_diff(spark: SparkSession, d: str) -> DataFrame:
    df = rewrite.compare(pairs(spark, d).select("id", "input", "reference_rewrite"), "input", "reference_rewrite")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v)
    df = df.withColumn("cleaned", total("cleaned")).withColumn("introduced", total("introduced"))
    return df.drop("input", "reference_rewrite", "before_band", "after_band")


# The distance counts bytes there, so each sign of a pair becomes one byte first.
_BYTES = "coalesce(array_to_string(list_transform(string_split({}, ''), lambda c: chr(CAST(list_position(s, c) AS INT))), ''), '')"


@query(
    "edit_ratio",
    f"""WITH p AS (SELECT id, input, reference_rewrite, {g.strip('input')} AS a, {g.strip('reference_rewrite')} AS b, list_distinct(string_split(concat(input, reference_rewrite), '')) AS s FROM {_PAIRS} WHERE reference_rewrite IS NOT NULL)
SELECT id, round(CASE WHEN starts_with(b, a) AND length(b) > length(a) THEN 0.0 ELSE CAST(levenshtein({_BYTES.format('input')}, {_BYTES.format('reference_rewrite')}) AS DOUBLE) / greatest(length(input), 1) END, 4) AS ratio FROM p""",
)
def edit_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of all pairs with both texts, by code points."""
    both = pairs(spark, d).filter("reference_rewrite is not null")
    return both.select("id", F.round(rewrite.guarded_edit_ratio(F.col("input"), F.col("reference_rewrite")), 4).alias("ratio"))


_SIGNS = ["", "No text provided, sorry.", "**Changes made:** all", "a → b\nc -> d", "#7 x\nPattern 8 y", "Entfernt: z", "**Wesentliche Änderungen:** w"]


def _with_sign() -> str:
    return f"(SELECT id, concat(coalesce(reference_rewrite, ''), {g.q(chr(10))}, [{', '.join(map(g.q, _SIGNS))}][CAST(length(input) % {len(_SIGNS)} AS INT) + 1]) AS t FROM {_PAIRS})"


def _signs() -> tuple[str, str]:
    low = "lower(t)"
    refusal = f"{g.strip('t')} = '' OR " + " OR ".join(f"contains({low}, {g.q(p)})" for p in rewrite.STUBS)
    log = (
        f"{g.strip('t')} = '' OR regexp_matches(t, {g.q(g.re2(rewrite.CHANGE_HEADER, 'i'))}) OR {g.count('t', '→|->')} >= 2 OR {g.count('t', g.re2(rewrite.RULE_LINE, 'im'))} >= 2"
        f" OR regexp_matches(t, {g.q(g.re2(rewrite.CHANGE_LINE, 'im'))}) OR regexp_matches(t, {g.q(g.re2(rewrite.CHANGE_BOLD, 'i'))})"
    )
    return refusal, log


@query("response_flags", f"SELECT id, ({_signs()[0]}) AS refusal, ({_signs()[1]}) AS change_log FROM {_with_sign()}")
def response_flags(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, _SIGNS)), (F.length("input") % len(_SIGNS) + 1).cast("int"))
    df = pairs(spark, d).select("id", F.concat(F.coalesce("reference_rewrite", F.lit("")), F.lit("\n"), sign).alias("t"))
    return df.select("id", rewrite.is_refusal(F.col("t")).alias("refusal"), rewrite.is_change_log(F.col("t")).alias("change_log"))


_FENCE = "<!--REWRITE-AUDIT-->"
_WRAP = ["Treating this as **Career** writing\nPre-flight: 0 Tier-1 tells, quick\n\n**Draft rewrite:**\n", "\n**Final rewrite:**\n> ", "\n**Changes made:** none"]


@query("response_parse", f"SELECT id, 'career' AS domain, 'Pre-flight: 0 Tier-1 tells, quick' AS preflight, line AS draft, line AS final, TRUE AS quick FROM (SELECT id, {g.strip(g.sub('input', f'{g.S}+', ' '))} AS line FROM {_PAIRS})")
def response_parse(spark: SparkSession, d: str) -> DataFrame:
    line = T.strip(F.regexp_replace("input", T.SPACES, " "))
    raw = F.concat(F.lit(_WRAP[0]), line, F.lit(_WRAP[1]), line, F.lit(_WRAP[2]))
    df = rewrite.parse_response(pairs(spark, d).select("id", raw.alias("raw")), "raw", _FENCE)
    return df.select("id", "domain", "preflight", "draft", "final", rewrite.quick_drop(F.col("preflight")).alias("quick"))


@query("response_fallbacks")
def response_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Every branch of the response parser over whole rewrites, with commentary and fence flags."""
    forms = F.array(F.concat(F.lit("**Rewrite:**\n"), "input"), F.concat(F.lit("x\n> "), "input"), F.concat(F.lit("a\n---\n"), "input"), F.col("input"), F.concat("input", F.lit(f"\n{_FENCE}\nnote that follows")))
    df = rewrite.parse_response(pairs(spark, d).select("id", F.posexplode(forms).alias("form", "raw")), "raw", _FENCE)
    return df.select("id", "form", "final", rewrite.is_fenced(F.col("raw"), _FENCE).alias("fenced"), rewrite.has_commentary(F.col("raw"), F.col("final")).alias("commentary"))


@query(
    "length_ratio",
    f"""SELECT id, round(CASE WHEN a > 0 THEN CAST(b AS DOUBLE) / a END, 4) AS ratio, CASE WHEN a > 0 THEN CAST(b AS DOUBLE) / a BETWEEN 0.7 AND 0.9 END AS on_target, p = r AS same_paragraphs
FROM (SELECT id, {g.words('input')} AS a, {g.words('reference_rewrite')} AS b, len({g.paragraphs('input')}) AS p, len({g.paragraphs('reference_rewrite')}) AS r FROM {_PAIRS} WHERE reference_rewrite IS NOT NULL)""",
)
def length_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("input"), F.col("reference_rewrite")
    df = pairs(spark, d).filter("reference_rewrite is not null").select("id", T.word_count(a).alias("a"), T.word_count(b).alias("b"), (F.size(T.paragraphs(a)) == F.size(T.paragraphs(b))).alias("same_paragraphs"))
    ratio = F.when(F.col("a") > 0, F.col("b") / F.col("a"))
    return df.select("id", F.round(ratio, 4).alias("ratio"), ratio.between(0.7, 0.9).alias("on_target"), "same_paragraphs")


_NUM = "list_distinct(regexp_extract_all({}, '[0-9]+(?:[.,][0-9]+)*'))"


@query("numbers_preserved", f"SELECT id, len(list_filter({_NUM.format('input')}, lambda x: NOT list_contains({_NUM.format('reference_rewrite')}, x))) = 0 AS preserved FROM {_PAIRS} WHERE reference_rewrite IS NOT NULL")
def numbers_preserved(spark: SparkSession, d: str) -> DataFrame:
    lost = F.array_except(T.numbers(F.col("input")), T.numbers(F.col("reference_rewrite")))
    return pairs(spark, d).filter("reference_rewrite is not null").select("id", (F.size(lost) == 0).alias("preserved"))


# --- cases, runs, reports ------------------------------------------------------------------------


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cases with a rewrite that makes curly quotation marks straight."""
    df = evals.flat_cases(table(spark, d, "pattern_019")).drop("pattern_name").dropDuplicates(["pattern_id", "id"])
    return df.withColumn("output", F.translate("input", "“”", '""'))


_CASES = """(SELECT pattern_id, id, any_value(c) AS c FROM (SELECT pattern_id, c.id AS id, c FROM (SELECT pattern_id, unnest(cases) AS c FROM pattern_019)) GROUP BY pattern_id, id)"""
_THERE = "list_filter(coalesce(c.expected_changes, []), lambda t: contains(lower(coalesce(c.input, '')), lower(t)))"
_STATUS = f"CASE WHEN coalesce(c.true_negative, FALSE) THEN 'true_negative' WHEN len(coalesce(c.expected_changes, [])) = 0 THEN 'unscorable_empty' WHEN len({_THERE}) = 0 THEN 'unscorable_no_trigger' ELSE 'scorable' END"
_KEPT = f"len(list_filter({_THERE}, lambda t: contains(lower(translate(c.input, '“”', '\"\"')), lower(t))))"
_REMOVAL = f"SELECT pattern_id, id, {_STATUS} AS status, CAST(len({_THERE}) AS BIGINT) AS terms_present, CAST(len({_THERE}) - coalesce({_KEPT}, 0) AS BIGINT) AS terms_removed, {_STATUS} = 'scorable' AND coalesce({_KEPT}, 0) = 0 AS detected FROM {_CASES}"


@query("term_removal", _REMOVAL)
def term_removal(spark: SparkSession, d: str) -> DataFrame:
    return evals.term_removal(cases(spark, d), "output").select("pattern_id", "id", "status", "terms_present", "terms_removed", "detected")


@query(
    "pattern_report",
    f"""WITH r AS ({_REMOVAL}), a AS (SELECT pattern_id, count(*) AS cases, count(*) FILTER (status = 'scorable') AS scorable, count(*) FILTER (status = 'scorable' AND detected) AS detected,
count(*) FILTER (status = 'true_negative') AS true_negatives, count(*) FILTER (starts_with(status, 'unscorable')) AS unscorable, sum(terms_present) FILTER (status = 'scorable') AS p, sum(terms_removed) FILTER (status = 'scorable') AS q FROM r GROUP BY 1)
SELECT pattern_id, cases, scorable, detected, true_negatives, unscorable, CASE WHEN scorable > 0 THEN round(detected / CAST(scorable AS DOUBLE), 4) END AS rate,
CASE WHEN p > 0 THEN round(q / CAST(p AS DOUBLE), 4) END AS term_rate, coalesce(scorable > 0 AND detected / CAST(scorable AS DOUBLE) < 0.85, FALSE) AS below FROM a""",
)
def pattern_report(spark: SparkSession, d: str) -> DataFrame:
    return evals.pattern_report(evals.term_removal(cases(spark, d), "output"))


def pattern_runs(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """``n`` runs of each case: some leave the text as it is, some fail."""
    turn = (F.length("input") + F.col("run_idx")) % 3
    df = cases(spark, d).withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    df = evals.term_removal(df.withColumn("output", F.when(turn == 0, F.col("input")).otherwise(F.col("output"))), "output")
    failed = (F.length("input") + 2 * F.col("run_idx")) % 4 == 0
    df = df.withColumn("detected", F.when(~failed, F.col("detected"))).withColumn("ratio", F.when(~failed, F.col("run_idx") * 0.05))
    return df.select("pattern_id", "id", "run_idx", "status", "detected", "ratio", "terms_present", "terms_removed")


_OUT = "CASE WHEN (length(c.input) + run_idx) % 3 = 0 THEN c.input ELSE translate(c.input, '“”', '\"\"') END"
_LEFT = f"len(list_filter({_THERE}, lambda t: contains(lower({_OUT}), lower(t))))"
_FAIL = "coalesce((length(c.input) + 2 * run_idx) % 4 = 0, FALSE)"
_VERDICTS = f"""WITH r AS (SELECT pattern_id, id, run_idx, {_STATUS} AS status, len({_THERE}) AS there, len({_THERE}) - coalesce({_LEFT}, 0) AS gone, {_STATUS} = 'scorable' AND coalesce({_LEFT}, 0) = 0 AS hit, {_FAIL} OR c.input IS NULL AS failed FROM {_CASES}, (SELECT unnest(range(0, 5)) AS run_idx)),
v AS (SELECT *, CASE WHEN NOT failed THEN CASE status WHEN 'scorable' THEN CAST(hit AS INT) WHEN 'true_negative' THEN CAST(run_idx * 0.05 <= 0.10 AS INT) END END AS value FROM r),
a AS (SELECT pattern_id, id, status, count(value) AS n_success, count(*) - count(value) AS n_fail, count(*) FILTER (value = 1) AS k, round(median(CAST(run_idx * 0.05 AS DOUBLE)) FILTER (NOT failed AND status = 'true_negative'), 4) AS median_ratio,
CAST(coalesce(round_even(median(there) FILTER (value IS NOT NULL AND status = 'scorable'), 0), 0) AS BIGINT) AS terms_present, CAST(coalesce(round_even(median(gone) FILTER (value IS NOT NULL AND status = 'scorable'), 0), 0) AS BIGINT) AS terms_removed FROM v GROUP BY 1, 2, 3),
i AS (SELECT *, status IN ('scorable', 'true_negative') AND n_success < 3 AS inconclusive FROM a),
cv AS (SELECT *, CASE WHEN status IN ('scorable', 'true_negative') AND NOT inconclusive THEN n_success > 0 AND CASE status WHEN 'true_negative' THEN median_ratio <= 0.10 ELSE k >= ceil(n_success / 2.0) END END AS verdict,
CASE WHEN status IN ('scorable', 'true_negative') AND n_success > 0 THEN round(k / CAST(n_success AS DOUBLE), 4) END AS fraction, status IN ('scorable', 'true_negative') AND NOT inconclusive AND k > 0 AND k < n_success AS flaky FROM i)"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    runs = pattern_runs(spark, d).withColumn("detected", F.when(F.col("ratio").isNotNull(), F.col("detected")))
    return summaries.case_verdicts(runs, ["pattern_id", "id"], 5)


@query("case_verdicts", f"{_VERDICTS} SELECT pattern_id, id, status, n_success, n_fail, k, median_ratio, terms_present, terms_removed, inconclusive, verdict, fraction, flaky FROM cv")
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d)


_SURE = "NOT inconclusive AND status = "


@query(
    "pattern_details",
    f"""{_VERDICTS}, p AS (SELECT pattern_id, count(*) FILTER ({_SURE}'scorable' AND verdict) AS detected, count(*) FILTER ({_SURE}'scorable') AS total, count(*) FILTER (starts_with(status, 'unscorable')) AS unscorable, count(*) FILTER ({_SURE}'true_negative') AS true_negatives,
count(*) FILTER ({_SURE}'true_negative' AND verdict) AS true_negative_passes, count(*) FILTER (inconclusive) AS inconclusive, count(*) FILTER (flaky) AS flaky FROM cv GROUP BY 1)
SELECT *, CASE WHEN total > 0 THEN round(detected / CAST(total AS DOUBLE), 3) ELSE 0.0 END AS rate, total > 0 AND detected / CAST(total AS DOUBLE) < 0.85 AS below FROM p""",
)
def pattern_details(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pattern_details(verdicts(spark, d))


@query("pattern_marks", f"{_VERDICTS} SELECT pattern_id, id, unnest(list_filter([CASE WHEN {_SURE}'scorable' AND NOT coalesce(verdict, FALSE) THEN 'miss' END, CASE WHEN {_SURE}'true_negative' AND NOT coalesce(verdict, FALSE) THEN 'true_negative_failure' END, CASE WHEN inconclusive THEN 'inconclusive' END, CASE WHEN flaky THEN 'flaky' END], lambda x: x IS NOT NULL)) AS mark FROM cv")
def pattern_marks(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pattern_marks(verdicts(spark, d), ["pattern_id", "id"])


@query(
    "pattern_summary",
    f"""{_VERDICTS}, s AS (SELECT count(*) AS cases, count(*) FILTER ({_SURE}'scorable') AS scored, count(*) FILTER ({_SURE}'scorable' AND verdict) AS detected, count(*) FILTER (starts_with(status, 'unscorable')) AS unscorable, count(*) FILTER (inconclusive) AS inconclusive, count(*) FILTER (flaky) AS flaky,
coalesce(round(avg(fraction) FILTER ({_SURE}'scorable'), 3), 0.0) AS mean_fraction, CAST(coalesce(sum(terms_present) FILTER ({_SURE}'scorable'), 0) AS BIGINT) AS terms_present, CAST(coalesce(sum(terms_removed) FILTER ({_SURE}'scorable'), 0) AS BIGINT) AS terms_removed FROM cv)
SELECT *, CASE WHEN scored > 0 THEN round(detected / CAST(scored AS DOUBLE), 3) ELSE 0.0 END AS detection_rate, CASE WHEN terms_present > 0 THEN round(terms_removed / CAST(terms_present AS DOUBLE), 3) ELSE 0.0 END AS term_rate, inconclusive = 0 AS complete FROM s""",
)
def pattern_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.pattern_summary(verdicts(spark, d))


@query("case_previews", f"SELECT pattern_id, id, substring(lower(coalesce(c.input, '')), 1, 200) AS preview, CAST(len({g.spaced("coalesce(c.input, '')")}) AS BIGINT) AS pieces FROM {_CASES} WHERE coalesce(c.domain, '') IN ('career', 'legal', '')")
def case_previews(spark: SparkSession, d: str) -> DataFrame:
    df = evals.selected(cases(spark, d), domain=["career", "legal", ""], pattern_id=None)
    return evals.previewed(df, "input").select("pattern_id", "id", "preview", "pieces")


_RUNS = "(SELECT DISTINCT * FROM runs)"
_LAST = f"(SELECT case_id, run_idx, arg_max(value, loaded_at) FILTER (loaded_at IS NOT NULL) AS value FROM (SELECT case_id, run_idx, coalesce(value, -1) AS value, loaded_at FROM {_RUNS}) GROUP BY 1, 2)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").distinct()


_TRIAL = "count(value) AS n_success, count(*) - count(value) AS n_fail"


@query(
    "trials_continuous",
    f"""WITH a AS (SELECT case_id, {_TRIAL}, count(*) FILTER (value <= 0.5) AS k, CAST(round(CAST(median(value) AS DECIMAL(20, 9)), 4) AS DOUBLE) AS median, min(value) AS lo, max(value) AS hi FROM {_RUNS} GROUP BY 1), b AS (SELECT *, n_success < 3 AS inconclusive FROM a)
SELECT case_id, n_success, n_fail, k, inconclusive, concat(k, '/', n_success) AS passed_fraction, median, CASE WHEN NOT inconclusive THEN median <= 0.5 END AS verdict, NOT inconclusive AND coalesce(lo <= 0.5 AND hi > 0.5, FALSE) AS flaky FROM b""",
)
def trials_continuous(spark: SparkSession, d: str) -> DataFrame:
    return trials.continuous(runs(spark, d), ["case_id"], "value", 0.5, 5)


@query(
    "trials_binary",
    f"""WITH r AS (SELECT case_id, CASE WHEN value IS NOT NULL THEN CASE WHEN value <= 0.5 THEN 1 ELSE 0 END END AS value FROM {_RUNS}), a AS (SELECT case_id, {_TRIAL}, count(*) FILTER (value = 1) AS k FROM r GROUP BY 1), b AS (SELECT *, n_success < 3 AS inconclusive FROM a)
SELECT case_id, n_success, n_fail, k, inconclusive, concat(k, '/', n_success) AS passed_fraction, CASE WHEN n_success > 0 THEN round(k / CAST(n_success AS DOUBLE), 4) END AS fraction,
CASE WHEN NOT inconclusive THEN n_success > 0 AND k >= ceil(n_success / 2.0) END AS verdict, NOT inconclusive AND k > 0 AND k < n_success AS flaky FROM b""",
)
def trials_binary(spark: SparkSession, d: str) -> DataFrame:
    df = runs(spark, d).withColumn("value", F.when(F.col("value") <= 0.5, 1.0).when(F.col("value").isNotNull(), 0.0))
    return trials.binary(df, ["case_id"], "value", 5)


@query(
    "overedit_report",
    f"""WITH c AS ({SQL['trials_continuous']}), j AS (SELECT coalesce(p.domain, 'casual') AS domain, c.* FROM (SELECT DISTINCT id, domain FROM ai_career_01) p JOIN c ON c.case_id = p.id)
SELECT domain, count(*) AS cases, CAST(round(CAST(avg(median) AS DECIMAL(20, 9)), 4) AS DOUBLE) AS mean_ratio, count(*) FILTER (median > 0.5) AS above, count(*) FILTER (flaky) AS flaky, count(*) FILTER (inconclusive) AS inconclusive FROM j GROUP BY 1""",
)
def overedit_report(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "ai_career_01").select("id", F.coalesce("domain", F.lit("casual")).alias("domain")).distinct()
    joined = domains.join(trials_continuous(spark, d), F.col("id") == F.col("case_id"))
    return evals.overedit_report(joined, "domain", threshold=0.5)


_PRE = ["Pre-flight: 0 Tier-1 tells, quick", "Pre-flight: mixed", "Pre-flight: Quick, human-authored"]
_FILES = f"""WITH r AS (SELECT case_id, run_idx, value, [{', '.join(map(g.q, _PRE))}][CAST(run_idx % 3 AS INT) + 1] AS pre, run_idx * 10 AS length FROM {_RUNS}),
a AS (SELECT case_id, count(value) AS n_success, count(*) - count(value) AS n_fail, CAST(round(CAST(median(value) AS DECIMAL(20, 9)), 4) AS DOUBLE) AS median, min(value) AS lo, max(value) AS hi, count(*) FILTER (value IS NOT NULL AND run_idx % 3 <> 1) AS quick,
arg_min(pre, struct_pack(a := run_idx, b := value)) FILTER (value IS NOT NULL) AS pre, arg_min(length, struct_pack(a := run_idx, b := value)) FILTER (value IS NOT NULL) AS length FROM r GROUP BY 1), i AS (SELECT *, n_success < 3 AS inconclusive FROM a),
f AS (SELECT case_id, n_success, n_fail, median, inconclusive, NOT inconclusive AND coalesce(lo <= 0.5 AND hi > 0.5, FALSE) AS flaky, coalesce(median > 0.5, FALSE) AS above, n_success > 0 AND quick >= ceil(n_success / 2.0) AS quick_drop, coalesce(pre, '') AS preflight, CAST(coalesce(length, 0) AS BIGINT) AS length FROM i)"""


@query("overedit_files", f"{_FILES} SELECT * FROM f")
def overedit_files(spark: SparkSession, d: str) -> DataFrame:
    pre = F.element_at(F.array(*map(F.lit, _PRE)), (F.col("run_idx") % 3 + 1).cast("int"))
    df = runs(spark, d).withColumn("pre", pre).withColumn("length", F.col("run_idx") * 10)
    return summaries.overedit_files(df, "case_id", "run_idx", "value", "pre", "length", 5, 0.5)


@query(
    "overedit_summary",
    f"""{_FILES}, s AS (SELECT count(*) FILTER (NOT inconclusive) AS files, CAST(coalesce(round(CAST(avg(median) FILTER (NOT inconclusive) AS DECIMAL(20, 9)), 4), 0) AS DOUBLE) AS mean_ratio, count(*) FILTER (NOT inconclusive AND above) AS above, count(*) FILTER (NOT inconclusive AND quick_drop) AS quick_drops,
count(*) FILTER (inconclusive) AS inconclusive, count(*) FILTER (flaky) AS flaky FROM f) SELECT *, round(above / CAST(files AS DOUBLE), 3) AS above_rate, round(quick_drops / CAST(files AS DOUBLE), 3) AS quick_drop_rate FROM s""",
)
def overedit_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.overedit_summary(overedit_files(spark, d))


@query("first_attempt_rate", "SELECT count(f) AS runs, count(*) FILTER (f) AS flagged, round(count(*) FILTER (f) / CAST(count(f) AS DOUBLE), 3) AS rate FROM (SELECT CASE WHEN event_id % 4 > 0 THEN event_id % 3 = 0 END AS f FROM events)")
def first_attempt_rate(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 3 == 0)
    return summaries.first_attempt_rate(table(spark, d, "events").select(flag.alias("first_attempt_changelog")), "first_attempt_changelog")


_JUDGED = "SELECT user_id AS case_id, CAST(1 + event_id % 10 AS INT) AS human_ness, CAST(1 + (event_id // 3) % 10 AS INT) AS meaning, CAST(1 + (event_id // 7) % 10 AS INT) AS length FROM events"
_LIMITS = {"human_ness": 7.5, "meaning": 8.0, "length": 7.0}
_STAT = ", ".join(f"round(avg({k}), 3) AS {k}_mean, round(coalesce(stddev_samp({k}), 0.0), 3) AS {k}_stdev, round(median({k}), 3) AS {k}_median" for k in _LIMITS)


def judged(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    mark = lambda by, name: (F.floor(e / by) % 10 + 1).cast("int").alias(name)
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), mark(1, "human_ness"), mark(3, "meaning"), mark(7, "length"))


@query("judge_scores", f"SELECT case_id, count(*) AS runs, {_STAT} FROM ({_JUDGED}) GROUP BY 1")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return trials.scores(judged(spark, d), ["case_id"], list(_LIMITS))


@query(
    "judge_report",
    f"WITH s AS ({SQL['judge_scores']}) SELECT count(*) AS cases, "
    + ", ".join(f"round(avg({k}_mean), 3) AS {k}, count(*) FILTER ({k}_mean < {t}) AS {k}_below, count(*) FILTER ({k}_median < {t}) AS {k}_median_below" for k, t in _LIMITS.items())
    + f", count(*) FILTER ({' OR '.join(f'{k}_mean < {t}' for k, t in _LIMITS.items())}) AS any_below FROM s",
)
def judge_report(spark: SparkSession, d: str) -> DataFrame:
    return evals.judge_report(judge_scores(spark, d), _LIMITS)


def _fires() -> str:
    rules = sorted({k for x in BRIDGE.values() for k in x.split()})
    h = ", ".join(f"{k}: {g.hits('c', next(r for r in EN if r.key == k))}" for k in rules)
    arms = " ".join(f"WHEN {i} THEN CASE WHEN {' + '.join(f'h.{k}' for k in x.split())} > 0 THEN 'fires' ELSE 'no_signal' END" for i, x in BRIDGE.items() if x)
    return f"SELECT pattern_id, id, CASE pattern_id {arms} ELSE 'unmapped' END AS signal FROM (SELECT pattern_id, id, {{{h}}} AS h FROM (SELECT pattern_id, id, {g.clean('coalesce(c.input, {})'.format(g.q('')))} AS c FROM {_CASES}))"


@query("audit_signal_counts", f"SELECT pattern_id, signal, CAST(count(*) AS BIGINT) AS n FROM ({_fires()}) GROUP BY ALL")
def audit_signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return evals.audit(cases(spark, d)).groupBy("pattern_id", "signal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "override_apply",
    """WITH h AS (SELECT pattern_id AS rule_id, coalesce(c.domain, '') AS domain, count(*) AS hits FROM {cases} GROUP BY 1, 2), l(rule_id, domain, level) AS (VALUES {rows})
SELECT rule_id, domain, hits, coalesce(level, 'strict') AS level, CASE WHEN level = 'SKIP' THEN FALSE WHEN level = 'light' THEN hits >= 3 ELSE hits > 0 END AS applies FROM h LEFT JOIN l USING (rule_id, domain)""".format(
        cases=_CASES, rows=", ".join(f"({i}, '{dom}', '{lev}')" for i, dom, lev in evals.levels())
    ),
)
def override_apply(spark: SparkSession, d: str) -> DataFrame:
    hits = cases(spark, d).groupBy(F.col("pattern_id").alias("rule_id"), "domain").agg(F.count(F.lit(1)).alias("hits"))
    return evals.apply_levels(hits, "de")


_TELLS = " + ".join(f"h.{k}" for k in evals.rules_of(evals.TIER1_RULES))
_QUICK = " + ".join(f"h.{k}" for k in evals.rules_of(evals.QUICK_RULES))


@query("preflight_route", f"SELECT doc_id, CAST({_TELLS} AS BIGINT) AS tells, CASE WHEN {g.density(f'({_TELLS})', 'words')} < 1 THEN 'quick' WHEN {g.density(f'({_TELLS})', 'words')} < 3 THEN 'mixed' ELSE 'full' END AS route FROM ({g.scored(seeded_sql('en'), 'doc_id', 'text', 'en')})")
def preflight_route(spark: SparkSession, d: str) -> DataFrame:
    return evals.route(seeded(docs(spark, d), "en"), "doc_id", "text")


@query("quick_mode_hits", f"SELECT doc_id, CAST({_QUICK} AS BIGINT) AS hits FROM ({g.scored(seeded_sql('en'), 'doc_id', 'text', 'en')})")
def quick_mode_hits(spark: SparkSession, d: str) -> DataFrame:
    return evals.quick_hits(seeded(docs(spark, d), "en"), "doc_id", "text")


@query("resume_pending", f"SELECT DISTINCT id FROM ai_career_01 WHERE id NOT IN (SELECT case_id FROM {_RUNS} WHERE value IS NOT NULL AND case_id IS NOT NULL)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "ai_career_01").select("id").distinct()
    return evals.pending(plan, runs(spark, d).filter("value is not null").select(F.col("case_id").alias("id")), ["id"])


@query("resume_reused", f"SELECT DISTINCT id FROM ai_career_01 WHERE id IN (SELECT case_id FROM {_RUNS} WHERE value IS NOT NULL)")
def resume_reused(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "ai_career_01").select("id").distinct()
    return evals.reused(plan, runs(spark, d).filter("value is not null").select(F.col("case_id").alias("id")), ["id"])


@query("planned_documents", "SELECT license_class, CAST(count(*) AS BIGINT) AS sources, CAST(sum(n) AS BIGINT) AS documents FROM (VALUES " + ", ".join(f"({g.q(x.split()[3])}, {x.split()[1]})" for x in landed.SOURCES.strip().splitlines()) + ") t(license_class, n) GROUP BY ROLLUP (license_class)")
def planned_documents(spark: SparkSession, d: str) -> DataFrame:
    return external.planned_documents(landed.registry(spark))


_LANDED = "(SELECT DISTINCT id AS title, text AS raw FROM fetch_de_wikipedia_ai_tagged WHERE id IS NOT NULL AND text IS NOT NULL)"
_TRY = f"SELECT title, min(raw) AS raw, row_number() OVER (ORDER BY md5(concat('42:', title)), title) AS tried FROM {_LANDED} GROUP BY title"


@query("collected_articles", f"SELECT title, text FROM (SELECT title, array_to_string(list_slice(w, 1, 800), ' ') AS text, row_number() OVER (ORDER BY tried) AS place FROM (SELECT title, tried, {g.spaced(g.wikitext('raw'))} AS w FROM ({_TRY}) WHERE tried <= 28) WHERE len(w) >= 200) WHERE place <= 8")
def collected_articles(spark: SparkSession, d: str) -> DataFrame:
    """The sampler of tagged articles: titles in a seeded order, more tried than wanted, the first valid ones kept."""
    df = table(spark, d, "fetch_de_wikipedia_ai_tagged").filter("id is not null and text is not null").select(F.col("id").alias("title"), F.lit("").alias("source_url"), F.col("text").alias("raw"))
    own = landed.registry(spark).filter(F.col("name") == "wikipedia_academic")
    docs = landed.collected(df.withColumn("name", F.lit("wikipedia_academic")), own, "2026-01-01", oversample=True)
    return docs.select(F.col("metadata")["title"].alias("title"), "text")


@query("result_keys", "SELECT DISTINCT id, replace(replace(regexp_replace(concat('a/', id, '.md'), '\\.[A-Za-z0-9]+$', ''), '/', '_'), '\\', '_') AS key FROM documents_ids".replace("documents_ids", "(SELECT source_url AS id FROM fetch_de_human_corpus WHERE source_url IS NOT NULL)"))
def result_keys(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("base/a/"), F.col("source_url"), F.lit(".md"))
    return table(spark, d, "fetch_de_human_corpus").filter("source_url is not null").select(F.col("source_url").alias("id"), landed.result_key(path, "base").alias("key")).distinct()


@query("url_quoted", "SELECT DISTINCT title, replace(replace(replace(url_encode(replace(title, ' ', '_')), '%2F', '/'), '~', '%7E'), '%2A', '*') AS url FROM (SELECT coalesce(domain, '') || ' / ' || lang AS title FROM documents WHERE lang IS NOT NULL)")
def url_quoted(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.coalesce("domain", F.lit("")), F.lit(" / "), F.col("lang"))
    return docs(spark, d).filter("lang is not null").select(title.alias("title")).select("title", T.url_quote(F.col("title")).alias("url")).distinct()


_BARE = rf"regexp_replace(text, '(?s)\A---{g.S}*\n.*?\n---{g.S}*\n', '')"


@query("frontmatter_stripped", f"SELECT doc_id, {_BARE} AS body FROM documents WHERE text IS NOT NULL")
def frontmatter_stripped(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", T.strip_frontmatter(F.col("text")).alias("body"))


@query("decoded", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts in base64, broken into lines as answers have it, and back."""
    packed = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]+", "\n")
    return docs(spark, d).filter("text is not null").select("doc_id", T.decode_base64(packed).alias("text"))


_SAID = " OR ".join(f"contains(lower(t), {g.q(x)})" for x in rewrite.LEAK_TOKENS)


@query("rewrite_leaks", f"SELECT id, length(t) > length(input) * 1.15 OR {_SAID} OR {_signs()[1]} AS leak FROM (SELECT id, input, concat(coalesce(reference_rewrite, ''), {g.q(chr(10))}, [{', '.join(map(g.q, _SIGNS))}][CAST(length(input) % {len(_SIGNS)} AS INT) + 1]) AS t FROM {_PAIRS})")
def rewrite_leaks(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, _SIGNS)), (F.length("input") % len(_SIGNS) + 1).cast("int"))
    t = F.concat(F.coalesce("reference_rewrite", F.lit("")), F.lit("\n"), sign)
    return pairs(spark, d).select("id", rewrite.leaks(F.col("input"), t).alias("leak"))


@query("plan_grid", "SELECT d AS domain, m AS model, t AS topic FROM (SELECT unnest(['academic', 'career', 'casual']) AS d), (SELECT unnest(['m1', 'm2']) AS m), (SELECT unnest(['t1', 't2', 't3']) AS t)")
def plan_grid(spark: SparkSession, d: str) -> DataFrame:
    return evals.plan_grid(spark, domain=["academic", "career", "casual"], model=["m1", "m2"], topic=["t1", "t2", "t3"])


@query("pooled_rollup", "SELECT lang, origin, count(*) AS n, count(*) FILTER (n_chars > 500) AS k, round(count(*) FILTER (n_chars > 500) / CAST(count(*) AS DOUBLE), 4) AS rate FROM documents GROUP BY ROLLUP (lang, origin)")
def pooled_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evals.pooled_rate(docs(spark, d), ["lang", "origin"], F.col("n_chars") > 500)


@query(
    "wilson_interval",
    """WITH a AS (SELECT domain, CAST(count(*) FILTER (n_chars > 500) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1),
b AS (SELECT *, 1 + 1.96 * 1.96 / n AS dn, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) AS m FROM a)
SELECT domain, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(k / n, 4) AS rate, round(greatest(0, c - m), 4) AS low, round(least(1, c + m), 4) AS high FROM b""",
)
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    return evals.rate_with_interval(docs(spark, d), "domain", F.col("n_chars") > 500)


_SENT = f"SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS s FROM (SELECT doc_id, {g.sentences('text')} AS x FROM documents)"


@query(
    "opener_runs",
    f"""WITH s AS (SELECT doc_id, n, lower(regexp_extract(s, {g.q(T.WORD)})) AS o FROM ({_SENT})), w AS (SELECT doc_id, o, lag(o, 1) OVER (PARTITION BY doc_id ORDER BY n) AS a, lag(o, 2) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM s)
SELECT doc_id, CAST(count(*) AS BIGINT) AS runs FROM w WHERE o = a AND o = b GROUP BY 1""",
)
def opener_runs(spark: SparkSession, d: str) -> DataFrame:
    return evals.opener_runs(docs(spark, d), "doc_id", "text")


@query(
    "staccato_runs",
    f"""WITH s AS (SELECT doc_id, n, {g.words('s')} AS w FROM ({_SENT})), i AS (SELECT *, sum(CASE WHEN w <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM s)
SELECT doc_id, CAST(min(n) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS length FROM i WHERE w <= 8 GROUP BY doc_id, island HAVING count(*) >= 3""",
)
def staccato_runs(spark: SparkSession, d: str) -> DataFrame:
    return evals.staccato_runs(docs(spark, d), "doc_id", "text")


_ERA = ", ".join(f"{{'era': {g.q(e)}, 'hits': {g.count('text', g.whole(any_of(w)))}}}" for e, w in evals.ERAS.items())


@query("era_hits", f"SELECT doc_id, u.era AS era, u.hits AS hits FROM (SELECT doc_id, unnest([{_ERA}]) AS u FROM {seeded_sql('en')}) WHERE u.hits > 0")
def era_hits(spark: SparkSession, d: str) -> DataFrame:
    return evals.era_hits(seeded(docs(spark, d), "en"), "doc_id", "text")


@query("dated_era", f"SELECT doc_id, list_sort(list_transform(l, lambda x: {{'n': -x.hits, 'era': x.era}}))[1].era AS era, list_max(list_transform(l, lambda x: x.hits)) AS hits FROM (SELECT doc_id, [{_ERA}] AS l FROM {seeded_sql('en')}) WHERE list_max(list_transform(l, lambda x: x.hits)) > 0")
def dated_era(spark: SparkSession, d: str) -> DataFrame:
    return evals.dated(seeded(docs(spark, d), "en"), "doc_id", "text")


_DOM = ", ".join(f"{{'n': {g.count('text', g.whole(w))}, 'd': {g.q(x)}}}" for x, w in evals.DOMAIN_WORDS.items())


@query("inferred_domain", f"SELECT doc_id, CASE WHEN list_max(list_transform(l, lambda x: x.n)) > 0 THEN list_filter(l, lambda x: x.n = list_max(list_transform(l, lambda y: y.n)))[1].d ELSE 'casual' END AS domain FROM (SELECT doc_id, [{_DOM}] AS l FROM documents WHERE text IS NOT NULL)")
def inferred_domain(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", evals.infer_domain(F.col("text")).alias("domain"))


@query("subjunctive_clusters", f"SELECT doc_id, {g.count('text', r'(?i)\b(würden?|wäre[n]?|hätten?|könnten?|sollten?|müssten?|dürften?)\b')} >= 3 AS cluster FROM (SELECT doc_id, concat(coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN ' Es wäre gut, wenn sie könnten und sollten.' ELSE '' END) AS text FROM documents)")
def subjunctive_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " Es wäre gut, wenn sie könnten und sollten.").otherwise(""))
    return docs(spark, d).select("doc_id", (T.count(t, evals.java(evals.SUBJUNCTIVE, "i")) >= 3).alias("cluster"))


_MOOD = "(SELECT doc_id, concat(coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN ' Es wäre gut, wenn sie könnten und sollten.' ELSE '' END) AS text FROM documents)"


@query("subjunctive_paragraphs", f"WITH a AS (SELECT doc_id, {g.paragraphs('text')} AS ps FROM {_MOOD}), b AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) AS BIGINT) AS paragraph, unnest(ps) AS p FROM a) SELECT doc_id, paragraph, {g.count('p', '(?i)' + evals.SUBJUNCTIVE)} AS forms FROM b WHERE {g.count('p', '(?i)' + evals.SUBJUNCTIVE)} >= 3")
def subjunctive_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " Es wäre gut, wenn sie könnten und sollten.").otherwise(""))
    return evals.subjunctive_paragraphs(docs(spark, d).select("doc_id", t.alias("text")), "doc_id", "text")


def _numbers(ids: list[int]) -> str:
    return "(SELECT unnest([" + ", ".join(map(str, ids)) + "]) AS rule_id)"


@query("override_ids", " UNION ALL ".join(f"SELECT {g.q(x)} AS lang, (SELECT count(DISTINCT rule_id) FROM {_numbers([r[0] for r in levels() if x == 'de' or r[0] < 100 and r[0] != 11])}) AS overridden, (SELECT count(*) FROM (SELECT rule_id FROM {_numbers([r[0] for r in levels() if x == 'de' or r[0] < 100 and r[0] != 11])} EXCEPT SELECT rule_id FROM {_numbers(list(rules(x)))})) AS unknown" for x in PACKS))
def override_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rules with domain levels of each language, and those of them that its packs lack."""
    per = []
    for x in PACKS:
        over = evals.override_levels(spark, x).select(F.lit(x).alias("lang"), "rule_id").distinct().withColumn("bad", F.lit(0))
        per.append(over.unionByName(evals.unknown_levels(spark, x).select(F.lit(x).alias("lang"), "rule_id", F.lit(1).alias("bad"))))
    return per[0].unionByName(per[1]).groupBy("lang").agg(F.sum(1 - F.col("bad")).alias("overridden"), F.sum("bad").alias("unknown"))


@query("rule_modes", " UNION ALL ".join(f"SELECT {g.q(x)} AS lang, {g.q(m)} AS mode, (SELECT count(*) FROM (SELECT rule_id FROM {_numbers(ids)} INTERSECT SELECT rule_id FROM {_numbers(list(rules(x)))})) AS rules, (SELECT count(*) FROM (SELECT rule_id FROM {_numbers(ids)} INTERSECT SELECT rule_id FROM {_numbers(list(evals.TIER1_RULES))})) AS tier1" for x in PACKS for m, ids in modes(x).items()))
def rule_modes(spark: SparkSession, d: str) -> DataFrame:
    tables = [evals.rule_table(spark, x).withColumn("lang", F.lit(x)) for x in PACKS]
    rows = tables[0].unionByName(tables[1]).select("lang", "tier1", F.explode("modes").alias("mode"))
    return rows.groupBy("lang", "mode").agg(F.count(F.lit(1)).alias("rules"), F.sum(F.col("tier1").cast("long")).alias("tier1"))


# --- documents and corpora -------------------------------------------------------------------------

_HTML = "concat('<html><nav><p>one two three four five six seven eight nine</p></nav><p class=\"x\">', replace(coalesce(text, ''), '<', '&lt;'), ' &amp; <b>more</b> words</p><p>too few</p><script>p()</script></html>')"


def _html() -> F.Column:
    return F.concat(F.lit('<html><nav><p>one two three four five six seven eight nine</p></nav><p class="x">'), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit(" &amp; <b>more</b> words</p><p>too few</p><script>p()</script></html>"))


@query("html_paragraphs", f"SELECT doc_id, {g.html_paragraphs('h')} AS body FROM (SELECT doc_id, {_HTML} AS h FROM documents)")
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", _html().alias("h")).select("doc_id", T.html_paragraphs(F.col("h")).alias("body"))


@query("html_text", f"SELECT doc_id, {g.unescape(g.sub('h', '<[^>]+>'))} AS body FROM (SELECT doc_id, {_HTML} AS h FROM documents)")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", _html().alias("h")).select("doc_id", T.html_text(F.col("h")).alias("body"))


_WIKI = "== Head ==\n[[Berlin|Hauptstadt]] und [[Rom]] {{Infobox|{{x}}|y}} '''fett''' <ref name=\"a\">q</ref> [https://e.example Text] [[Datei:b.png|mini]]\n\n\n\n#WEITERLEITUNG: z\n"


@query("wikitext_strip", f"SELECT id, {g.wikitext(f'concat(text, {g.q(_WIKI)})')} AS body FROM (SELECT DISTINCT id, text FROM fetch_de_wikipedia_ai_tagged WHERE text IS NOT NULL)")
def wikitext_strip(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "fetch_de_wikipedia_ai_tagged").filter("text is not null").select("id", "text").distinct()
    return df.select("id", T.strip_wikitext(F.concat("text", F.lit(_WIKI))).alias("body"))


_MD = "\n# Head\n`code` ![i](u) [link](v) <b>x</b>\n```\nfence\n```"


@query("markdown_plain", f"SELECT doc_id, {g.markdown(f'concat(text, {g.q(_MD)})')} AS body FROM documents WHERE text IS NOT NULL")
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", T.markdown_plain(F.concat("text", F.lit(_MD))).alias("body"))


@query("slug_ids", f"SELECT DISTINCT id, substring(concat('doc_', {g.sub(g.sub(g.sub('lower(source_url)', r'[^\p{L}\p{N}_\-]', '_'), '_+', '_'), r'\A_+|_+\z')}), 1, 80) AS slug FROM fetch_de_human_corpus WHERE source_url IS NOT NULL")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "fetch_de_human_corpus").filter("source_url is not null")
    return df.select("id", T.slug(F.lit("doc"), F.col("source_url")).alias("slug")).distinct()


@query("trim_words", f"SELECT doc_id, CASE WHEN len({g.spaced('text')}) < 30 THEN '' ELSE array_to_string(list_slice({g.spaced('text')}, 1, 60), ' ') END AS body FROM documents WHERE text IS NOT NULL")
def trim_words(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", T.trim_words(F.col("text"), 60, 30).alias("body"))


@query(
    "frontmatter",
    rf"""SELECT doc_id, CASE WHEN f = '' THEN 'casual' ELSE f END AS domain, {g.strip(r"regexp_replace(text, '(?s)\A---\n.*?\n---\n', '')")} AS body
FROM (SELECT doc_id, text, {g.strip(r"regexp_extract(regexp_extract(text, '(?s)\A---\n(.*?)\n---\n', 1), '(?m)^[ \t]*domain:[ \t]*(.*)$', 1)")} AS f FROM documents WHERE text IS NOT NULL)""",
)
def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return docs(spark, d).filter("text is not null").select("doc_id", T.sample_domain(c).alias("domain"), T.sample_body(c).alias("body"))


@query(
    "yaml_scalars",
    r"""SELECT DISTINCT source_url, CASE WHEN regexp_matches(source_url, '[:\-{}\[\],&*#?|<>=!%@`\n]') OR regexp_matches(source_url, '\A[''"]') THEN concat('"', replace(replace(source_url, '\', '\\'), '"', '\"'), '"') ELSE source_url END AS scalar FROM fetch_de_human_corpus WHERE source_url IS NOT NULL""",
)
def yaml_scalars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_de_human_corpus").filter("source_url is not null").select("source_url", T.yaml_scalar(F.col("source_url")).alias("scalar")).distinct()


@query("sample_audit", f"""WITH s AS ({g.scored(f"(SELECT doc_id, {_BARE} AS text FROM {seeded_sql('en')})", 'doc_id', 'text', 'en')}), l AS ({g.long_hits('s', 'doc_id', 'en')}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rule) AS place FROM l WHERE hits > 0),
t AS (SELECT doc_id, string_agg(concat(rule, ': ', hits), '; ' ORDER BY place) AS top FROM r WHERE place <= 5 GROUP BY 1)
SELECT doc_id, words, tier1, round(d, 2) AS density, {g.band('d')} AS band, CASE WHEN {g.band('d')} <> 'LOW' THEN coalesce(top, '') ELSE '' END AS top FROM s LEFT JOIN t USING (doc_id)""")
def sample_audit(spark: SparkSession, d: str) -> DataFrame:
    return reports.sample_audit(seeded(docs(spark, d), "en"), "doc_id", "text")


@query("audit_summary", f"SELECT count(DISTINCT pattern_id) AS patterns, count(*) AS cases, count(*) FILTER (signal = 'fires') AS fires, count(*) FILTER (signal = 'no_signal') AS no_signal, count(*) FILTER (signal = 'unmapped') AS unmapped FROM ({_fires()})")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_summary(evals.audit(cases(spark, d)))


@query("source_sidecars", "SELECT license_class, license AS source, min(id) AS id, CAST(count(*) AS BIGINT) AS doc_count FROM (SELECT DISTINCT id, license, license_class FROM fetch_de_human_corpus) GROUP BY 1, 2")
def source_sidecars(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "fetch_de_human_corpus").select("id", "license", "license_class").distinct()
    return df.groupBy("license_class", F.col("license").alias("source")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("doc_count"))


@query("latest_runs", f"SELECT case_id, max_by(run_idx, struct_pack(a := finished_at, b := run_idx)) AS run_idx FROM {_RUNS} WHERE finished_at IS NOT NULL AND case_id IS NOT NULL GROUP BY 1")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    df = runs(spark, d).filter("finished_at is not null and case_id is not null").withColumn("w", F.struct("finished_at", "run_idx"))
    return corpus.latest_before(df, "case_id", "w", "run_idx")


@query("seeded_sample", "SELECT doc_id, lang, domain FROM (SELECT DISTINCT doc_id, lang, domain FROM documents) ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.seeded_sample(docs(spark, d).select("doc_id", "lang", "domain"), "doc_id", 100)


_PROSE = f"(SELECT doc_id, {g.spaced(g.wikitext('text'))} AS w FROM documents WHERE domain = 'technical' AND text IS NOT NULL)"


@query("domain_sample", f"SELECT doc_id, text FROM (SELECT DISTINCT doc_id, array_to_string(list_slice(w, 1, 400), ' ') AS text FROM {_PROSE} WHERE len(w) >= 50) ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 50")
def domain_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prose_corpus(docs(spark, d), "doc_id", "text", "technical", 50)


@query("set_operations", "SELECT (SELECT count(*) FROM (SELECT lang FROM documents INTERSECT SELECT lang FROM ai_career_01)) AS both_langs, (SELECT count(*) FROM (SELECT lang FROM documents EXCEPT SELECT lang FROM ai_career_01)) AS only_documents, (SELECT count(*) FROM (SELECT lang FROM documents UNION SELECT lang FROM ai_career_01)) AS all_langs")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = docs(spark, d).select("lang"), table(spark, d, "ai_career_01").select("lang")
    parts = [("both_langs", a.intersect(b)), ("only_documents", a.subtract(b)), ("all_langs", a.unionByName(b).distinct())]
    named = [x.select(F.lit(n).alias("what")) for n, x in parts]
    rows = named[0].unionByName(named[1]).unionByName(named[2])
    return rows.agg(*(F.sum(F.when(F.col("what") == n, 1).otherwise(0)).cast("long").alias(n) for n, _ in parts))


@query("next_heading", "SELECT doc_id, CAST(k AS BIGINT) AS start, CAST(lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop FROM (SELECT doc_id, unnest(list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '#'))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))")
def next_heading(spark: SparkSession, d: str) -> DataFrame:
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.col("line").startswith("#"))
    return corpus.next_heading(lines.select("doc_id", (F.col("i") + 1).cast("long").alias("start")), "doc_id", "start")


_PACK = ("# Pack\n### 7. First rule\n**Words to watch:** robust, seamless; `x`\n\n**Before:**\n> ", "\n\n**After:**\n> y\n### 8. Second\nrest")
_LINE = g.strip(g.sub("text", f"{g.S}+", " "))
_TERMS = "string_split_regex(regexp_extract(x, '\\*\\*Words to watch:\\*\\*\\s*([^\\n]+)', 1), '[,;|]')"


@query(
    "rule_sections",
    f"""WITH a AS (SELECT doc_id AS pack, unnest(list_slice(string_split(concat(chr(10), {g.q(_PACK[0])}, {_LINE}, {g.q(_PACK[1])}), concat(chr(10), '### ')), 2, 9)) AS x FROM documents WHERE text IS NOT NULL)
SELECT pack, CAST(split_part(x, '. ', 1) AS INT) AS rule_id, split_part(split_part(x, chr(10), 1), '. ', 2) AS name, CAST(contains(x, '**Before:**') AS INT) AS inputs, array_to_string(list_filter(list_transform({_TERMS}, lambda t: trim(t, ' .—')), lambda t: t <> '' AND NOT starts_with(t, '`')), '|') AS terms FROM a""",
)
def rule_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections, examples and trigger lists of a rule pack made from documents."""
    body = F.concat(F.lit(_PACK[0]), T.strip(F.regexp_replace("text", T.SPACES, " ")), F.lit(_PACK[1]))
    packs = docs(spark, d).filter("text is not null").select(F.col("doc_id").alias("pack"), body.alias("text"))
    s = corpus.rule_sections(packs)
    return s.select("pack", "rule_id", "name", F.size(corpus.before_inputs(F.col("body"))).alias("inputs"), F.concat_ws("|", corpus.trigger_terms(F.col("body"))).alias("terms"))


@query("file_hashes", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' WHEN a.t = b.t THEN 'same' ELSE 'differs' END AS status FROM (SELECT id, input AS t FROM {p} WHERE length(input) % 5 > 0) a FULL JOIN (SELECT id, CASE WHEN length(input) % 3 = 0 THEN upper(input) ELSE input END AS t FROM {p} WHERE length(input) % 7 > 0) b USING (id)) GROUP BY 1".replace("{p}", _PAIRS))
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("input")
    a = pairs(spark, d).filter(n % 5 > 0).select(F.col("id").alias("path"), F.col("input").alias("content"))
    b = pairs(spark, d).filter(n % 7 > 0).select(F.col("id").alias("path"), F.when(n % 3 == 0, F.upper("input")).otherwise(F.col("input")).alias("content"))
    return evals.hash_compare(a, b).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("candidate_ranks", "SELECT run_id, rank, ngram, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY llr DESC, ai_count DESC NULLS LAST, n, ngram, rank) AS BIGINT) AS place FROM (SELECT DISTINCT run_id, rank, ngram, n, ai_count, llr FROM mine_patterns WHERE ngram IS NOT NULL)) WHERE place <= 10")
def candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "mine_patterns").filter("ngram is not null").select("run_id", "rank", "ngram", "n", "ai_count", "llr").distinct()
    w = Window.partitionBy("run_id").orderBy(F.desc("llr"), F.desc_nulls_last("ai_count"), "n", "ngram", "rank")
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 10").select("run_id", "rank", "ngram", "place")


def _keys(lang: str) -> str:
    return "(SELECT unnest([" + ", ".join(g.q(r.key) for r in pack(lang)) + "]) AS rule)"


@query("pack_disjoint", f"SELECT (SELECT count(*) FROM (SELECT rule FROM {_keys('en')} INTERSECT SELECT rule FROM {_keys('de')})) AS shared, (SELECT count(DISTINCT rule) FROM {_keys('en')}) AS en, (SELECT count(DISTINCT rule) FROM {_keys('de')}) AS de")
def pack_disjoint(spark: SparkSession, d: str) -> DataFrame:
    a, b = (spark.createDataFrame([(r.key,) for r in pack(x)], "rule string") for x in ("en", "de"))
    joined = a.withColumn("en", F.lit(1)).join(b.withColumn("de", F.lit(1)), "rule", "full")
    return joined.agg(F.count(F.when(F.col("en").isNotNull() & F.col("de").isNotNull(), 1)).alias("shared"), F.count("en").alias("en"), F.count("de").alias("de"))
