import random

from lexisift.llm import quality

PROSE = "Am Morgen ging die Gruppe in den Wald, und es war noch kühl. Sie hatten für den Tag genug Brot dabei. Auf dem Rückweg war es dann so warm, dass alle im Schatten saßen."


def form(lines: list[str]) -> str | None:
    """The form of a text among many others with the same look and many of prose."""
    figures = list(quality.looks(lines).values())
    others = [("de", k, v, below, 100) for k, own in zip(quality.LOOKS, figures) for v, below in {0.0: 0, 0.4: 80, 0.6: 85, own: 90 if own > 0.6 else 80 if own else 0}.items()]
    return quality.Tails(others).form("de", figures)


def test_forms():
    assert form(PROSE.split("\n")) is None
    assert form([PROSE, "- Brot", "- Käse", "- Salz"]) is None
    assert form(["- Brot", "- Käse", "* Salz", "– Milch"]) == "list"
    assert form(["Brot", "Käse", "Salz", "Milch"]) == "list"
    assert form(["Brot und Käse aus dem Tal", "Dryskybyv, Jububol (1896)", "Köhös, Byfubyst (1980)", "Zvkr, Bqjk (1912)", "Faukibaur, Witiabriv (1929)"]) == "list"
    assert form(["Brot;3;2,50", "Käse;1;4,00", "Salz;9;0,80"]) == "table"
    assert form(["|-", "! A !! B", "| x || 1", "| y || 2"]) == "table"
    assert form(["qzrt wlfkpt xzzqr ptk", "wqqk jzpft rrtzk qpl"]) == "junk"
    assert form(["~#<:.&:</@~1;;^#.+~+^:", ";@:;+~>&_%~1<%<0_@"]) == "junk"
    assert form(["[13:52:25] 0x8352 ERR ab::cd+507", "[10:14:29] 0x5bb6 ERR ef::gh+813"]) == "junk"
    assert form(["Wort Wort Wort Wort Wort Wort Wort Wort"] * 5) == "junk"
    assert form([]) is None and form(["", " "]) is None


def test_ranks_decide_on_mixed_looks():
    half = {k: 0.0 for k in quality.LOOKS}
    rare = quality.Tails([("de", k, v, b, 1000) for k in quality.LOOKS for v, b in ((0.0, 0), (0.3, 990), (0.7, 995))])
    assert rare.form("de", (half | {"entry_share": 0.3}).values()) is None and rare.form("de", (half | {"entry_share": 0.7}).values()) == "list"
    assert rare.form("de", (half | {"entry_share": 0.3, "row_share": 0.3}).values()) in ("list", "table")


def test_texts_on_both_sides_of_half(spark):
    names = [a + b for a in ("Mar", "Tol", "Ver", "Sin") for b in ("ka", "po", "leis", "tun", "rad")]
    rows = [(f"{n}", "\n".join([f"- {x} mit {x}stein und {x}holz" for x in names[:n]] + [f"Der {x}brief lag im {x}haus, und er war {x}." for x in names[n:]])) for n in range(21)]
    got = {r.id for r in quality.not_prose(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    shares = {k: quality.looks(t.split("\n"))["entry_share"] for k, t in rows}
    assert got == {k for k, v in shares.items() if v > 0.5} and 5 < len(got) < 15


def test_distinct_words_are_of_the_whole_text():
    start = " ".join(f"wort{i}" for i in range(200))
    junk = " ".join(["fehler"] * 600)
    assert quality.statistics(start)["distinct_words"] == 1.0
    assert quality.statistics(f"{start} {junk}")["distinct_words"] == quality.statistics(f"{junk} {start}")["distinct_words"] == round(203 / 800, 6)
    assert quality.statistics(start + " ende")["distinct_words"] == 1.0 and quality.statistics("")["distinct_words"] == 0.0


def test_ranks_match_sorting(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["de", "en"]), rng.choice(["a", "b"]), round(rng.choice([0.0, rng.random()]), 2)) for _ in range(3000)]
    got = {(r.lang, r.stat, r.value): (r.n, r.below, r.upto, r.total) for r in quality.ranks(spark.createDataFrame(rows, "lang string, stat string, value double")).collect()}
    for lang, stat, v in set(rows):
        own = [x for a, b, x in rows if (a, b) == (lang, stat)]
        assert got[lang, stat, v] == (own.count(v), sum(x < v for x in own), sum(x <= v for x in own), len(own))


def test_rows(spark):
    rows = [(f"p{i}", PROSE + f" Das war am {i}. Tag so.", 1) for i in range(30)]
    rows += [("l", "\n".join(f"- Ding {i}" for i in range(12)), 1), ("t", "\n".join(f"Ding;{i};{i},5" for i in range(12)), 1), ("j", "~#<:.&:</@~1;;^#.+~+^:\n" * 6, 1), ("n", None, 1), ("b", " \n", 1), ("x", " ".join(f"Am {i}. Tag kam Brief {i * 7 % 991} aus Ort {i * 13 % 977}, und er war für Haus {i * 5 % 983} neu." for i in range(1500)), 1)]
    df = spark.createDataFrame(rows + rows[-6:], "id string, text string, score int")
    got = {r.id: r.form for r in quality.not_prose(df, "id", "text").collect()}
    assert got == {"l": "list", "t": "table", "j": "junk"}
    figures = quality.scored(df, "id", "text")
    assert figures.count() == 30 + 4 * 2 and figures.filter("score is null").count() == 0
    assert quality.not_prose(df.limit(0), "id", "text").count() == 0


def test_forms_do_not_depend_on_other_texts(spark):
    lists = [(f"l{i}", "\n".join(f"- Ding {i * n % 97}" for n in range(1, 13))) for i in range(1, 61)]
    rows = lists + [(f"p{i}", PROSE + f" Das war am {i}. Tag so.") for i in range(5)]
    got = {r.id: r.form for r in quality.not_prose(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got == {k: "list" for k, _ in lists}
