import random

from lexisift.llm import align, wrapper

NOUNS = "Lampen Brücken Mauern Schrauben Segel Kisten Pinsel Räder".split()


def page(host: int, n: int) -> tuple[str, set[int]]:
    """A page of a site with its own furniture, and the numbers of the furniture's lines."""
    rng = random.Random(host * 1000 + n)
    a, b = NOUNS[host % 8], NOUNS[(host + 3) % 8]
    say = lambda: f"{rng.choice(NOUNS)} und {rng.choice(NOUNS)} wurden im Jahr {rng.randint(1900, 2020)} von {rng.choice(['Mira', 'Jonas', 'Tove'])} sorgfältig geprüft und danach verkauft."
    top = [f"Kanal{host} | Start | {a} | {b} | Kontakt", "Alle akzeptieren"]
    foot = ["Impressum – Datenschutz – AGB", f"© 2020 Verlag Haus{host} – Alle Rechte vorbehalten"]
    body = [f"== {rng.choice(NOUNS)} im Wandel {n}", "", *(say() for _ in range(4))]
    lines = [*top, *body, "Teilen · Merken", say(), *foot]
    outside = {i for i, x in enumerate(lines) if x in top or x in foot or x == "Teilen · Merken"}
    return "\n".join(lines), outside


def number(n: int, shape: int = align.OTHER) -> int:
    return 16 * n | align.STRONG | shape


NAV, BAR, OFFER, HEAD, FOOT = (number(n) for n in range(1, 6))
BODY, ROW = align.PROSE, align.TITLE


def test_optionals_and_slots():
    w = align.infer([[NAV, BODY, OFFER, FOOT], [NAV, BAR, BODY, OFFER, BODY, FOOT], [NAV, OFFER, BODY, BAR, FOOT], [BAR, OFFER, BODY, FOOT]])
    # BAR stands before and behind OFFER: two optional nodes.
    assert w.tokens == [NAV, BAR, OFFER, BAR, FOOT] and w.support == [3, 2, 4, 1, 4]
    assert align.infer([]).tokens == [] and align.settled(align.infer([[BODY]]))[0] == []


def test_order_counts():
    pages = [[NAV, BODY, OFFER, BODY, BAR, BODY, FOOT] for _ in range(6)]
    tokens, support, opens = align.settled(align.infer(pages))
    strip = lambda *x: [t & ~align.STRONG for t in x]
    assert tokens == strip(NAV, OFFER, BAR, FOOT)
    assert align.parse(tokens, support, opens, strip(NAV, BODY, OFFER, BAR, FOOT))[0] == {0, 2, 3, 4}
    # A token out of the wrapper's order is text of a slot.
    assert align.parse(tokens, support, opens, strip(NAV, FOOT, BODY, BODY, OFFER, BAR, FOOT))[0] == {0, 4, 5, 6}
    rng = random.Random(1)
    mixed = [rng.sample(p, len(p)) for p in pages]
    assert align.infer(mixed).support != align.infer(pages).support


def test_repeated_groups():
    w = align.infer([[NAV, BAR, NAV, BAR, BODY, FOOT], [NAV, BAR, BODY, FOOT], [NAV, BAR, NAV, BAR, NAV, BAR, BODY, FOOT]])
    assert w.tokens == [NAV, BAR, FOOT] and w.support == [3, 3, 3] and w.repeats == [2, 2, 0]
    nodes = align.settled(w)
    assert align.parse(*nodes, [t & ~align.STRONG for t in (NAV, BAR, NAV, BAR, BODY, FOOT)])[0] == {0, 1, 2, 3, 5}
    titles = [[NAV, BODY, HEAD, *[ROW] * n, FOOT] for n in (2, 3, 5)]
    tokens, support, opens = align.settled(align.infer(titles))
    assert opens == [False, False, True, False][-len(opens) :] and opens[tokens.index(HEAD & ~align.STRONG)]


def test_merged_groups_equal_one_group():
    pages = [[NAV, *([BAR] if n % 3 else []), BODY, *([OFFER] if n % 2 else []), BODY, FOOT] for n in range(60)]
    whole, parts = align.infer(pages), align.merge([align.infer(pages[n : n + 10]) for n in range(0, 60, 10)])
    assert (parts.tokens, parts.support, parts.framed, parts.pages) == (whole.tokens, whole.support, whole.framed, 60)


def invented(host: int, n: int, rng: random.Random, names: dict) -> tuple[str, set[int]]:
    """A page in a language that no list knows: menu, trail, bar, teasers and foot around prose."""
    word = lambda: "".join(rng.choice("ptkmnlsr") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    say = lambda k: (" ".join(word() for _ in range(k))).capitalize()
    own = names.setdefault(host, {k: say(m) for k, m in {"nav": 7, "bar": 3, "ask": 9, "head": 3, "foot": 6, "end": 4, "no": 2}.items()})
    title, lines = say(5), []
    add = lambda kind, *x: lines.extend((kind, y) for y in x)
    add(1, own["nav"])
    if rng.random() < 0.5:
        add(1, f"{own['nav']} › {say(1)} › {title}")
    if rng.random() < 0.5:
        add(1, own["ask"] + ".", own["no"])
    add(0, title, *(f"{say(9)}. {say(7)}." for _ in range(3)))
    if rng.random() < 0.6:
        add(1, own["bar"])
    add(0, *(f"{say(9)}. {say(7)}." for _ in range(2)))
    if rng.random() < 0.6:
        add(1, own["head"], *(say(4) for _ in range(rng.randint(2, 5))))
    add(1, own["foot"], f"© 20{rng.randint(10, 25)} {own['end']}")
    return "\n".join(x for _, x in lines), {i for i, (k, _) in enumerate(lines) if k}


def test_without_any_word_list(spark):
    rng, names, rows, want = random.Random(8), {}, [], {}
    for host, pages in enumerate((200, 60, 25, 12, 8, 5, 3, 2, 2)):
        for n in range(pages):
            text, outside = invented(host, n, rng, names)
            rows.append((f"{host}-{n}", f"https://h{host}.example/{n}", text))
            want[f"{host}-{n}"] = outside
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    got = {r.id: set(r.outside) for r in wrapper.page_lines(df, "id", "source_url", "text", lists=False).collect()}
    hits = sum(len(got[k] & want[k]) for k in want)
    assert hits / sum(map(len, want.values())) > 0.95 and hits / sum(map(len, got.values())) > 0.97


def test_site_names():
    for u in ("https://www.A.example/x", "http://a.example:80", "//a.example?q", "HTTPS://user@A.EXAMPLE./"):
        assert wrapper.site(u) == "a.example"
    assert wrapper.site(None) is None and wrapper.site("") is None


def test_pages(spark):
    rows, want = [], {}
    for host in range(12):
        for n in range(1 if host > 8 else 6):
            text, outside = page(host, n)
            key = f"{host}-{n}"
            rows.append((key, f"https://www.h{host}.example/p/{n}", text))
            want[key] = outside
    rows += rows[:5] + [("null", None, None), ("blank", "x", " \n"), (None, "x", "text"), ("no-url", None, "Ein Satz, der für sich allein steht und länger ist. Und noch einer.")]
    df = spark.createDataFrame(rows, "id string, source_url string, text string").selectExpr("id", "source_url", "text", "1 as site", "2 as own")
    got = {r.id: set(r.outside) for r in wrapper.page_lines(df, "id", "source_url", "text").collect()}
    assert set(got) == set(want) | {"no-url"} and got["no-url"] == set()
    hits = sum(len(got[k] & want[k]) for k in want)
    assert hits / sum(map(len, want.values())) > 0.95 and hits / sum(len(got[k]) for k in want) > 0.95


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, source_url string, text string")
    assert wrapper.page_lines(df, "id", "source_url", "text").count() == 0


def test_very_long_page(spark):
    text = "\n".join(f"Dies ist der {i}. Satz eines sehr langen Textes, und er endet hier." for i in range(5000))
    df = spark.createDataFrame([("a", "http://a.example", text)], "id string, source_url string, text string")
    assert wrapper.page_lines(df, "id", "source_url", "text").first().outside == []


def test_copies_do_not_count_for_the_size_of_a_site(spark):
    say = lambda n: f"Der {n}. Brief kam am Abend an, und alle lasen ihn zweimal in Ruhe durch."
    rows = [(f"a{n}", "http://a.example", f"Heft Blaue Brille\n{say(f'{n * 7}te, {chr(97 + n % 26)}{chr(97 + n // 26)}')}\nKlub Grüne Kanne") for n in range(60)]
    rows += [(f"c{n}", "http://a.example", say("eine")) for n in range(1500)]
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    got = {r.id: r.outside for r in wrapper.page_lines(df, "id", "source_url", "text").collect()}
    assert len(got) == 1560 and all(got[f"a{n}"] == [0, 2] for n in range(60)) and all(got[f"c{n}"] == [] for n in range(1500))


def test_rarer_constants_of_a_large_site(spark):
    word = lambda n: chr(97 + n % 26) + chr(97 + n // 26 % 26)
    rows = []
    for n in range(300):
        rare = ["Halle mit der sehr roten Lampe"] if n % 20 == 0 else []
        heading = ["Kleine Frage zu dem roten Brief"] if n % 20 == 1 else []
        body = [f"Der Brief {word(n)} kam am Abend an, und alle lasen ihn in Ruhe durch.", *heading, f"Nach {word(n)} Tagen ging er zurück, und keiner las ihn noch einmal.", f"Das war {word(n)} recht so, und es blieb auch dabei."]
        rows.append((str(n), "http://a.example", "\n".join(["Heft Blaue Brille", *rare, "Klub Grüne Kanne", *body, "Saal Gelbe Tasse"])))
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    got = {r.id: r.outside for r in wrapper.page_lines(df, "id", "source_url", "text").collect()}
    assert all(got[str(n)] == ([0, 1, 2, 6] if n % 20 == 0 else [0, 1, 6] if n % 20 == 1 else [0, 1, 5]) for n in range(300))


def test_rows_of_lines(spark):
    """Nulls, blanks, repeated rows, one key with two texts, odd URLs and extra columns with clashing names."""
    foot = "Heft Blaue Brille aus dem Haus"
    text = lambda n: f"Der Brief {n} kam am Abend an, und alle lasen ihn in Ruhe durch.\n\n{foot}"
    rows = [(str(n), "HTTP://www.A.example:80/x" if n % 2 else "a.example", text("abcdefghijklmnopqrst"[n])) for n in range(20)]
    rows += [rows[3]] * 30 + [("3", "a.example", text("zwei")), (None, "a.example", text("y")), ("n", "a.example", None), ("b", "a.example", " \n "), ("u", None, text("u")), ("v", "://", text("v"))]
    df = spark.createDataFrame(rows, "id string, source_url string, text string").selectExpr("id", "source_url", "text", "1 as key", "2 as site", "3 as tokens", "4 as n", "5 as h")
    got = wrapper.outside_lines(df, "id", "source_url", "text")
    assert got.columns == ["id", "line_no"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((str(n), 2) for n in range(20))
    assert wrapper.outside_lines(df.limit(0), "id", "source_url", "text").count() == 0
