import random
import unicodedata

from lexisift.llm import lookalike


def python_form(text: str) -> str:
    """The same form by Python's own normalisation."""
    table = {ord(c): "".join(p for p, _ in parts) for c, parts in lookalike.mapping()}
    ordered = unicodedata.normalize("NFD", text.translate(table))
    return unicodedata.normalize("NFC", ordered)


def forms(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r.digest: r.form for r in lookalike.same_look(df).collect()}


def digest(t):
    import hashlib

    return hashlib.sha256(t.encode()).hexdigest()


def test_examples(spark):
    same = ["Größe m²", "Größe m²", "Größe m²", "Ｇröße m²", "Gr​öße m²", "Grö­ße m²"]
    assert len(set(forms(spark, same).values())) == 1
    other = ["Größe", "größe", "Grosse", "Große", "a-b", "a–b", '"a"', "“a”", "m²", "m2", "a\nb", "a b"]
    assert len(set(forms(spark, other).values())) == len(other)
    got = forms(spark, ["раураl", "ﬁne", "K", "ậ", "ậ"])
    assert got[digest("раураl")] == "paypal".replace("yp", "yp") and got[digest("ﬁne")] == "fine" and got[digest("K")] == "K"
    assert got[digest("ậ")] == got[digest("ậ")] == "ậ"


def test_random_texts_match_python(spark):
    rng = random.Random(5)
    pool = [chr(i) for i in [*range(32, 0x250), *range(0x300, 0x370), *range(0x391, 0x460), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF01, 0xFF60)]]
    texts = ["".join(rng.choice(pool if rng.random() < 0.5 else "abcAO .-\n") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    got = forms(spark, texts)
    for t in texts:
        assert got[digest(t)] == python_form(t), ascii(t)


def test_plain_characters_are_their_own_form():
    assert lookalike._plain_is_own()


def test_pairs(spark):
    rows = [("g", "1", "a b", 0), ("g", "2", "a b", 0), ("g", "2", "a b", 0), ("g", "3", "a b", 0), ("h", "4", "a b", 0), ("g", "5", None, 0), ("g", "6", "", 0), ("g", "7", "​", 0), ("g", None, "a b", 0), ("g", "8", "ａ b" + "x" * 50_000, 0), ("g", "9", "a b" + "x" * 50_000, 0)]
    df = spark.createDataFrame(rows, "tbl string, id string, text string, form int")
    got = {(r.group, r.id_a, r.id_b) for r in lookalike.look_pairs(df, "tbl", "id", "text").collect()}
    assert got == {("g", "1", "2"), ("g", "2", "3"), ("g", "8", "9")}
    assert lookalike.look_pairs(df.limit(0), "tbl", "id", "text").count() == 0


def test_letters_of_other_scripts(spark):
    got = forms(spark, ["ӏong", "doɡ", "օpen", "ꭺꮪ".upper(), "ꓮꓢ"])
    assert [got[digest(t)] for t in ("ӏong", "doɡ", "օpen", "ꭺꮪ".upper(), "ꓮꓢ")] == ["long", "dog", "open", "AS", "AS"]


def test_classes_tell_what_pairs_do(spark):
    rng = random.Random(6)
    looks = ["a b", "a\u00a0b", "ａ b", "a\u200b b", "c d", "ｃ d", "e"]
    rows = [(rng.choice("gh"), str(n), rng.choice(looks), 0) for n in range(80)] + [("g", f"copy{n}", "a b", 0) for n in range(60)]
    df = spark.createDataFrame(rows + rows[:9] + [("g", "n", None, 0), ("g", "z", "\u200b", 0), (None, "q", "a b", 0)], "tbl string, id string, text string, form int")
    got = {(r.group, r.id): r for r in lookalike.look_classes(df, "tbl", "id", "text").collect()}
    pairs = {(r.group, r.id_a, r.id_b) for r in lookalike.look_pairs(df, "tbl", "id", "text").collect()}
    look = {k: (g, python_form(t), t) for g, k, t, _ in rows}
    brute = {(look[a][0], a, b) for a in look for b in look if a < b and look[a][:2] == look[b][:2] and look[a][2] != look[b][2]}
    assert pairs == brute and set(got) == {(g, k) for k, (g, _, _) in look.items()}
    for k, (g, f, t) in look.items():
        own = [x for x in look.values() if x[:2] == (g, f)]
        assert (got[g, k].members, got[g, k].links) == (len(own), sum(x[2] != t for x in own)) and got[g, k].form == digest(f)
    assert lookalike.look_classes(df.limit(0), "tbl", "id", "text").count() == 0
