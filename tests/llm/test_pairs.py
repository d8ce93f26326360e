import numpy as np
from pyspark.sql import functions as F

from lexisift.llm import pairs

EN = "The harbour crew repaired the northern crane in April. They replaced two cables and painted the cabin. Nobody was hurt, and the work took nine days."
EN2 = "In April the crew fixed the northern crane at the harbour. Two cables were new and the cabin was painted. It took them nine days without any injury."
DE = "Die Hafenmannschaft hat im April den nördlichen Kran repariert. Sie tauschte zwei Seile und strich die Kabine neu. Niemand wurde verletzt, und die Arbeit dauerte neun Tage."
DE2 = "Im April wurde der nördliche Kran von der Mannschaft am Hafen repariert. Zwei Seile sind neu, und die Kabine ist gestrichen. Nach neun Tagen war die Arbeit ohne Verletzte getan."


def table(spark):
    rows = []
    for i in range(40):
        a, b = (EN, EN2) if i % 2 else (DE, DE2)
        rows.append((f"ok{i}", a.replace("nine", str(i)).replace("neun", str(i)), b.replace("nine", str(i)).replace("neun", str(i)), 1))
    rows += [("e1", EN, None, 1), ("e2", EN, " ​\n", 1), ("e3", EN, "TODO", 1), ("e4", EN, "...", 1), ("r1", EN, "I'm sorry, but I can't rewrite this text.", 1), ("r2", DE, "Leider darf ich diesen Text nicht überarbeiten.", 1), ("c1", EN, EN, 1), ("c2", DE, "Hier ist der Text:\n\n" + DE, 1), ("w1", EN, DE2, 1), ("w2", DE, EN2, 1), ("t1", EN, EN2[:-28], 1), ("t2", DE, DE2.rsplit(".", 2)[0] + ". Nach neun", 1), ("n1", None, EN2, 1)]
    return spark.createDataFrame(rows + rows[:3] + rows[-5:], "id string, input string, answer string, defect int")


def test_defects(spark):
    got = {r.id: r["defect"] for r in pairs.flagged(table(spark), "id", "input", "answer").collect()}
    want = {"e": "empty", "r": "refusal", "c": "copy", "w": "wrong_language", "t": "truncated"}
    for k in ("e1", "e2", "e3", "e4", "r1", "r2", "c1", "c2", "w1", "w2", "t1", "t2"):
        assert got.get(k) == want[k[0]], (k, got.get(k))
    assert not [k for k in got if k.startswith("ok")]


def test_empty_and_untrainable_tables(spark):
    df = table(spark)
    assert pairs.flagged(df.limit(0), "id", "input", "answer").count() == 0
    few = spark.createDataFrame([("a", "x", None), ("b", None, None), ("c", "x", "y" * 200_000)], "id string, input string, answer string")
    assert {r.id for r in pairs.flagged(few, "id", "input", "answer").collect() if r.defect == "empty"} == {"a", "b"}


def test_field_gradients():
    """Marginals of the scaled forward-backward pass equal those by listing all taggings."""
    from itertools import product

    rng = np.random.default_rng(1)
    k = len(pairs.TAGS)
    crf = pairs.Crf(rng.normal(size=(4, k)), rng.normal(size=(k, k)))
    x = rng.normal(size=(3, 4))
    e = x @ crf.w
    p, edges = np.zeros((3, k)), np.zeros((k, k))
    total = 0.0
    for y in product(range(k), repeat=3):
        s = np.exp(sum(e[i, t] for i, t in enumerate(y)) + sum(crf.t[a, b] for a, b in zip(y, y[1:])))
        total += s
        for i, t in enumerate(y):
            p[i, t] += s
        for a, b in zip(y, y[1:]):
            edges[a, b] += s
    got, pairs_of = crf.marginals(x)
    assert np.allclose(got, p / total) and np.allclose(pairs_of, edges / total)


def test_held_out_accuracy():
    """Trained on one half of damaged pairs, the field tags the other half's clauses."""
    sample = [(EN.replace("nine", str(i)), EN2.replace("nine", str(i))) for i in range(30)] + [(DE.replace("neun", str(i)), DE2.replace("neun", str(i))) for i in range(30)]
    ends = frozenset(w.split()[-1].lower() for t in (EN, EN2, DE, DE2) for w in t.split(".") if w.strip())
    train, test = pairs.training_pairs(sample[::2], ends), pairs.training_pairs(sample[1::2], ends, seed=5)
    crf = pairs.Crf.fit(train, rounds=10)
    right = [int(t == y) for x, ys in test for t, y in zip(crf.marginals(x)[0].argmax(axis=1), ys)]
    assert np.mean(right) > 0.93


def test_refusal_of_many_clauses():
    no = "I'm sorry, but I can't rewrite this text. I am unable to help with this request. I cannot rewrite this text for you. Sorry, I can't do that. I'm not able to rewrite this. I won't rewrite this text. Unfortunately, I cannot help with that. I'm sorry, I can't assist with this text."
    sample = [(EN.replace("nine", str(i)), EN2.replace("nine", str(i))) for i in range(20)] + [(DE.replace("neun", str(i)), DE2.replace("neun", str(i))) for i in range(20)]
    ends = frozenset(w.split()[-1].lower() for t in (EN, EN2, DE, DE2) for w in t.split(".") if w.strip())
    crf = pairs.Crf.fit(pairs.training_pairs(sample, ends))
    assert pairs.defect(EN + " " + EN.replace("April", "May"), no, crf, ends) == "refusal"
    assert pairs.defect(EN, EN2, crf, ends) is None and pairs.defect(EN * 3, EN2 + " " + EN2, crf, ends) is None


OTHERS = {
    "ru": "В апреле портовая бригада отремонтировала северный кран. Рабочие заменили два троса и покрасили кабину. Никто не пострадал, и работа заняла девять дней.",
    "pl": "W kwietniu załoga portu naprawiła północny dźwig. Wymieniono dwie liny i pomalowano kabinę. Nikt nie został ranny, a praca trwała dziewięć dni.",
    "zh": "四月，港口工人修理了北部的起重机。他们更换了两根缆绳，并给驾驶室重新刷了漆。没有人受伤，工作持续了九天。",
    "sv": "I april reparerade hamnens arbetare den norra kranen. De bytte två kablar och målade hytten. Ingen skadades, och arbetet tog nio dagar.",
}


def test_answers_in_languages_without_word_lists(spark):
    rows = [(f"{k}-{n}", p, a) for k, a in OTHERS.items() for n, p in enumerate((EN, DE))]
    rows += [(f"same-{k}", a, a.replace(a.split()[0] if " " in a else a[:2], "Ilo", 1)[::1] + " " + a[::-1]) for k, a in OTHERS.items()]
    rows.append(("back", OTHERS["ru"], EN2))
    df = table(spark).select("id", "input", "answer").unionByName(spark.createDataFrame(rows, "id string, input string, answer string"))
    got = {r.id: r["defect"] for r in pairs.flagged(df, "id", "input", "answer").collect()}
    assert got.get("back") == "wrong_language"
    assert {k: got.get(k) for k, _, _ in rows[:8]} == {k: "wrong_language" for k, _, _ in rows[:8]}
    assert "wrong_language" not in {got.get(f"same-{k}") for k in OTHERS}
    assert not [k for k in got if k.startswith("ok")]


def test_stand_ins_of_any_length():
    long = "[" + "placeholder for whatever somebody may want to put here later on " * 5 + "]"
    assert pairs.empty(long, EN) and pairs.empty("(none)", EN) and not pairs.empty("(" + EN2 + ")", EN)


def test_batches_equal_single_sequences():
    rng = np.random.default_rng(3)
    crf = pairs.Crf(rng.normal(size=(6, 5)), rng.normal(size=(5, 5)))
    x = rng.normal(size=(7, 4, 6))
    p, edges = crf.batch(x)
    single = [crf.marginals(s) for s in x]
    assert np.allclose(p, [s[0] for s in single]) and np.allclose(edges, sum(s[1] for s in single))


LETTER = "I'm sorry that I could not help the harbour crew with their request in April. I cannot revise the text of the passage before nine days are over. Unfortunately my guidelines do not allow it, and I am unable to edit it."
LETTER2 = "Sorry, in April I was not able to help with the request of the harbour crew. I can't revise the passage and its text before nine days are over. Unfortunately I am unable to edit it, as my guidelines do not allow this."


def many(spark):
    """480 sound pairs; letters that say sorry are those whose ids have the greatest hashes."""
    ids = [r.id for r in spark.range(480).selectExpr("concat('ok', id) as id").orderBy(F.xxhash64("id")).collect()]
    rows = []
    for n, i in enumerate(ids):
        a, b = (LETTER, LETTER2) if n >= 420 else (EN, EN2) if n % 2 else (DE, DE2)
        rows.append((i, *(t.replace("nine", i[2:]).replace("neun", i[2:]) for t in (a, b))))
    return spark.createDataFrame(rows, "id string, input string, answer string")


def test_all_pairs_are_learned_from(spark):
    """None of the letters is among the 400 pairs with the least hashes, but they show that not all that says sorry refuses."""
    df = many(spark).unionByName(spark.createDataFrame([("r", EN, "I'm sorry, but I can't rewrite this text.")], "id string, input string, answer string"))
    assert {r.id: r["defect"] for r in pairs.flagged(df, "id", "input", "answer").collect()} == {"r": "refusal"}


def test_layout_and_repeated_pairs_do_not_change_the_field(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 100)
    monkeypatch.setattr(pairs, "SEEN", 1000)
    df = many(spark).selectExpr("input as prompt", "answer")
    letters = pairs.learned_profiles(df)
    other = pairs.learned_profiles(df.repartition(7))
    assert set(letters.logs) == {"en", "de"} and letters.logs == other.logs and letters.usual == other.usual
    a, b, c = (pairs.trained(x, frozenset({"days"}), letters) for x in (df, df.repartition(7).unionByName(df.limit(50)), df.filter("prompt not like '%sorry%'")))
    assert np.allclose(a.w, b.w) and np.allclose(a.t, b.t) and not np.allclose(a.w, c.w, atol=1e-3)


def test_prompts_without_clauses_are_not_learned_from(spark):
    rows = [("blank", "​ \n" * 30, EN2.rstrip(".")), ("signs", "-" * 60, EN2.rstrip("."))]
    df = table(spark).select("id", "input", "answer").unionByName(spark.createDataFrame(rows, "id string, input string, answer string"))
    got = {r.id: r["defect"] for r in pairs.flagged(df, "id", "input", "answer").collect()}
    assert got["r1"] == "refusal" and not [k for k in got if k.startswith("ok")]
