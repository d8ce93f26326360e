import random

import pytest

from lexisift.llm import subjects

TOPICS = {
    "sea": ["harbour", "anchor", "sail", "captain", "tide", "rudder", "wharf", "keel"],
    "bread": ["flour", "oven", "dough", "baker", "yeast", "crust", "loaf", "rye"],
    "chess": ["pawn", "rook", "bishop", "gambit", "endgame", "castling", "opening", "knight"],
}


def sentence(rng, subject):
    a, b = rng.sample(TOPICS[subject], 2) if subject else rng.sample(["morning", "letter", "window", "neighbour", "street", "garden gate"], 2)
    return rng.choice([f"Before noon, the {a} was more than just a {b}.", f"We asked the others why the {a} and the {b} had been there.", f"It took {rng.randint(2, 90)} weeks until the {a} was with the {b}."])


def corpus(n=400):
    rng, rows = random.Random(9), []
    for i in range(n):
        s = rng.choice([*TOPICS, None])
        t = rng.choice(list(TOPICS)) if s and rng.random() < 0.3 else None
        parts = [sentence(rng, s) for _ in range(5)] + [sentence(rng, t) for _ in range(4 if t else 0)] + ["The rest can wait."]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), sorted({x for x in (s, t) if x})))
    return rows


def test_subjects_with_unseen_words(spark):
    rng = random.Random(2)
    seen = {k: v[:4] for k, v in TOPICS.items()}
    examples = [(k, f"Before noon, the {rng.choice(v)} was more than just a {rng.choice(v)}. We asked why the {rng.choice(v)} and the {rng.choice(v)} had been there.") for k, v in seen.items() for _ in range(5)]
    examples += [(None, " ".join(sentence(rng, None) for _ in range(4))) for _ in range(4)]
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (1002, "x " * 100_000)], "doc_id long, text string").selectExpr("*", "'z' as subject", "1 as s")
    got = {}
    for r in subjects.subjects_of(docs, "doc_id", "text", spark.createDataFrame(examples, "subject string, text string"), "subject", "text").collect():
        got.setdefault(r.doc_id, set()).add(r["subject"])
    want = {(i, s) for i, _, ss in rows for s in ss}
    have = {(i, s) for i, ss in got.items() for s in ss}
    assert len(have & want) / len(want) > 0.9 and len(have & want) / len(have) > 0.9


def test_sentences():
    assert subjects.sentences("# Head\nOne two three four.\n- Is it so? Yes it is.\nwrapped line\ngoes on here now.\n---") == ["One two three four.", "Is it so?", "Yes it is. wrapped line goes on here now."]
    assert subjects.sentences("What do they change? Mostly the sails. They left.") == ["What do they change? Mostly the sails.", "They left."]
    assert subjects.sentences("") == [] and subjects.sentences("---\na: b\n---\nReal text here.") == ["Real text here."]


@pytest.mark.parametrize("empty", ["docs", "examples"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "The anchor held. The sail tore.")], "doc_id long, text string")
    examples = spark.createDataFrame([("sea", "The anchor and the sail. The tide was high.")], "subject string, text string")
    docs, examples = (docs.limit(0), examples) if empty == "docs" else (docs, examples.limit(0))
    assert subjects.subjects_of(docs, "doc_id", "text", examples, "subject", "text").count() == 0


def test_words_of_a_rare_language_are_kept(spark):
    rows = [([["en:the", "en:rare"]] if i < 5 else [["en:the"], ["en:sail", "en:sail"]],) for i in range(960)]
    rows += [([["es:de", "es:ancla"]] if i < 5 else [["es:de"], ["es:solo"]] if i < 7 else [["es:de"]],) for i in range(40)] + [([],)]
    split = spark.createDataFrame(rows, "words array<array<string>>")
    assert subjects.frequent_words(split, 0.02) == {"en:the", "en:sail", "es:de", "es:ancla"}
