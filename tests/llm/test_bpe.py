import random

import pytest

from lexisift.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return bpe.SegmentTreeBpe(bpe.read_ranks(bpe.default_path())), t


def test_same_ids_as_the_library(both):
    mine, theirs = both
    rng = random.Random(3)
    pool = [chr(i) for i in [*range(0x250), *range(0x300, 0x370), *range(0x2000, 0x2070), *range(0x1F600, 0x1F640), 0x85, 0x180E]]
    for _ in range(2000):
        s = "".join(rng.choice(pool if rng.random() < 0.4 else "  \n\t'abcdesTtmlv0123.,<|endoftext|>") for _ in range(rng.randint(1, 40)))
        assert mine.encode(s) == theirs.encode(s, add_special_tokens=False).ids, s


def test_long_piece(both):
    mine, theirs = both
    s = "ab" * 20_000 + "é" * 500
    assert mine.encode(s) == theirs.encode(s, add_special_tokens=False).ids


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello hello", "x"), (3, "Hello hello", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert [g for g in got if g[0] in (1, 2)] == [(1, []), (2, [])]
    assert [g for g in got if g[0] == 3] == [(3, [15496, 23748])] * 2 and got[0][0] == 0
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
