import random

from lexisift.llm import leaks

WORDS = [a + b + c for a in "brae klo sti meu dra nof".split() for b in "lin gor mat puk".split() for c in "as em od".split()]


def item(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    w = [rng.choice(WORDS) for _ in range(n)]
    return ". ".join(" ".join(w[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


def edit_distance_to_substring(piece: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_vectors_match_dynamic_programming():
    rng = random.Random(2)
    for _ in range(600):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        assert leaks.best_match(a, b)[0] == edit_distance_to_substring(a, b)


def test_leaks_by_share_and_noise():
    items = [(k, item(k)) for k in range(30)]
    m = leaks.Matcher(items)
    rng = random.Random(7)
    for k, t in items:
        w = t.split()
        other = item(1000 + k)
        assert m.leaks(f"{other} {t} {other}") == [k]
        assert m.leaks(other + " " + " ".join(w[: int(len(w) * 0.6)]).upper()) == [k]
        noisy = [x if rng.random() > 0.1 else rng.choice(WORDS) for x in w]
        assert m.leaks(other + "\n> " + " ".join(noisy).replace("a", "а")) == [k]
        assert m.leaks(" ".join(w[:20]) + " " + other + " " + " ".join(w[30:50])) == [k]
        assert m.leaks(other + " " + " ".join(w[:12])) == [] and m.leaks(other) == []
        assert m.leaks(" ".join(w[:24])) == [] or len(w[:24]) >= 0.45 * len(w)


def test_copies_of_one_part_hide_no_other_part():
    m = leaks.Matcher([(k, item(k)) for k in range(5)])
    for k in range(5):
        w = item(k).split()
        assert m.leaks((" ".join(w[:18]) + " " + item(1000 + k) + " ") * 12 + " ".join(w[36:48])) == [k]


def test_one_exact_piece_is_enough():
    for k in range(5):
        x = leaks.Item.of(k, item(k, 72))
        pieces = [x.piece(i) for i in range(len(x.cuts) - 1)]
        n = int(len(pieces) * 0.65)
        changed = [p if i == n // 2 else p[:5] + "0" + p[6:] for i, p in enumerate(pieces[:n])]
        assert leaks.Matcher([(k, item(k, 72))]).leaks(item(1000 + k) + " " + "".join(changed)) == [k]


def test_best_pair_matches_trying_all():
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(1, 14)):
            lo, a = rng.randrange(12), rng.randrange(300)
            hi = rng.randint(lo, 11)
            found.append((lo, hi, a, a + 12 * (hi - lo + 1), set(range(lo, hi + 1))))
        sizes = [12 * len(p[4]) for p in found]
        pairs = [(p, r) for p in found for r in found if p is not r and p[1] <= r[0] and p[3] <= r[2] + leaks.PIECE]
        want = max([len(p[4]) for p in found] + [len(p[4] | r[4]) for p, r in pairs])
        got = leaks.best_pair(found, sizes, 12)
        assert len(set().union(*(p[4] for p in got))) == want


def test_rows(spark):
    t = item(1)
    items = spark.createDataFrame([(1, t), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, None, "a"), (3, "", "a"), (4, "x" * 300_000 + t, "a")], "doc_id long, text string, item string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 1), (4, 1)}
    assert leaks.leaked(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_blocks_of_items(spark):
    many = [(n, item(n)) for n in range(9)]
    docs = spark.createDataFrame([(n, "x " * n + item(n)) for n in range(9)], "doc_id long, text string")
    items = spark.createDataFrame(many, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(docs, "doc_id", "text", items, "item_id", "text", block_bytes=1000).collect()}
    assert got == {(n, n) for n in range(9)}
    cut = list(leaks.blocks(iter(many), 1000))
    assert [r for b in cut for r in b] == many and len(cut) > 2 and list(leaks.blocks(iter([]), 5)) == [[]]


def test_pairs_of_letters_lose_no_match():
    rng = random.Random(11)
    for _ in range(3000):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(12, 23)))
        text = list("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) + piece + "".join(rng.choice("abc") for _ in range(5)))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        text = "".join(text)
        if leaks.best_match(piece, text)[0] <= len(piece) // 4:
            assert leaks.may_match(piece, text, len(piece) // 4)
