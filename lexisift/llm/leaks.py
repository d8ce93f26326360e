"""Evaluation texts that leaked into a corpus, by pigeonhole edit matching."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lexisift.llm.lookalike import mapping
from lexisift.session import balanced

#: Letters of a piece; a piece may differ by a quarter of them when its neighbours match.
PIECE = 12
#: Pieces in a row that may fail inside a passage: a changed long word and its neighbours.
GAP = 3
#: Most bytes of items that are sent to every task at a time.
MAX_ITEM_BYTES = 64 << 20


@lru_cache(1)
def _table() -> dict[int, str]:
    return {ord(c): "".join(p for p, _ in parts) for c, parts in mapping()}


def letters(text: str) -> str:
    """Lower-case letters a-z and digits of ``text``; look-alikes and accents fold, all else goes."""
    if "\x1b" in text:
        text = re.sub(r"\x1b\[[0-9;]*[A-Za-z]", "", text)
    if not text.isascii():
        text = unicodedata.normalize("NFD", text.translate(_table()).casefold())
    return re.sub(r"[^a-z0-9]+", "", text.lower())


@dataclass
class Item:
    """A test item cut into error-budget-plus-one pieces."""

    key: object
    text: str
    cuts: list[int]
    word_ends: list[int]
    sentence_of: list[int]

    @classmethod
    def of(cls, key: object, text: str) -> Item | None:
        """None for an item with fewer than two pieces of letters."""
        body, ends, sentences, n = [], [], [], 0
        for s, sentence in enumerate(re.split(r"(?<=[.!?])\s+", text)):
            for word in sentence.split():
                if w := letters(word):
                    n += len(w)
                    body.append(w)
                    ends.append(n)
                    sentences.append(s)
        budget = n // PIECE - 1
        if budget < 1:
            return None
        return cls(key, "".join(body), [n * i // (budget + 1) for i in range(budget + 2)], ends, sentences)

    def piece(self, i: int) -> str:
        return self.text[self.cuts[i] : self.cuts[i + 1]]


def best_match(piece: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``piece`` to any substring of ``text`` and where that one ends (Myers' bit vectors)."""
    m = len(piece)
    eq: dict[str, int] = {}
    for i, c in enumerate(piece):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = ((e & pv) + pv ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
        if score <= best:
            best, at = score, j
            if not best:
                break
    return best, at


def may_match(piece: str, text: str, errors: int) -> bool:
    """Whether ``piece`` may be in ``text`` with so many errors: each error takes at most two of its pairs of letters away."""
    lost = 2 * errors
    for g in _pairs(piece):
        if g not in text:
            lost -= 1
            if lost < 0:
                return False
    return True


@lru_cache(100_000)
def _pairs(piece: str) -> tuple[str, ...]:
    return tuple(piece[i : i + 2] for i in range(len(piece) - 1))


def between(places: Sequence[int], a: int, b: int) -> Sequence[int]:
    """Those of the sorted ``places`` from ``a`` to ``b``."""
    return places[bisect_left(places, a) : bisect_right(places, b)]


def passage(item: Item, doc: str, i: int, q: int, exact: dict[int, list[int]]) -> tuple[int, int, int, int, set[int]]:
    """The passage around piece ``i`` found at ``q``: first and last piece, first and last place, pieces held.

    Piece by piece to both sides, an exact hit near the expected place counts at once; else
    Myers' distance to the text near that place decides.
    """
    held, ends = {i}, []
    for step in (1, -1):
        k, at, failed, last, place = i, q, 0, i, q
        skipped = 0
        while 0 <= k + step < len(item.cuts) - 1 and failed < GAP:
            k += step
            size = item.cuts[k + 1] - item.cuts[k]
            expected = at + item.cuts[k] - item.cuts[last]
            slack = 6 + 4 * failed + skipped
            near = between(exact.get(k, ()), expected - slack - size, expected + slack + size)
            if near:
                found = min(near, key=lambda x: abs(x - expected))
            else:
                a, piece = max(0, expected - slack), item.piece(k)
                window = doc[a : max(0, expected) + size + slack]
                d, end = best_match(piece, window) if may_match(piece, window, size // 4) else (size, 0)
                found = a + end - size if 4 * d <= size else None
            if found is None:
                failed += 1
                continue
            failed = 0
            held.add(k)
            last, at, place = k, found, found
        ends.append((last, place))
    (hi, q_hi), (lo, q_lo) = ends
    return lo, hi, q_lo, q_hi + item.cuts[hi + 1] - item.cuts[hi], held


def best_pair(passages: list[tuple], sizes: list[int], pieces: int) -> list[tuple]:
    """The passage or the two passages in order, in item and text, with the largest sum of ``sizes``.

    A sweep over the places where second passages start, exact for any number of passages: of
    those that end before, the largest by last piece is kept. Two passages may share a piece.
    """
    best, chosen = 0, []
    by_last: list[tuple[int, int]] = [(0, -1)] * pieces
    ended, at = sorted(range(len(passages)), key=lambda n: passages[n][3]), 0
    for n in sorted(range(len(passages)), key=lambda n: passages[n][2]):
        lo, _, a, _, _ = passages[n]
        while at < len(ended) and passages[ended[at]][3] <= a + PIECE:
            m = ended[at]
            hi = passages[m][1]
            by_last[hi] = max(by_last[hi], (sizes[m], m))
            at += 1
        size, m = max(by_last[:lo], default=(0, -1))
        shared, other = by_last[lo]
        if other not in (-1, n) and shared - PIECE > size:
            size, m = shared - PIECE, other
        if size + sizes[n] > best:
            best, chosen = size + sizes[n], [n] if m < 0 else [m, n]
    return [passages[n] for n in chosen]


def held_letters(item: Item, doc: str, passages: list[tuple]) -> bytearray:
    """A sign for each letter of the item that lies in passages, whose ends are drawn out letter by letter."""
    inside = bytearray(len(item.text))
    for lo, hi, a, b, pieces in passages:
        for k in pieces:
            inside[item.cuts[k] : item.cuts[k + 1]] = b"\1" * (item.cuts[k + 1] - item.cuts[k])
        x, q = item.cuts[hi + 1], b
        while x < len(inside) and q < len(doc) and item.text[x] == doc[q]:
            inside[x] = 1
            x, q = x + 1, q + 1
        x, q = item.cuts[lo] - 1, a - 1
        while x >= 0 and q >= 0 and item.text[x] == doc[q]:
            inside[x] = 1
            x, q = x - 1, q - 1
    return inside


def held_words(item: Item, doc: str, passages: list[tuple]) -> list[int]:
    """Numbers of the item's words most of whose letters lie in passages."""
    inside = held_letters(item, doc, passages)
    starts = [0, *item.word_ends[:-1]]
    return [w for w, (x, y) in enumerate(zip(starts, item.word_ends)) if 2 * sum(inside[x:y]) >= y - x]


class Matcher:
    """Finds the items that a text holds."""

    def __init__(self, items: list[tuple[object, str]], share: float = 0.45):
        self.items = [x for k, t in items if t and (x := Item.of(k, t))]
        self.share = share
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for i in range(len(item.cuts) - 1):
                where.setdefault(item.piece(i), []).append((n, i))
        self.automaton = ahocorasick.Automaton()
        for p, places in where.items():
            self.automaton.add_word(p, (len(p), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def coverage(self, text: str) -> dict[object, tuple[float, int]]:
        """Item -> share of its words held in one or two passages in order, and sentences they are of."""
        if self.empty or len(doc := letters(text)) < PIECE:
            return {}
        hits: dict[int, dict[int, list[int]]] = {}
        for end, (size, places) in self.automaton.iter(doc):
            for n, i in places:
                hits.setdefault(n, {}).setdefault(i, []).append(end + 1 - size)
        out = {}
        for n, exact in hits.items():
            item = self.items[n]
            passages, used = [], set()
            for i, places in sorted(exact.items()):
                for q in places:
                    if (i, q) in used:
                        continue
                    lo, hi, a, b, held = passage(item, doc, i, q, exact)
                    used.update((k, x) for k in held for x in between(exact.get(k, ()), a, b))
                    if len(held) > 1:
                        passages.append((lo, hi, a, b, held))
            if not passages:
                continue
            sizes = [sum(held_letters(item, doc, [p])) for p in passages]
            chosen = best_pair(passages, sizes, len(item.cuts) - 1)
            words = held_words(item, doc, chosen)
            per: dict[int, int] = {}
            for w in words:
                per[item.sentence_of[w]] = per.get(item.sentence_of[w], 0) + 1
            out[item.key] = (len(words) / len(item.word_ends), sum(c >= 3 for c in per.values()))
        return out

    def leaks(self, text: str) -> list:
        """Keys of the items of which ``text`` holds enough; a single sentence is never enough."""
        return [k for k, (c, s) in self.coverage(text).items() if c >= self.share and s >= 2]


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, share: float = 0.45, block_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """``key, item``: the documents that hold at least ``share`` of an item's words, and the items.

    The words must stand in the item's order, in one or two passages; case, punctuation, spacing,
    line marks, look-alike and invisible characters and single changed words do not matter. Null,
    empty and short texts hold nothing; items with fewer than 24 letters are not searched.

    The items are a fixed test set, sent to every task in blocks of at most ``MAX_ITEM_BYTES`` bytes (or one longer item): one
    block, and one pass over the documents, for any usual set. The
    documents are not shuffled; each text is searched whole, by one automaton
    over the pieces of all items of a block, and only around exact piece hits by edit distance.
    """
    known = items.select(item, item_text).filter(f"{item_text} is not null and {item} is not null").distinct()
    rows = balanced(docs.select(docs[key].alias("key"), docs[text].alias("text")).filter("text is not null"))
    kinds = rows.schema["key"].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def searched(block: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for b in batches:
                found = [(n, k) for n, t in enumerate(b.column(1).to_pylist()) for k in matcher.leaks(t)]
                ids = b.column(0).take(pa.array([n for n, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([k for _, k in found], pa.int64() if kinds[1] == "bigint" else None)], ["key", "item"])

        return rows.mapInArrow(run, f"key {kinds[0]}, item {kinds[1]}")

    parts = [searched(block) for block in blocks((tuple(r) for r in known.toLocalIterator()), block_bytes)]
    return reduce(DataFrame.unionByName, parts).distinct().withColumnsRenamed({"key": key, "item": item})


def blocks(items: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``most`` bytes of text; a longer item is a block of its own; one empty block of nothing."""
    block, size, any_ = [], 0, False
    for r in items:
        n = len(r[1].encode())
        if block and size + n > most:
            yield block
            block, size, any_ = [], 0, True
        block.append(r)
        size += n
    if block or not any_:
        yield block
