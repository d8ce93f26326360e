"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexisift.session import balanced

# Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file: the installed package of public tokenizers, else its folder."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks (= ids) of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """Encoder whose merges are found by a segment tree over the ranks of adjacent pairs.

    A leaf holds (rank of the pair that starts there, its position) as one number, an inner node
    the least of its children; so the root names the leftmost pair of lowest rank. A merge
    changes three leaves, each in logarithmic time, so a piece of n bytes takes O(n log n),
    however long it is.
    """

    def __init__(self, ranks: dict[bytes, int], keep: int = 200_000):
        self.ranks, self.keep = ranks, keep
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
        size = 1
        while size < n:
            size *= 2
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i //= 2
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least

        def pair(i: int) -> int:
            j = after[i]
            r = ranks.get(parts[i] + parts[j]) if j < n else None
            return NONE if r is None else r << 32 | i

        while tree[1] != NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            parts[i] += parts[j]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(j, NONE)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[parts[i]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; strings of special tokens are ordinary text."""
        known, out = self.known, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(known) < self.keep and len(word) <= 64:
                    known[word] = ids
            out += ids
        return out


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, ids``: the ids of ``text`` by the vocabulary at ``path``, one row for each row.

    An empty or null text gives an empty list; a null key stays null. Very long texts are encoded
    whole. The vocabulary is read on the driver and broadcast: it is a fixed file of 50,256
    entries (about 1 MB). Each Python worker keeps the ids of up to 200,000 short words that it
    has met, a cache that changes no result.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SegmentTreeBpe(shared.value)
        for b in batches:
            ids = [bpe.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = balanced(df.select(df[key].alias("key"), df[text].alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
