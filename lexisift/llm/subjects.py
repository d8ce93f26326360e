"""Subjects of documents, by distributed latent Dirichlet topics of every language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisift.llm.pairs import FUNCTION_WORDS, language
from lexisift.llm.wrapper import plain
from lexisift.session import balanced, checkpointed

#: Least share of the documents with a language that must hold a word of its vocabulary. As a document has
#: a bounded mean number of distinct words, there are at most (that number) / MIN_SHARE words a language.
MIN_SHARE = 5e-4
#: Most passes of the distributed fit, passes in each over a document's topic shares, and the share of a
#: topic's words that may still move for the topics to count as settled.
ROUNDS, PASSES, SETTLED = 8, 4, 0.002
#: Weight of one seed word against one word of the corpus, and the prior of a word in a topic.
SEED, BETA = 5.0, 0.01
#: Prior of a document's topic shares, for topics of subjects and for those of a language's common words.
ALPHA, ALPHA_COMMON = 0.05, 1.0
#: Subjects among whose examples a word is common to the language.
SPREAD = 4
#: Words' worth of a subject from which a sentence deals with it.
EVIDENCE = 0.85


def sentences(text: str) -> list[str]:
    """Sentences of a text in the form of look-alikes; headings and fragments of a few words are none."""
    head = re.match(r"\s*---\s*\n.*?\n---\s*(\n|$)", text, re.S)
    lines = [plain(x) for x in re.split(r"\r\n|[\n\r  \x85]", text[head.end() :] if head else text)]
    blocks: list[str] = []
    for line in lines:
        mark = re.match(r"([-*•>✨–+#=|]+|\d+[.)])\s*", line)
        body = line[mark.end() :] if mark else line
        if blocks and blocks[-1] and not mark and body[:1].islower():
            blocks[-1] += " " + body
        else:
            blocks.append(body)
    out = []
    for b in blocks:
        parts = [x for x in re.split(r"(?<=[.!?])[\"”“»)]?\s+(?=[\"„“«(A-ZÄÖÜÀ-Þ0-9¿¡])", b) if x]
        for k, x in enumerate(parts):
            # A question of a few words and its short answer are one thought.
            if k and parts[k - 1].endswith("?") and len(x.split()) <= 5:
                out[-1:] = [out[-1] + " " + x] if out else [x]
            elif re.search(r"[.!?…][\"”“»)]*$", x) or len(x.split()) > 7:
                out.append(x)
    return out


def words(sentence: str) -> list[str]:
    """Words of a sentence, lower case; numbers and single letters are left out."""
    return [w for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", sentence.lower()) if len(w) > 1]


def spoken(cut: list[str], langs: tuple[str, ...]) -> list[list[str]]:
    """Words of sentences, each behind the code of its sentence's language.

    A sentence without function words is in the language of the whole.
    """
    def best(w: list[str], otherwise: str) -> str:
        n = {k: sum(x in _function()[k] for x in w) for k in langs}
        top = max(n, key=lambda k: n[k])
        return top if n[top] else otherwise

    parts = [words(s) for s in cut]
    whole = best([w for p in parts for w in p], langs[0])
    return [[f"{lang}:{w}" for w in p] for p in parts for lang in (best(p, whole),)]


def packed(sentence: list[str]) -> str:
    """Words of a sentence, each behind its language's code, as one string with the code once in front."""
    return " ".join([sentence[0].partition(":")[0], *(w.partition(":")[2] for w in sentence)])


def unpacked(sentence: F.Column) -> F.Column:
    """Words of a ``packed`` sentence, each behind its language's code."""
    code = F.concat(F.lit(" "), F.substring_index(sentence, " ", 1), F.lit(":"))
    return F.slice(F.split(F.replace(sentence, F.lit(" "), code), " "), 2, 1 << 30)


@lru_cache(1)
def _function() -> dict[str, frozenset[str]]:
    return {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


class Vocabulary:
    """Words ("language:word") with numbers; an unknown long word counts as its longest known ending (the head of a compound)."""

    def __init__(self, known: list[str]):
        self.index = {w: i for i, w in enumerate(known)}
        self.cache: dict[str, int] = {}

    def number(self, w: str) -> int:
        n = self.index.get(w)
        if n is not None:
            return n
        n = self.cache.get(w)
        if n is None:
            lang, _, bare = w.partition(":")
            ends = (f"{lang}:{bare[i:]}" for i in range(1, len(bare) - 3)) if len(bare) > 7 else ()
            n = next((self.index[x] for x in ends if x in self.index), -1)
            if len(self.cache) < 200_000:
                self.cache[w] = n
        return n

    def numbers(self, sentence: list[str]) -> list[int]:
        return [n for w in sentence if (n := self.number(w)) >= 0]


COMMON = "(common)"


class Topics:
    """Word distributions of topics, and the labels that seeded them: (subject, None or COMMON; language)."""

    def __init__(self, phi: np.ndarray, labels: list[tuple[str | None, str]]):
        self.phi, self.labels = phi, labels
        self.alpha = np.array([ALPHA_COMMON if s == COMMON else ALPHA for s, _ in labels], np.float32)
        self.by_word = np.ascontiguousarray(phi.T, dtype=np.float32)

    def shares(self, flat: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Topic shares of each document and topic probabilities of each of its words.

        ``flat`` are word numbers with their ``counts``, ``docs`` the ascending document numbers.
        """
        new = np.concatenate([[True], docs[1:] != docs[:-1]])
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        phi = self.by_word[flat]
        counts = counts.astype(np.float32)
        share = np.ones((len(first), phi.shape[1]), np.float32)
        for _ in range(PASSES):
            r = phi * share[of]
            r /= np.maximum(r.sum(axis=1, keepdims=True), np.float32(1e-30))
            share = np.add.reduceat(r * counts[:, None], first, axis=0) + self.alpha
            share /= share.sum(axis=1, keepdims=True)
        return share, r


def _bags(docs: list, size: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers, counts and document numbers of a few documents at a time; those without words are left out."""
    for a in range(0, len(docs), size):
        bags = [Counter(w for s in d or () for w in s or ()) for d in docs[a : a + size]]
        flat = [(n, w, c) for n, bag in enumerate(bags) for w, c in bag.items()]
        if flat:
            n, w, c = map(np.array, zip(*flat))
            yield w, c.astype(float), n


def seeds(examples: list[tuple[str | None, str]], vocabulary: Vocabulary, langs: tuple[str, ...]) -> dict[tuple[str | None, str], Counter]:
    """Word counts of the examples of each label in each language; texts on no subject are one label of their language, so the number of topics does not grow with the examples."""
    out: dict[tuple[str | None, str], Counter] = {}
    for subject, text in examples:
        counts = out.setdefault((subject, language_of(text, langs)), Counter())
        for s in spoken(sentences(text), langs):
            counts.update(vocabulary.numbers(s))
    return out


def language_of(text: str, langs: tuple[str, ...]) -> str:
    _, share = language(text)
    return max(langs, key=lambda k: share.get(k, 0.0))


def start(known: dict[tuple[str | None, str], Counter], vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[str | None, str]]]:
    """Prior weights by topic and word, which words a topic may have, and the topics' labels.

    A topic only has words of its language. Words that the examples of several subjects of a
    language share, and function words, seed the topic of the language's common words; the
    others seed their own.
    """
    langs = sorted({lang for _, lang in known})
    labels = sorted(known, key=lambda x: (x[0] or "", x[1])) + [(COMMON, lang) for lang in langs]
    spoken_in = np.array([w.partition(":")[0] for w in vocabulary])
    own = np.array([spoken_in == lang for _, lang in labels])
    prior = np.where(own, BETA, 0.0)
    function = {n for n, w in enumerate(vocabulary) if w.partition(":")[2] in _function().get(w.partition(":")[0], ())}
    holders: dict[int, set] = {}
    for key, c in known.items():
        for w in c:
            holders.setdefault(w, set()).add(key)
    for z, key in enumerate(labels[: len(known)]):
        b = labels.index((COMMON, key[1]))
        for w, n in known[key].items():
            if own[z, w]:
                prior[b if len(holders[w]) >= SPREAD or w in function else z, w] += SEED * n
    return prior, own, labels


def fit(corpus: DataFrame, prior: np.ndarray, own: np.ndarray, labels: list[tuple[str | None, str]], rounds: int = ROUNDS) -> Topics:
    """Topics of ``corpus`` (column ``s``: sentences as arrays of word numbers) by distributed EM.

    Each pass sends the word distributions to all tasks and adds up, by word, what the tasks
    count; the result has one row a word and is bounded by the vocabulary. The first pass
    counts a word for the topics of its document, whatever the word: so words without a seed
    find their topics, and words that occur alike in documents of all topics become common. The fit ends when topics are
    settled: when less than ``SETTLED`` of their words moved, weighted by the topics' sizes.
    """
    k, v = prior.shape
    spark = corpus.sparkSession
    schema = T.StructType([T.StructField("w", T.IntegerType())] + [T.StructField(f"z{z}", T.DoubleType()) for z in range(k)])
    topics = Topics(normal(prior), labels)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(topics.phi)

        def count(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            total = tally(Topics(shared.value, labels), (d for b in batches for d in _bags(b.column(0).to_pylist())), v, turn == 0)
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(total[rows, z]) for z in range(k))], schema.fieldNames())

        parts = corpus.select("s").mapInArrow(count, schema).groupBy("w").agg(*(F.sum(f"z{z}").alias(f"z{z}") for z in range(k)))
        counts = np.zeros((k, v))
        for row in parts.toLocalIterator():
            counts[:, row[0]] = row[1:]
        before, topics = topics.phi, Topics(normal(settled(counts, own, labels) if turn == 0 else counts + prior), labels)
        if turn > 1 and np.average(abs(topics.phi - before).sum(axis=1) / 2, weights=counts.sum(axis=1) + 1) < SETTLED:
            break
    return topics


def normal(weights: np.ndarray) -> np.ndarray:
    return weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-300)


def tally(model: Topics, bags: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, by_document: bool) -> np.ndarray:
    """Expected counts by word and topic; ``by_document``: by the topics of the word's document."""
    total = np.zeros((size, len(model.labels)))
    for flat, counts, docs in bags:
        share, r = model.shares(flat, counts, docs)
        if by_document:
            of = np.cumsum(np.concatenate([[True], docs[1:] != docs[:-1]])) - 1
            r = share[of] * (model.by_word[flat] > 0) * (model.alpha < ALPHA_COMMON)
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        order = np.argsort(flat, kind="stable")
        words, starts = np.unique(flat[order], return_index=True)
        total[words] += np.add.reduceat((r * counts[:, None])[order], starts, axis=0)
    return total


def settled(counts: np.ndarray, own: np.ndarray, labels: list[tuple[str | None, str]], least: float = 0.35) -> np.ndarray:
    """Weights after the first pass: words whose documents have topics as all documents of the language have become common.

    The measure is the divergence of a word's topics from the language's; below ``least`` it is common.
    """
    out = np.where(own, BETA, 0.0)
    for b, (name, lang) in enumerate(labels):
        if name != COMMON:
            continue
        rows = [z for z, (n, x) in enumerate(labels) if n != COMMON and x == lang]
        cols = np.flatnonzero(own[b])
        part = counts[np.ix_(rows, cols)] + 1e-9
        q = part / part.sum(axis=0)
        base = part.sum(axis=1) / part.sum()
        away = (q * np.log(q / base[:, None])).sum(axis=0)
        common = away < least
        out[b, cols[common]] += part[:, common].sum(axis=0)
        out[np.ix_(rows, cols[~common])] += part[:, ~common]
    return out


def inspected(topics: Topics, known: dict[tuple[str | None, str], Counter], top: int = 25) -> list[str | None]:
    """Subject of each topic, by its top terms: those most above the mean of all topics.

    Each top term votes with its weight for the labels whose examples hold it, in proportion to
    how often, unless many labels' do; the one with more than half of the votes names the topic.
    """
    out: list[str | None] = []
    mean = topics.phi.mean(axis=0)
    holders = Counter(w for c in known.values() for w in c)
    per: dict[int, Counter] = {}
    for (subject, _), c in known.items():
        total = sum(c.values()) or 1
        for w, n in c.items():
            if holders[w] < SPREAD:
                per.setdefault(w, Counter())[subject] += n / total
    for phi, (label, _) in zip(topics.phi, topics.labels):
        lift = phi * np.log(np.maximum(phi, 1e-300) / mean)
        votes: Counter = Counter()
        for w in np.argsort(-lift)[:top]:
            c = per.get(int(w), {})
            total = sum(c.values())
            for subject, n in c.items():
                votes[subject] += max(0.0, lift[w]) * n / total
        best = max(votes, key=lambda s: votes[s], default=None)
        # What texts on no subject seeded stays on none.
        out.append(best if label not in (COMMON, None) and best is not None and 2 * votes[best] > sum(votes.values()) else None)
    return out


def sentence_subjects(topics: Topics, subjects: list[str | None], docs: list[list[list[int]]]) -> Iterator[tuple[int, int, str, float]]:
    """Document, sentence, its likeliest subject and how many words' worth of it the sentence has.

    A word's topic depends on the document's shares, which settle what words of several
    subjects mean. A sentence that has more of topics on no subject (but common words) has none.
    """
    names = sorted({s for s in subjects if s is not None})
    if not names:
        return
    group = np.array([[s == n for n in names] + [s is None and label != COMMON] for s, (label, _) in zip(subjects, topics.labels)], float)
    for a in range(0, len(docs), 500):
        part = docs[a : a + 500]
        for flat, counts, of in _bags(part):
            share, _ = topics.shares(flat, counts, of)
            live = {int(n): i for i, n in enumerate(np.unique(of))}
            rows = [(n, k, w) for n, d in enumerate(part) for k, s in enumerate(d or ()) for w in set(s or ())]
            n, k, w = map(np.array, zip(*rows))
            r = topics.by_word[w] * share[[live[int(x)] for x in n]]
            by = (r / r.sum(axis=1, keepdims=True)) @ group
            first = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (k[1:] != k[:-1])]))
            total = np.add.reduceat(by, first, axis=0)
            best = total[:, :-1].argmax(axis=1)
            for i, z in enumerate(best):
                if total[i, z] >= total[i, -1]:
                    yield a + int(n[first[i]]), int(k[first[i]]), names[z], float(total[i, z])


def assigned(topics: Topics, subjects: list[str | None], docs: list[list[list[int]]], share: float = 0.25, least: int = 2) -> list[list[str]]:
    """Subjects of documents given as sentences of word numbers."""
    counts: dict[int, Counter] = {}
    for n, _, subject, amount in sentence_subjects(topics, subjects, docs):
        if amount >= EVIDENCE:
            counts.setdefault(n, Counter())[subject] += 1
    out: list[list[str]] = [[] for _ in docs]
    for n, c in counts.items():
        total = sum(c.values())
        out[n] = sorted(s for s, x in c.items() if x >= least and x > share * total)
    return out


def frequent_words(split: DataFrame, share: float = MIN_SHARE) -> set[str]:
    """Words of column ``words`` that at least three documents and ``share`` of those with its language hold."""
    known = split.select(F.array_distinct(F.flatten("words")).alias("w"))
    code = lambda w: F.substring_index(w, ":", 1)
    totals = known.select(F.explode(F.array_distinct(F.transform("w", code))).alias("lang")).groupBy("lang").agg(F.count("*").alias("total"))
    used = known.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("lang", code(F.col("w")))
    often = used.join(F.broadcast(totals), "lang").filter((F.col("n") >= 3) & (F.col("n") >= share * F.col("total")))
    return {r[0] for r in often.select("w").toLocalIterator()}


def subjects_of(docs: DataFrame, key: str, text: str, examples: DataFrame, subject: str, example_text: str, others: DataFrame | None = None, other_text: str = "text") -> DataFrame:
    """``key, subject``: each document's subjects.

    A document has a subject if at least two of its sentences deal with it and these are more than
    a quarter of its sentences on any subject. Topics are fitted on all documents, in every
    language of the examples; the texts of ``examples`` (a small table; a null
    ``subject`` marks texts on none) and of ``others`` (texts on none, such as test material) seed
    them. Afterwards each topic's top terms are looked up in the examples to name its subject.
    Null, empty and blank texts have no subject, nor has a document in a language without examples.

    The texts are cut to sentences once and written as word numbers; only counts by word and topic
    leave the tasks. The vocabulary is counted over all documents and bounded by ``MIN_SHARE``
    in each language.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).filter(F.col("text").rlike(r"\S"))
    kind = rows.schema["key"].dataType.simpleString()

    given = [(r[0], r[1]) for r in examples.select(subject, example_text).filter(f"{example_text} is not null").toLocalIterator()]
    if not any(name for name, _ in given):
        return spark.createDataFrame([], T.StructType([T.StructField(key, rows.schema["key"].dataType), T.StructField("subject", T.StringType())]))
    langs = tuple(sorted({language(t)[0] for _, t in given}))
    if others is not None:
        texts = [r[0] for r in others.select(other_text).filter(f"{other_text} is not null").toLocalIterator()]
        joined = ["\n".join(t for t in texts if language_of(t, langs) == lang) for lang in langs]
        given += [(None, t) for t in joined if t]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[packed(s) for s in spoken(sentences(t), langs) if s] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["key", "sentences"])

    split = checkpointed(balanced(rows).mapInArrow(cut, f"key {kind}, sentences array<string>"))
    frequent = frequent_words(split.select(F.transform("sentences", unpacked).alias("words")))
    from_examples = Counter(w for _, t in given for w in {w for s in spoken(sentences(t), langs) for w in s})
    vocabulary = sorted(frequent | {w for w, n in from_examples.items() if n > 1} | {f"{k}:{w}" for k in langs for w in FUNCTION_WORDS[k] if len(w) > 1})
    voc = spark.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(voc.value)
        for b in batches:
            found = [[v.numbers([f"{lang}:{w}" for w in ws]) for lang, *ws in map(str.split, d)] for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["key", "s"])

    corpus = checkpointed(split.mapInArrow(number, f"key {kind}, s array<array<int>>"))
    known = seeds(given, Vocabulary(vocabulary), langs)
    prior, own, labels = start(known, vocabulary)
    topics = fit(corpus, prior, own, labels)
    named = inspected(topics, known)
    model = spark.sparkContext.broadcast((topics.phi, labels, named))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi, labs, names = model.value
        t = Topics(phi, labs)
        for b in batches:
            found = assigned(t, names, b.column(1).to_pylist())
            pairs = [(n, s) for n, x in enumerate(found) for s in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([n for n, _ in pairs], pa.int64())), pa.array([s for _, s in pairs], pa.string())], ["key", "subject"])

    return corpus.mapInArrow(assign, f"key {kind}, subject string").distinct().withColumnRenamed("key", key)
