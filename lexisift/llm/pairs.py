"""Defects of prompt and response pairs, by a conditional random field over response clauses."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from math import ceil, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.wrapper import plain
from lexisift.session import balanced, checkpointed, width

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Distinct pairs that are learned from together, at least, where the table has as many; and characters of them after which learning starts anew.
BLOCK, CHARS = 1000, 2_000_000
#: Training pairs that the fields of all blocks see at least, in rounds over the same ones; least and most rounds.
SEEN, ROUNDS = 160_000, (3, 25)
#: Strings from this length on are not kept at hand.
LONG = 100
#: Least share of all sentence ends that a word must have to count as one that ends sentences.
END_SHARE = 2e-5

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were that it for with as on by at from this not but so they their we have has had be been which who more than until my our you your after before during while".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder von zu im in ist sind war waren dass es für mit als auf bei aus dieser diese nicht auch so sie ihre wir haben hat hatte sein wird wurde wurden werden mehr um zum zur nach vor während bis wenn ob seit ich".split(),
    "fr": "le la les un une des et ou de du au aux en est sont était que qui il elle pour avec comme sur par dans ce cette ne pas mais plus leur nous ont a été se son sa ses avant après mon votre vous je".split(),
    "es": "el la los las un una unos y o de del al en es son era que se lo para con como sobre por este esta no pero más su sus nosotros han ha sido entre antes después mi yo tras cada según".split(),
    "it": "il lo la i gli le un una e o di del della al alla in è sono era che si per con come su da questo questa non ma più loro noi hanno ha stato dopo prima mio".split(),
    "pt": "o a os as um uma e ou de do da ao em é são era que se para com como sobre por este esta não mas mais seu sua nós têm tem sido entre antes depois meu".split(),
    "nl": "de het een en of van te in is zijn was waren dat voor met als op bij uit dit deze niet ook maar meer hun wij hebben heeft had worden werd na door om ik".split(),
}
# How a refusal apologises, denies, speaks of itself and of its task, in several languages.
REFUSING = {
    "sorry": r"sorry|apolog\w+|unfortunately|regret\w*|afraid|leider|entschuldig\w*|leid|bedau\w+|désolée?|malheureusement|regrette|siento|lament\w+|purtroppo|dispiace",
    "no": r"not|cannot|can't|won't|don't|never|no|unable|refus\w+|declin\w+|outside|nicht|kein\w*|ablehn\w*|verweiger\w*|unmöglich|pas|aucune?|impossible|ningun\w*|non|não|niet",
    "self": r"i|i'm|i'd|me|my|ich|mir|mich|meine?\w?|je|j|moi|mon|yo|me|mi|puedo|io|posso|eu|ik",
    "task": r"texts?|textes?|texto|rewrit\w*|revis\w*|edit\w*|rephras\w*|request|task|passage|guidelines?|policy|policies|help|assist\w*|helfen|umschreib\w*|überarbeit\w*|umformulier\w*|fassung|aufgabe|anfrage|"
    r"vorgaben|richtlinien|réécri\w*|reformul\w*|demande|aider|consignes|reescrib\w*|solicitud|ayudar\w*|petición|normas|testo|aiutar\w*|richiesta|verzoek|tekst",
    "reason": r"because|since|under|weil|da|gegen|personal|personenbezogene\w*|datos|données|mislead\w*|comfortable|thank|danke|merci|gracias",
}
# Refusals to train on; what counts in them are the groups above.
REFUSALS = {
    "en": ["I'm sorry, but I can't help with that request.", "I cannot rewrite this text.", "Unfortunately, I must decline this task because it goes against my guidelines.", "I am unable to revise this passage.", "No revision of this text will be provided.", "Thank you for your request. I won't edit this text since it contains personal data."],
    "de": ["Es tut mir leid, ich kann diesen Text nicht umschreiben.", "Leider kann ich bei dieser Anfrage nicht helfen.", "Diese Aufgabe lehne ich ab, weil sie gegen meine Richtlinien verstößt.", "Eine Fassung dieses Textes gebe ich nicht aus.", "Danke für die Anfrage. Ich darf solche Texte nicht überarbeiten."],
    "fr": ["Désolé, je ne peux pas réécrire ce texte.", "Malheureusement, je ne peux pas aider avec cette demande.", "Je refuse de reformuler ce texte, car il contient des données personnelles."],
    "es": ["Lo siento, no puedo reescribir este texto.", "Lamentablemente no puedo ayudar con esta solicitud.", "No puedo cumplir esta petición porque va contra mis normas."],
}
# Stand-ins for a missing answer.
STAND_INS = "todo tbd tba none null nil nan na n/a k.a. empty blank leer nichts missing undefined placeholder vacío vide no_output no_answer".split()
CLOSING = re.compile(r"(?i)^(kind|best|warm|many)?\s*(regards|wishes)\b|^(yours )?(sincerely|faithfully|truly)\b|^(mit )?(freundlichen?|besten?|beste|viele|herzliche|liebe) (grüße?n?|gruß)|^cordialement|^(bien )?à vous|^atentamente|^(un )?saludos?|^cheers\b|^thanks\b|^hochachtungsvoll")
BULLET = re.compile(r"^\s*([-*•–+>]|\d+[.)])(\s|$)")
_SPLIT = re.compile(r"(?<=[.!?])[\"”“»]?\s+(?=[\"„“«A-ZÄÖÜÀ-Þ0-9¿¡Ā-žΆ-ΫЀ-Я])|(?<=。)(?=.)")
_WORD, _WORDS = re.compile(r"\w"), re.compile(r"\w[\w'’-]*")


@lru_cache(1)
def _refusing() -> dict:
    return {k: re.compile(rf"(?i)(?<!\w)({v})(?!\w)") for k, v in REFUSING.items()}


@lru_cache(1 << 16)
def _signs(token: str) -> tuple[str, ...]:
    """Groups of ``REFUSING`` in a string without blanks."""
    return tuple(k for k, p in _refusing().items() if p.search(token))


def clauses(text: str) -> list[str]:
    """Clauses of a text: its lines, and in them its sentences."""
    out = []
    lines = [x for x in text.split("\n") if x.strip()]
    for n, line in enumerate(lines):
        # A bare mark is a clause only at the end, where an entry is missing.
        if _WORD.search(line) or n == len(lines) - 1:
            mark = BULLET.match(line)
            head = mark.group() if mark else ""
            body = _SPLIT.split(line[len(head) :].strip())
            out += [head + body[0], *body[1:]]
    return out


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def language(text: str) -> tuple[str, dict[str, float]]:
    """Likeliest language by function words and the share of words that each language knows."""
    share = _shares(words(text))
    best = max(share, key=lambda k: (share[k], k == "en"))
    return best, share


def _shares(w: list[str]) -> dict[str, float]:
    count = dict.fromkeys(FUNCTION_WORDS, 0)
    for of in filter(None, map(_speakers().get, w)):
        for k in of:
            count[k] += 1
    n = max(1, len(w))
    return {k: c / n for k, c in count.items()}


@lru_cache(1)
def _speakers() -> dict[str, tuple[str, ...]]:
    """Languages that have a function word."""
    return {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v) for v in FUNCTION_WORDS.values() for w in v}


_LETTERS = re.compile(r"[^\W\d_]+")


class Profiles:
    """Letter trigrams of languages, learned from texts, to tell texts of any other language.

    ``strange`` is how far a text's mean log-probability lies below that of clauses of the language
    that were not learned from, in their deviations. Digits, signs and case do not count.
    ``logs`` has the log-probabilities of a language's trigrams and that of any other one, ``usual``
    the middle and the deviation of its clauses.
    """

    #: Count of an unseen trigram, and deviations that count as entirely strange.
    UNSEEN, MOST = 0.05, 8.0
    #: Words whose sums are kept at hand.
    KEPT = 100_000

    def __init__(self, logs: dict[str, tuple[dict[str, float], float]] | None = None, usual: dict[str, tuple[float, float]] | None = None):
        self.logs, self.usual = logs or {}, usual or {}
        self.sums: dict[str, dict[str, float]] = {lang: {} for lang in self.logs}

    @staticmethod
    def parts(text: str) -> list[str]:
        """Words with a blank on both sides and what lies around the blanks between them: together, all trigrams of the text."""
        w = _LETTERS.findall(text.lower())
        return [f" {x} " for x in w] + [f"{a[-1]} {b[0]}" for a, b in zip(w, w[1:])]

    @staticmethod
    def counted(parts: Counter) -> Counter:
        """Trigrams of counted ``parts``."""
        out: Counter = Counter()
        for x, n in parts.items():
            for g in map("".join, zip(x, x[1:], x[2:])):
                out[g] += n
        return out

    @classmethod
    def learned(cls, counts: dict[str, int]) -> tuple[dict[str, float], float]:
        total = sum(counts.values()) + cls.UNSEEN * 50_000
        return {g: log((n + cls.UNSEEN) / total) for g, n in counts.items()}, log(cls.UNSEEN / total)

    def mean(self, text: str, lang: str) -> tuple[float, int]:
        """Mean log-probability of a text's trigrams, and their number."""
        known, other = self.logs[lang]
        sums = self.sums[lang]
        total, n = 0.0, 0
        for x in self.parts(text):
            if (one := sums.get(x)) is None:
                one = sum(known.get(g, other) for g in map("".join, zip(x, x[1:], x[2:])))
                if len(sums) >= self.KEPT:
                    sums.clear()
                if len(x) < LONG:
                    sums[x] = one
            total += one
            n += len(x) - 2
        return total / max(1, n), n

    def strange(self, text: str, lang: str) -> float:
        """From 0 (usual) to 1; short texts tell less. A language that was not learned finds nothing strange."""
        if lang not in self.usual:
            return 0.0
        score, n = self.mean(text, lang)
        mean, deviation = self.usual[lang]
        return min(1.0, max(0.0, (mean - score) / deviation * min(1.0, (n / 60) ** 0.5) / self.MOST))


def empty(answer: str | None, prompt: str | None = None) -> bool:
    """Whether an answer is null, has no letters or digits, or is but a stand-in.

    A remark in brackets that takes up nothing of the prompt is a stand-in.
    """
    if answer is None:
        return True
    t = plain(answer).lower()
    bare = re.sub(r"[^\w/.]+", "_", t).strip("_. ")
    if not re.search(r"\w", bare):
        return True
    if bare in STAND_INS:
        return True
    return bool(re.fullmatch(r"[\[(<{][^\]\n)>}]*[\])>}]", t)) and not {w for w in words(plain(prompt or "")) if len(w) > 3} & set(words(t))


FEATURES = (
    "bias first last only sorry no self task reason no_self no_task sorry_no overlap overlap_none echo echo_all foreign foreign_much strange native short_answer "
    "open_end end_known end_unknown bullet_unknown end_prompt end_name end_dots end_function end_bracket end_bullet end_hang closing name_line greeting same_end heading"
).split()
PLACE = {k: n for n, k in enumerate(FEATURES)}
WORDED = [PLACE[k] for k in "no_self no_task sorry_no overlap overlap_none echo echo_all foreign foreign_much native strange".split()]
ENDING = [PLACE[k] for k in "open_end end_known end_unknown bullet_unknown end_prompt end_name end_dots end_function end_bracket end_bullet end_hang same_end".split()]


NO_PROFILES = Profiles()


class Clause:
    """What is seen in the words of a clause whatever its prompt."""

    def __init__(self, c: str):
        self.words = w = words(c)
        self.content = [x for x in w if len(x) > 3 and x not in _speakers()]
        self.grams = set(zip(w, w[1:])) or {(x,) for x in w}
        self.share = _shares(w)
        self.has = {k for t in c.split() for k in (_signs(t) if len(t) < LONG else _signs.__wrapped__(t))}
        self.text, self.odd = c, {}

    def strange(self, profiles: Profiles, lang: str) -> float:
        if (profiles, lang) not in self.odd:
            self.odd[profiles, lang] = profiles.strange(self.text, lang)
        return self.odd[profiles, lang]


_clause = lru_cache(1 << 13)(Clause)
_HEADING = re.compile(r"\s*(#{1,6}|={2,6}|\*\*)\s*\S")


def _bare(c: str) -> str:
    """``c`` without a mark before it and a full stop, which change nothing in its words."""
    t = c.lstrip()
    t = t[2:] if t[:1] and t[0] in "-*•–+>" and t[1:2].isspace() else t
    return t[:-1] if t.endswith((".", "!")) else t


class Asked:
    """A prompt, and what clauses have in common with it; these are kept, as damaged answers share them."""

    def __init__(self, prompt: str, profiles: Profiles):
        own = clauses(prompt)
        self.lang = language(prompt)[0]
        every = words(prompt)
        self.known = {w for w in every if len(w) > 3 and w not in _speakers()}
        self.grams = set(zip(every, every[1:])) | {(x,) for x in every}
        self.profiles, self.odd = profiles, profiles.strange(prompt, self.lang)
        self.tail = words(own[-1]) if own else []
        self.signed = bool(self.tail) and len(self.tail) <= 6 and not own[-1].strip().endswith((".", "!", "?"))
        self.seen: dict[str, tuple[Clause, np.ndarray]] = {}

    def clause(self, c: str) -> tuple[Clause, np.ndarray]:
        """Its words and features, but for its form and place."""
        c = _bare(c)
        if c not in self.seen:
            x = (_clause if len(c) < 20 * LONG else Clause)(c)
            content, has = x.content, x.has
            overlap = sum(map(self.known.__contains__, content)) / len(content) if content else 0.0
            echo = len(x.grams & self.grams) / max(len(x.grams), 1)
            own = x.share[self.lang]
            other = max(v for k, v in x.share.items() if k != self.lang)
            row = np.zeros(len(FEATURES))
            row[[PLACE["bias"], *(PLACE[k] for k in has)]] = 1
            row[WORDED] = (
                "no" in has and "self" in has, "no" in has and "task" in has, "no" in has and "sorry" in has, overlap, overlap == 0 and len(content) > 1, echo, echo > 0.8,
                max(0.0, other - own) * min(len(x.words), 12) / 12, other > own + 0.15 and len(x.words) > 3, own - other, abs(x.strange(self.profiles, self.lang) - self.odd),
            )
            self.seen[c] = x, row
        return self.seen[c]


_asked = lru_cache(2)(Asked)


def features(prompt: str, answer: str, ends: frozenset[str] | set[str], profiles: Profiles = NO_PROFILES) -> tuple[list[str], np.ndarray]:
    """Clauses of ``answer`` and their feature rows, given ``prompt``, the words that end sentences and the languages' letters."""
    asked = _asked(prompt, profiles)
    parts = clauses(answer)
    out = np.zeros((len(parts), len(FEATURES)))
    if not parts:
        return parts, out
    x, closed = None, False
    for n, c in enumerate(parts):
        x, out[n] = asked.clause(c)
        if closed and len(x.words) <= 3:
            out[n, PLACE["name_line"]] = 1
        if closed := bool(CLOSING.search(BULLET.sub("", c).strip())):
            out[n, PLACE["closing"]] = 1
        if len(x.words) < 10 and _HEADING.match(c):
            out[n, PLACE["heading"]] = 1
    if len(answer) / max(1, len(prompt)) < 0.45:
        out[:, PLACE["short_answer"]] = 1
    out[0, PLACE["first"]] = out[-1, PLACE["last"]] = 1
    out[0, PLACE["only"]] = len(parts) == 1
    out[0, PLACE["greeting"]] = parts[0].rstrip().endswith((",", ":")) and len(asked.clause(parts[0])[0].words) < 9
    line = next((x for x in reversed(answer.split("\n")) if x.strip()), "")
    out[-1, ENDING] = _ending(parts[-1], line, x.words, asked, ends)
    return parts, out


_TRAILING, _CLOSED, _NAME = re.compile(r"[*_`\s]+$"), re.compile(r"[.!?。][\"”“»’')\]]*$"), re.compile(r"(?<!^)[A-ZÄÖÜ]\w+$")


def _ending(c: str, line: str, w: list[str], asked: Asked, ends: frozenset[str] | set[str]) -> tuple:
    """Features of how the last clause, which is in the last line, ends, in the order of ``ENDING``."""
    t = _TRAILING.sub("", c)
    closed = bool(_CLOSED.search(t)) and not t.endswith("...")
    bullet = bool(BULLET.match(line))
    known, tail = asked.known, asked.tail
    same = bool(w) and w[-1:] == tail[-1:] and (asked.signed or w[-3:] == tail[-3:])
    quoted = t.count('"') % 2 == 1 or t.count("„") > t.count("“") + t.count("”") or t.count("“") > t.count("”") + t.count("„")
    open_mark = t.count("(") > t.count(")") or t.count("[") > t.count("]") or c.count("**") % 2 == 1 or quoted
    last = w[-1] if w else ""
    function = last in _speakers() or last in ("weil", "which", "because", "dass", "sowie", "außerdem", "moreover")
    bare = not closed and not same
    unknown = bare and last not in ends
    return (
        bare and not bullet, bare and last in ends, unknown and last not in known, unknown and bullet and last not in known, unknown and last in known, unknown and bool(_NAME.search(t)),
        t.endswith(("…", "...")), unknown and function, open_mark and not same, bullet and bare and bool(w), not w, same,
    )


class Crf:
    """Linear-chain conditional random field with real features."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @classmethod
    def fit(cls, data: list[tuple[np.ndarray, list[int]]], rounds: int = 25, rate: float = 0.25, decay: float = 1e-3, seed: int = 7, batch: int = 16) -> Crf:
        """Greatest penalised likelihood by gradients of batches of equally long sequences with per-weight rates (Adagrad)."""
        k, d = len(TAGS), data[0][0].shape[1]
        self = cls(np.zeros((d, k)), np.zeros((k, k)))
        gw, gt = np.full((d, k), 1e-2), np.full((k, k), 1e-2)
        rng = np.random.default_rng(seed)
        by_length: dict[int, list[int]] = {}
        for i, (_, y) in enumerate(data):
            by_length.setdefault(len(y), []).append(i)
        stacks = [(np.stack([data[i][0] for i in of]), np.array([data[i][1] for i in of])) for of in by_length.values()]
        for _ in range(rounds):
            parts = [(n, p[a : a + batch]) for n, (_, y) in enumerate(stacks) for p in (rng.permutation(len(y)),) for a in range(0, len(y), batch)]
            for at in rng.permutation(len(parts)):
                n, chosen = parts[at]
                x, y = stacks[n][0][chosen], stacks[n][1][chosen]
                p, edges = self.batch(x)
                p -= np.eye(k)[y]
                m = len(y)
                dw = np.tensordot(x, p, ([0, 1], [0, 1])) / m + decay * self.w
                np.subtract.at(edges, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
                dt = edges / m + decay * self.t
                gw += dw**2
                gt += dt**2
                self.w -= rate * dw / np.sqrt(gw)
                self.t -= rate * dt / np.sqrt(gt)
        return self

    def batch(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``marginals`` of several sequences of one length, and the sum of their expected tag pairs."""
        e = x @ self.w
        e = np.exp(e - e.max(axis=2, keepdims=True))
        t = np.exp(self.t)
        n = e.shape[1]
        a, b = np.zeros_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, n):
            v = (a[:, i - 1] @ t) * e[:, i]
            a[:, i] = v / v.sum(axis=1, keepdims=True)
        for i in range(n - 2, -1, -1):
            v = (e[:, i + 1] * b[:, i + 1]) @ t.T
            b[:, i] = v / v.sum(axis=1, keepdims=True)
        p = a * b
        p /= p.sum(axis=2, keepdims=True)
        v = a[:, :-1, :, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :] * t
        edges = (v / v.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1)) if n > 1 else np.zeros_like(t)
        return p, edges

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of each clause and expected numbers of tag pairs (forward-backward, scaled)."""
        p, edges = self.batch(x[None])
        return p[0], edges


def invented(text: str, rng: random.Random) -> str:
    """``text`` in a language that no one knows: some of its vowels and consonants change places among themselves, or all letters become signs of a script without blanks."""
    if rng.random() < 0.2:
        first = rng.randrange(0x4E00, 0x9000)
        return re.sub(r"([.!?])\s*", "。", "".join(chr(first + ord(c) % 997) if c.isalpha() else c for c in text if c != " "))
    table = {}
    for letters in ("aeiouäöü", "bcdfghjklmnpqrstvwxzß"):
        some = "".join(rng.sample(letters, rng.randint(len(letters) // 2, len(letters))))
        mixed = some[1:] + some[:1]
        table |= dict(zip(some + some.upper(), mixed + mixed.upper()))
    return "".join(table.get(c, c) for c in text)


def training_pairs(sample: list[tuple[str, str]], ends: frozenset[str] | set[str], seed: int = 11, profiles: Profiles = NO_PROFILES) -> list[tuple[np.ndarray, list[int]]]:
    """Tagged clauses made from sound-looking pairs by damaging them in known ways."""
    rng = random.Random(seed)
    sound = []
    for prompt, answer in sorted(sample):
        parts = clauses(answer)
        tail = parts[-1] if parts else ""
        if len(parts) >= 3 and clauses(prompt) and language(prompt)[0] == language(answer)[0] and profiles.strange(answer, language(prompt)[0]) < 0.5 and (re.search(r"[.!?]$", tail.strip()) or words(tail) == words(clauses(prompt)[-1])):
            sound.append((prompt, answer))
    by_lang: dict[str, list[str]] = {}
    for p, a in sound:
        by_lang.setdefault(language(a)[0], []).append(a)
    foreign_pool = {k: [x for j, v in by_lang.items() if j != k for x in v] for k in FUNCTION_WORDS}
    out = []

    def add(prompt: str, answer: str, tag: str, last: str | None = None) -> None:
        parts, x = features(prompt, answer, ends, profiles)
        if parts:
            y = [TAGS.index(tag)] * len(parts)
            if last:
                y[-1] = TAGS.index(last)
            out.append((x, y))

    for prompt, answer in sound:
        lang = language(prompt)[0]
        add(prompt, answer, "answer")
        parts = clauses(answer)
        kept = [re.sub(r"[.!]$", "", p) for p in parts]
        add(prompt, "\n".join("- " + p for p in kept), "answer")
        add(prompt, " ".join(parts), "answer")
        body = [p for p in parts if len(words(p)) > 5]
        if body:
            whole = rng.choice(body)
            for other in rng.sample(body, min(2, len(body))):
                add(prompt, "\n".join([*parts[: parts.index(other)], re.sub(r"[.!]$", "", "- " + other)]), "answer")
            cut = whole[: rng.randrange(3, max(4, len(whole) - 2))].rstrip()
            mark = rng.choice(["", "", "", "- "])
            title = " ".join(whole.split()[:6])
            add(prompt, "\n".join([*parts[: parts.index(whole)], "## " + title[: rng.randrange(4, max(5, len(title) - 1))].rstrip() + rng.choice(["…", "..."])]), "answer", "unfinished")
            add(prompt, "\n".join([*parts[: parts.index(whole)], mark + cut]), "answer", "unfinished")
            stop = rng.choice([" (" + rng.choice(words(whole)), ', "' + rng.choice(words(whole)), " **" + rng.choice(words(whole)), " " + rng.choice(FUNCTION_WORDS[lang])])
            head = " ".join(whole.split()[: rng.randrange(2, 6)])
            add(prompt, "\n".join([*parts[: parts.index(whole)], head + stop]), "answer", "unfinished")
        add(prompt, prompt, "echo")
        add(prompt, "\n".join("> " + x for x in prompt.split("\n")), "echo")
        add(prompt, " ".join(prompt.split()), "echo")
        spoiled = prompt.split(" ")
        spoiled[rng.randrange(len(spoiled))] = rng.choice(words(answer))
        add(prompt, " ".join(spoiled), "echo")
        add(prompt, rng.choice(["Here is the text:", "Text:", "Hier ist der Text:"]) + "\n\n" + prompt, "echo")
        add(prompt, prompt + "\n\n" + rng.choice(["Done.", "This is the text.", "Hier ist der Text.", "OK.", "(no changes)", "[Text ohne Änderung]"]), "echo")
        if foreign_pool.get(lang):
            add(prompt, rng.choice(foreign_pool[lang]), "foreign")
        if profiles.logs:
            add(prompt, invented(answer, rng), "foreign")
            if rng.random() < 0.3:
                add(invented(prompt, rng), answer, "foreign")
        refusals = [x for k, v in REFUSALS.items() for x in v] + 3 * REFUSALS.get(lang, [])
        for _ in range(2):
            add(prompt, rng.choice(refusals), "refusal")
        add(prompt, rng.choice(refusals) + " " + rng.choice(refusals), "refusal")
        after = rng.choice(["Is there anything else?", "Please ask someone else.", "Kann ich sonst helfen?", "Bitte fragen Sie jemand anderen.", "That is all."])
        add(prompt, rng.choice(refusals) + " " + after, "refusal")
    return out


def copied(prompt: str, answer: str) -> float:
    """Share of the longer text's word pairs that both texts have, of at most marginally longer answers."""
    a, b = words(plain(prompt)), words(plain(answer))
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    same = sum((x & y).values())
    return same / max(1, sum(x.values()), 0.8 * sum(y.values()))


def defect(prompt: str | None, answer: str | None, crf: Crf, ends: frozenset[str] | set[str], profiles: Profiles = NO_PROFILES) -> str | None:
    """The defect of a pair, or None: clause coverage by tag, weighted by words."""
    if empty(answer, prompt):
        return "empty"
    prompt, answer = _tidy(prompt or ""), _tidy(answer)
    parts, x = features(prompt, answer, ends, profiles)
    p, _ = crf.marginals(x)
    weight = np.array([max(1, len(words(c))) for c in parts], float)
    tags = p.argmax(axis=1)
    cover = {t: float(weight[tags == n].sum() / weight.sum()) for n, t in enumerate(TAGS)}
    if cover["refusal"] >= 0.4 and cover["answer"] + cover["unfinished"] <= 0.5:
        return "refusal"
    # A refusal with remarks around it that take up nothing of the prompt gives no rewrite either.
    rest = x[tags != TAGS.index("refusal"), FEATURES.index("overlap")]
    if cover["refusal"] > 0.15 and (rest < 0.25).all():
        return "refusal"
    if cover["echo"] >= 0.5 and copied(prompt, answer) >= 0.75:
        return "copy"
    if cover["foreign"] >= 0.5:
        return "wrong_language"
    return "truncated" if TAGS[tags[-1]] == "unfinished" else None


def sentence_ends(texts: DataFrame) -> DataFrame:
    """``word, n``: the words before the end of a sentence in column ``text``, lower case."""
    ends = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(?<![\w'’-])([\w'’-]++)[.!?]++(?=\s|$|[\"”“»])"), F.lit(1))
    return texts.select(F.explode(ends).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _tidy(text: str) -> str:
    return "\n".join(map(plain, text.split("\n")))


def _clauses_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, str]]]:
    """Language, half and text of all clauses of each batch; a text without function words gives none. Neighbours are in different halves."""
    for b in batches:
        out = []
        for t in (_tidy(t) for c in b.columns for t in c.to_pylist()):
            lang, share = language(t)
            if share[lang] >= 0.12:
                first = crc32(t.encode("utf-8", "replace"))
                out += [(lang, (first + n) % 2, c) for n, c in enumerate(clauses(t))]
        yield out


def _counts(found: dict[tuple[str, int], Counter]) -> pa.RecordBatch:
    rows = [(*k, x, n) for k, v in found.items() for x, n in v.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "half", "x", "n"])


def _letters(batches: Iterator[pa.RecordBatch], of: Callable[[], Callable[[str, int, str], Iterable[str]]], trigrams: bool) -> Iterator[pa.RecordBatch]:
    """Counts, by language and half, of what ``of`` gives of clauses; of its trigrams, if asked for."""
    given = of()
    for found in _clauses_of(batches):
        counts: dict[tuple[str, int], Counter] = {}
        for lang, half, c in found:
            counts.setdefault((lang, half), Counter()).update(given(lang, half, c))
        yield _counts({k: Profiles.counted(v) for k, v in counts.items()} if trigrams else counts)


def learned_profiles(texts: DataFrame) -> Profiles:
    """Letters of the languages of all texts in the columns of ``texts``.

    Each half of a language's clauses is judged by the other; clauses far off are of some other
    language and left out of what is learned at last. Middle and deviation are exact to a
    thousandth. The driver gets one row a trigram and one a thousandth of scores.
    """
    sc = texts.sparkSession.sparkContext

    def collected(of: Callable[[], Callable[[str, int, str], Iterable[str]]], trigrams: bool) -> dict[tuple[str, int], dict[str, int]]:
        rows = texts.mapInArrow(lambda batches: _letters(batches, of, trigrams), "lang string, half int, x string, n bigint").groupBy("lang", "half", "x").agg(F.sum("n").alias("n"))
        out: dict[tuple[str, int], dict[str, int]] = {}
        for r in rows.toLocalIterator():
            out.setdefault((r[0], r[1]), {})[r[2]] = r[3]
        return {k: dict(sorted(v.items())) for k, v in sorted(out.items())}

    halves = collected(lambda: lambda lang, half, c: Profiles.parts(c), True)
    # What judges a half is learned from the other.
    judges = sc.broadcast(Profiles({f"{lang}{1 - half}": Profiles.learned(v) for (lang, half), v in halves.items()}))

    def score(letters: Profiles, lang: str, half: int, c: str) -> float | None:
        if f"{lang}{half}" not in letters.logs:
            return None
        x, n = letters.mean(c, f"{lang}{half}")
        return round(x, 3) if n >= 15 else None

    def scores() -> Callable[[str, int, str], Iterable[str]]:
        letters = judges.value
        return lambda lang, half, c: () if (x := score(letters, lang, half, c)) is None else (str(x),)

    by_lang: dict[str, Counter] = {}
    for (lang, _), v in collected(scores, False).items():
        by_lang.setdefault(lang, Counter()).update({float(x): n for x, n in v.items()})
    usual, least = {}, {}
    for lang, counts in by_lang.items():
        if counts.total() >= 40:
            mean = _median(counts)
            apart: Counter = Counter()
            for x, n in counts.items():
                apart[round(abs(x - mean), 4)] += n
            usual[lang] = mean, max(0.05, 1.5 * _median(apart))
            least[lang] = mean - 5 * usual[lang][1]

    def kept() -> Callable[[str, int, str], Iterable[str]]:
        letters = judges.value
        return lambda lang, half, c: Profiles.parts(c) if lang in least and (x := score(letters, lang, half, c)) is not None and x > least[lang] else ()

    whole: dict[str, Counter] = {}
    for (lang, _), v in (collected(kept, True) if least else {}).items():
        whole.setdefault(lang, Counter()).update(v)
    judges.unpersist()
    return Profiles({lang: Profiles.learned(v) for lang, v in whole.items()}, {lang: usual[lang] for lang in whole})


def _median(counts: Counter) -> float:
    values = sorted(counts)
    below = np.cumsum([counts[x] for x in values])
    lower, upper = (values[int(np.searchsorted(below, k, side="right"))] for k in ((below[-1] - 1) // 2, below[-1] // 2))
    return (lower + upper) / 2


def trained(sound: DataFrame, ends: frozenset[str], profiles: Profiles) -> Crf:
    """The field of all pairs ``prompt, answer`` of ``sound``; equal pairs count once.

    Pairs are dealt to blocks by their hashes. Each block trains a field on all of its pairs,
    each damaged in every way; the weights of the blocks' fields are averaged by their numbers of
    training pairs (parameter mixing). The layout of the table does not matter.
    """
    spark = sound.sparkSession
    sound = sound.withColumn("h", F.xxhash64("prompt", "answer"))
    blocks = max(1, sound.select("h").distinct().count() // BLOCK)
    tasks = min(blocks, width(spark))
    sorts = ["block", "h", "prompt", "answer"]
    dealt = sound.withColumn("block", F.pmod("h", F.lit(blocks))).repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions(*sorts).select(*sorts)
    given = spark.sparkContext.broadcast((ends, profiles))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str, str]]:
        """Block and part of it, prompt, answer."""
        before, block, part, size = None, None, 0, 0
        for b in batches:
            for at, _, p, a in zip(*(c.to_pylist() for c in b.columns)):
                if (p, a) != before:
                    part, size = (0, 0) if at != block else (part + 1, 0) if size > CHARS else (part, size)
                    before, block, size = (p, a), at, size + len(p) + len(a)
                    yield (at, part), p, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, letters = given.value
        total, n = np.zeros((len(FEATURES) + len(TAGS)) * len(TAGS)), 0
        for (block, part), of in groupby(rows(batches), lambda r: r[0]):
            data = training_pairs([(_tidy(p), _tidy(a)) for _, p, a in of], e, seed=11 + block + part, profiles=letters)
            if data:
                crf = Crf.fit(data, rounds=min(ROUNDS[1], max(ROUNDS[0], ceil(SEEN / blocks / len(data)))))
                total += len(data) * np.concatenate([crf.w.ravel(), crf.t.ravel()])
                n += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    fields = dealt.mapInArrow(run, "n bigint, total array<double>").collect()
    given.unpersist()
    weights = np.sum([r.total for r in fields], axis=0) / max(1, sum(r.n for r in fields)) if fields else np.zeros((len(FEATURES) + len(TAGS)) * len(TAGS))
    cut = len(FEATURES) * len(TAGS)
    return Crf(weights[:cut].reshape(-1, len(TAGS)), weights[cut:].reshape(-1, len(TAGS)))


def flagged(pairs: DataFrame, key: str, prompt: str, answer: str) -> DataFrame:
    """``key, defect`` of the defective pairs: empty, refusal, copy, wrong_language or truncated.

    A random field tags the clauses of each answer as answer, refusal, echo, foreign or unfinished;
    what share of the answer each tag covers decides. A null, blank or stand-in answer is
    ``empty``; a null prompt is an empty text. Repeated rows give one; texts are read whole.

    The field is trained on all pairs with a key and more than 40 characters in both texts
    (``trained``), whose answers are damaged in known ways, so it needs no labels and gives the same
    weights for the same table; so are the letters of languages (``learned_profiles``). The words that end
    sentences are counted over all pairs; of these, only words with the share ``END_SHARE`` of all
    ends are sent to the tasks, at most 1 / ``END_SHARE`` words.
    """
    rows = pairs.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(answer).alias("answer"))
    texts = rows.select(F.explode(F.array("prompt", "answer")).alias("text")).filter("text is not null")
    counts = checkpointed(sentence_ends(texts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    ends = frozenset(r[0] for r in counts.filter(F.col("n") >= max(3, END_SHARE * total)).select("word").toLocalIterator())
    usable = rows.filter("key is not null and length(prompt) > 40 and length(answer) > 40").select("prompt", "answer")
    profiles = learned_profiles(balanced(usable))
    crf = trained(usable, ends, profiles)
    shared = pairs.sparkSession.sparkContext.broadcast((crf.w, crf.t, ends, profiles))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t, e, letters = shared.value
        model = Crf(w, t)
        for b in batches:
            found = [defect(p, a, model, e, letters) for p, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["key", "defect"])

    found = balanced(rows).mapInArrow(run, f"key {kind}, defect string").filter("defect is not null")
    return found.distinct().withColumnRenamed("key", key)
