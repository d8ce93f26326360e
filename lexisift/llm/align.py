"""Wrappers of token streams: union-free expressions inferred by iterative alignment.

A stream is a list of numbers, one for a line: a token's digest with the line's shape in its last
two bits and, before them, a bit that marks tokens of enough pages; or a bare shape where the
token is no candidate for a constant. A wrapper is a list of
nodes in page order; between two nodes lies a text slot that holds any lines. A node that not all
pages have is an optional, one that pages have several times in a row a repeated group, and one
that is followed by title after title opens a repeated group of slots.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Shapes of lines, the last two bits of a token, and the bit of tokens that are on enough pages.
OTHER, TITLE, HEADING, PROSE = range(4)
STRONG = 4
#: Pages that must hold a token which is on less than the share of pages that makes a constant, and
#: stand it, in three of four of them, beside constants or a page's ends.
FRAMED = 8


def shape(token: int) -> int:
    return token & 3


def known(token: int) -> bool:
    """Whether a number is a token, not a bare shape."""
    return not 0 <= token < 8


def chain(places: dict[int, list[int]], stream: list[int], weight: list[int]) -> list[tuple[int, int]]:
    """The longest common subsequence of nodes and lines, of several that with the most weight, as (node, line).

    ``places`` has the nodes of each token. Lines are taken in order; a tree over the nodes (Fenwick's) yields the heaviest chain that ends before a node.
    """
    tree: list[tuple | None] = [None] * (len(weight) + 1)
    best: tuple | None = None
    for at, token in enumerate(stream):
        for node in reversed(places.get(token, ())):
            before, k = None, node
            while k:
                if tree[k] and (before is None or tree[k][0] > before[0]):
                    before = tree[k]
                k &= k - 1
            link = ((before[0] if before else 0) + (1 << 40) + weight[node], node, at, before)
            if best is None or link[0] > best[0]:
                best = link
            k = node + 1
            while k < len(tree):
                if tree[k] is None or link[0] > tree[k][0]:
                    tree[k] = link
                k += k & -k
    out = []
    while best:
        out.append(best[1:3])
        best = best[3]
    return out[::-1]


def places_of(tokens: list[int]) -> dict[int, list[int]]:
    """Places of each token."""
    out: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        out.setdefault(t, []).append(i)
    return out


@dataclass
class Wrapper:
    """Nodes in page order, each with what the aligned pages show of it.

    ``support`` pages hold the node, ``repeats`` of them several times in a row; in ``framed`` of
    them at most one other line stands between it and a constant or a page's end, on either
    side; in ``opens`` of them titles follow it, at least two in a row; ``pages`` were aligned.
    """

    tokens: list[int]
    support: list[int]
    repeats: list[int]
    framed: list[int]
    opens: list[int]
    pages: int = 0

    @classmethod
    def of(cls, stream: list[int]) -> Wrapper:
        """The wrapper of one page: its tokens."""
        folded, _, repeated = fold(stream)
        nodes = [t for t in folded if known(t)]
        return cls(nodes, [1] * len(nodes), [int(t in repeated) for t in nodes], [0] * len(nodes), [0] * len(nodes), 1)

    @property
    def figures(self) -> tuple[list[int], ...]:
        return self.support, self.repeats, self.framed, self.opens

    def places(self) -> dict[int, list[int]]:
        return places_of(self.tokens)

    def kept(self, least: int) -> Wrapper:
        """Without the nodes that fewer than ``least`` pages hold."""
        at = [i for i, n in enumerate(self.support) if n >= least]
        return Wrapper(*([x[i] for i in at] for x in (self.tokens, *self.figures)), self.pages)


def fold(stream: list[int]) -> tuple[list[int], list[int], set[int]]:
    """``stream`` with squares of tokens (a part that follows itself) folded, the lines that are left, and the tokens that repeat."""
    out: list[int] = []
    lines: list[int] = []
    repeated: set[int] = set()
    for at, t in enumerate(stream):
        out.append(t)
        lines.append(at)
        if not known(t):
            continue
        for k in range(1, min(8, len(out) // 2) + 1):
            if out[-k:] == out[-2 * k : -k] and all(map(known, out[-k:])):
                repeated.update(out[-k:])
                del out[-k:], lines[-k:]
                break
    return out, lines, repeated


def infer(streams: list[list[int]]) -> Wrapper:
    """The wrapper of pages, and how its nodes stand in them."""
    w = merge([Wrapper.of(s) for s in streams])
    places = w.places()
    for stream in streams:
        observe(w, places, stream)
    return w


def merge(parts: list[Wrapper]) -> Wrapper:
    """One wrapper of pages or groups of pages, by aligning one after the other with the wrapper so far.

    Where both differ, nodes that a part lacks become optional, and tokens that are new at their
    place optional nodes; a part that repeats the one before it is a repeated group already.
    What is neither is text of the slot between the nodes around it. A second round aligns
    all parts with the whole, as the first ones met only a piece of it.
    """
    tokens: list[int] = []
    support: list[int] = []
    for p in parts:
        pairs = chain(places_of(tokens), p.tokens, support)
        node_of = {j: i for i, j in pairs}
        here, added = 0, {}
        for j, t in enumerate(p.tokens):
            if j in node_of:
                here = node_of[j] + 1
                support[here - 1] += p.support[j]
            else:
                added.setdefault(here, []).append((t, p.support[j]))
        if added:
            rows = list(zip(tokens, support))
            rows = [x for i in range(len(rows) + 1) for x in (*added.get(i, ()), *rows[i : i + 1])]
            tokens, support = map(list, zip(*rows))
    w = Wrapper(tokens, *([0] * len(tokens) for _ in range(4)), sum(p.pages for p in parts))
    places = w.places()
    for p in parts:
        for i, j in chain(places, p.tokens, support):
            for total, own in zip(w.figures, p.figures):
                total[i] += own[j]
    return w.kept(1)


def observe(w: Wrapper, places: dict[int, list[int]], stream: list[int]) -> None:
    """Adds to ``w`` how its nodes stand in a page: framed by constants, or with titles behind them."""
    pairs = chain(places, stream, w.support)
    matched = {at for _, at in pairs}
    n = len(stream)
    fixed = [-1, *(at for _, at in pairs if stream[at] & STRONG), n]
    k = 0
    for i, at in pairs:
        while fixed[k + 1] < at:
            k += 1
        if fixed[k + 1] != at:
            w.framed[i] += n > 2 and fixed[k + 1] - fixed[k] <= 3
        run = at + 1
        while run < n and run not in matched and shape(stream[run]) == TITLE:
            run += 1
        w.opens[i] += run - at > 2


def settled(w: Wrapper) -> tuple[list[int], list[int], list[bool]]:
    """Token and support of the nodes that are left when all pages are aligned, and whether each opens a group of titles.

    Nodes of one page are text of their slot. A token that is on too few pages for a constant
    stays where ``FRAMED`` pages show it beside constants. A line in the form of prose or of a heading
    needs three pages, as two may share a paragraph.
    """
    total: dict[int, list[int]] = {}
    for t, *figures in zip(w.tokens, w.support, w.framed, w.opens):
        total[t] = [a + b for a, b in zip(total.get(t, (0, 0, 0)), figures)]

    def stays(t: int) -> bool:
        support, framed, _ = total[t]
        if t & STRONG:
            return support >= (3 if shape(t) in (PROSE, HEADING) else 2)
        return framed >= FRAMED and 4 * framed >= 3 * support

    w = w.kept(2)
    at = [i for i, t in enumerate(w.tokens) if stays(t)]
    opens = {t for t, (support, _, n) in total.items() if n >= 2 and 2 * n >= support}
    return [w.tokens[i] & ~STRONG for i in at], [w.support[i] for i in at], [w.tokens[i] in opens for i in at]


def parse(tokens: list[int], support: list[int], opens: list[bool], stream: list[int]) -> tuple[set[int], set[int]]:
    """Lines of a page that are nodes of a wrapper, repeated ones too, and those that open a group of titles.

    All other lines are text of slots.
    """
    places = places_of(tokens)
    folded, lines, repeated = fold([t if t in places else shape(t) for t in stream])
    node_of = {lines[at]: i for i, at in chain(places, folded, support)}
    # Lines that fold repeat the part before them: one more turn of its group.
    left = set(lines)
    matched = {stream[at] for at in node_of}
    node_of |= {at: places[t][0] for at, t in enumerate(stream) if at not in left and t in repeated and t in matched}
    return set(node_of), {at for at, i in node_of.items() if opens[i]}
