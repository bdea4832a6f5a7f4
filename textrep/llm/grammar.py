"""Cheapest edits of role sequences as a product of small matrices over a shared grammar.

A turn is a symbol: its role's initial and whether it must go or ends too early. A symbol has
a matrix over the states of the wanted sequence ``(s?(ua)+)?``: for each pair of
states the least ``(cost, audit)`` that leads from one to the other, audits being
compared as ASCII text. Matrices of longer sequences are products of their parts' matrices
(least sum, audits joined). Re-Pair replaces frequent neighbours in all sequences
by rules; a rule's matrix is the product of its two sides, computed once and used
by every sequence that has the rule. Audits are ropes, so a product joins no text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: Symbols: 0 must be deleted; 1 + 2 * role + (1 if it ends too early).
ROLES = "sua"
DELETED, OTHER, SYMBOLS = 0, 3, 9
KEEP, REROLE, DELETE, INSERT, SHORT = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a; the first and the last may end.
STATES = 4
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
ENDS = (0, 3)
#: A rule needs this many uses, as its matrix costs four times the step of a sequence.
LEAST_USES = 5

#: Fingerprints are texts as numbers to the base 256, modulo a prime.
_PRIME = (1 << 130) - 5


class Rope:
    """Text as a leaf or as two ropes, with its length and fingerprint."""

    __slots__ = ("left", "right", "length", "power", "print")

    def __init__(self, left: Rope | str, right: Rope | None = None) -> None:
        self.left, self.right = left, right
        if right is None:
            self.length, self.power = len(left), pow(256, len(left), _PRIME)
            self.print = int.from_bytes(left.encode("ascii"), "big") % _PRIME
        else:
            self.length, self.power = left.length + right.length, left.power * right.power % _PRIME
            self.print = (left.print * right.power + right.print) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        return other if not self.length else self if not other.length else Rope(self, other)

    def __str__(self) -> str:
        found, open_ = [], [self]
        while open_:
            rope = open_.pop()
            if rope.right is None:
                found.append(rope.left)
            else:
                open_ += (rope.right, rope.left)
        return "".join(found)


EMPTY = Rope("")


def before(a: Sequence[Rope], b: Sequence[Rope]) -> bool:
    """Whether the joined text of ``a`` is less than that of ``b``; equal ropes at equal places are skipped."""
    one, two = [r for r in reversed(a) if r.length], [r for r in reversed(b) if r.length]
    while one and two:
        x, y = one.pop(), two.pop()
        if x is y or (x.length == y.length and x.print == y.print):
            continue
        if x.right is None and y.right is None:
            size = min(x.length, y.length)
            if x.left[:size] != y.left[:size]:
                return x.left < y.left
            if x.length > size:
                one.append(Rope(x.left[size:]))
            elif y.length > size:
                two.append(Rope(y.left[size:]))
        elif y.right is None or (x.right is not None and x.length >= y.length):
            one += (x.right, x.left)
            two.append(y)
        else:
            one.append(x)
            two += (y.right, y.left)
    return bool(two)


Cell = tuple[int, Rope]


def _least(found: Iterable[tuple[int, Rope, Rope]]) -> Cell | None:
    best = None
    for cost, x, y in found:
        if best is None or cost < best[0] or (cost == best[0] and before((x, y), best[1:])):
            best = (cost, x, y)
    return None if best is None else (best[0], best[1] + best[2])


def times(rows: list[list[Cell | None]], matrix: list[list[Cell | None]]) -> list[list[Cell | None]]:
    """The least ways through ``rows`` and then ``matrix``."""
    out = []
    for row in rows:
        some = [(row[k], matrix[k]) for k in range(STATES) if row[k] is not None]
        out.append([_least((a[0] + r[to][0], a[1], r[to][1]) for a, r in some if r[to] is not None) for to in range(STATES)])
    return out


def _inserts() -> list[list[Cell | None]]:
    one, two = Rope("I"), Rope("II")
    ways = [[None] * STATES for _ in range(STATES)]
    for at in range(STATES):
        ways[at][at] = (0, EMPTY)
        for role in (1, 2):
            to = NEXT.get((at, role))
            if to is not None:
                ways[at][to] = (INSERT, one)
                if to == 2 and at != 3:
                    ways[at][3] = (2 * INSERT, two)
    return ways


#: Least inserts between the states, and no way at all but staying.
INSERTS = _inserts()
START = [[(0, EMPTY), None, None, None]]
NOTHING = [[(0, EMPTY) if at == to else None for to in range(STATES)] for at in range(STATES)]


def _symbol(symbol: int) -> list[list[Cell | None]]:
    letters = {c: Rope(c) for c in "DKR"}
    role, short = divmod(symbol - 1, 2) if symbol else (OTHER, 0)
    step = [[None] * STATES for _ in range(STATES)]
    for at in range(STATES):
        step[at][at] = (DELETE, letters["D"])
        for turned in (1, 2) if symbol else ():
            to = NEXT.get((at, turned))
            if to is not None:
                step[at][to] = (REROLE + SHORT * short, letters["R"])
        to = NEXT.get((at, role)) if symbol else None
        if to is not None:
            step[at][to] = (KEEP + SHORT * short, letters["K"])
    return times(INSERTS, step)


SYMBOL = [_symbol(symbol) for symbol in range(SYMBOLS)]


def re_pair(sequence: np.ndarray, least_uses: int = LEAST_USES) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Rules (rule i is number ``SYMBOLS + i``) and the sequence written with them; -1 separates sequences.

    The most frequent pair of neighbours is replaced, from left to right and
    without overlaps, as long as it has ``least_uses``; ties go to the smaller pair.
    """
    rules = []
    while len(sequence) > 1:
        size = SYMBOLS + len(rules)
        a, b = sequence[:-1], sequence[1:]
        valid = (a >= 0) & (b >= 0)
        same = valid & (a == b)
        if same.any():  # every other place of a run of equal symbols
            place = np.arange(len(a))
            origin = np.maximum.accumulate(np.where(same & ~np.concatenate([[False], same[:-1]]), place, 0))
            valid &= ~same | ((place - origin) % 2 == 0)
        codes = a[valid].astype(np.int64) * size + b[valid]
        if not len(codes):
            break
        pairs, uses = np.unique(codes, return_counts=True)
        best = int(uses.argmax())
        if uses[best] < least_uses:
            break
        places = np.flatnonzero(valid)[codes == pairs[best]]
        rules.append(divmod(int(pairs[best]), size))
        sequence = sequence.copy()
        sequence[places] = size
        kept = np.ones(len(sequence), bool)
        kept[places + 1] = False
        sequence = sequence[kept]
    return rules, sequence


def solve(sequences: Sequence[bytes], whole: Sequence[bool], least_uses: int = LEAST_USES) -> list[list[Cell | None]]:
    """For each sequence of symbols its matrix, row by row, or only its least way ``[(cost, audit)]`` if it is ``whole``."""
    parts = [x for s in sequences for x in (np.frombuffer(s, np.uint8).astype(np.int32), np.array([-1], np.int32))]
    rules, written = re_pair(np.concatenate(parts) if parts else np.zeros(0, np.int32), least_uses)
    matrices = list(SYMBOL)
    for left, right in rules:
        matrices.append(times(matrices[left], matrices[right]))
    out, bounds = [], np.flatnonzero(written < 0)
    for low, high, alone in zip([0, *(bounds[:-1] + 1)], bounds, whole):
        rows = START if alone else NOTHING
        for symbol in written[low:high].tolist():
            rows = times(rows, matrices[symbol])
        out.append([finish(rows[0])] if alone else [cell for row in rows for cell in row])
    return out


def finish(row: list[Cell | None]) -> Cell:
    """The least way that ends in a wanted sequence."""
    last = times([row], INSERTS)[0]
    return _least((*last[to], EMPTY) for to in ENDS if last[to] is not None)
