"""Spelling helpers that several operators share: folding, q-grams, edit distance, Jaro-Winkler, Monge-Elkan."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Signs that scanning or typing puts for letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "l", "5": "s", "ß": "s", "ø": "o", "đ": "d", "ł": "l", "æ": "e", "œ": "e"})


def unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def folded(word: str) -> str:
    """Lower case, no accents, look-alike signs as letters (only within words that have letters)."""
    w = unaccented(word.lower())
    return w.translate(LOOK_ALIKE) if any(c.isalpha() for c in w) else w


def qgrams(s: str, q: int = 2) -> list[str]:
    """Padded q-grams with repeats: q - 1 signs before and after, so that beginnings and ends count."""
    p = "\x02" * (q - 1) + s + "\x03" * (q - 1)
    return [p[i : i + q] for i in range(len(p) - q + 1)]


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap of neighbours); most + 1 if it is larger than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Only the band of `most` cells on either side of the diagonal can stay within `most`: linear in the length.
    over = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        last, row_before = row, before
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            v = min(last.get(j, over) + 1, row.get(j - 1, over) + 1, last.get(j - 1, over) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, row_before.get(j - 2, over) + 1)
            row[j] = v
        if not row or min(row.values()) > most:
            return over
        before = last
    return min(row.get(len(b), over), over)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if max(len(a), len(b)) > 500:  # no name: what its edits leave
        return max(0.0, 1 - edits(a, b, 20) / 21)
    reach = max(len(a), len(b)) // 2 - 1
    used, at = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                at.append((i, j))
                break
    m = len(at)
    if not m:
        return 0.0
    other = [b[j] for j in sorted(j for _, j in at)]
    swaps = sum(a[i] != y for (i, _), y in zip(at, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def monge_elkan(a: list[str], b: list[str], sim=jaro_winkler) -> float:
    """Symmetric: each token's best partner, averaged over both sides' tokens."""
    if not a or not b:
        return 0.0
    one = sum(max(sim(x, y) for y in b) for x in a) / len(a)
    two = sum(max(sim(y, x) for x in a) for y in b) / len(b)
    return (one + two) / 2
