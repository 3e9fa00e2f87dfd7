"""Edit distances of many pairs of texts at once, on numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

#: Pairs compared at a time, so that what belongs to them stays in the cache; and entries of their table of characters.
PAIRS_AT_A_TIME, TABLE = 16_384, 2**22
#: Characters are counted in classes, by code point: small letters and digits each have their own there. How often at most, 372 in all; and texts counted at a time.
CLASSES, TEXTS_AT_A_TIME = 75, 16_384
MOST = np.array([9 if ord("a") % CLASSES <= k <= ord("z") % CLASSES else 6 if ord("0") <= k <= ord("9") else 2 for k in range(CLASSES)])


class Texts:
    """Texts by number, as code points laid end to end."""

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.length) - self.length

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of some texts, a row each, and which of them are there."""
        at = np.arange(self.length[which].max(initial=0))
        there = at < self.length[which, None]
        return self.codes[np.where(there, self.begin[which, None] + at, 0)] if len(self.codes) else np.zeros(there.shape, np.uint32), there

    @functools.cached_property
    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each text has characters of each class, a bit for each time, in words; and how many bits are set."""
        of, time = np.repeat(np.arange(CLASSES), MOST), np.concatenate([np.arange(k) for k in MOST])
        out = np.zeros((len(self.length), -(-len(of) // 64) * 8), np.uint8)
        for i in range(0, len(out), TEXTS_AT_A_TIME):
            length = self.length[i : i + TEXTS_AT_A_TIME]
            row, codes = np.repeat(np.arange(len(length)), length), self.codes[self.begin[i] : self.begin[i] + length.sum()]
            counts = np.bincount(row * CLASSES + codes % CLASSES, minlength=len(length) * CLASSES).reshape(-1, CLASSES)
            bits = np.packbits(counts[:, of] > time, axis=1)
            out[i : i + len(bits), : bits.shape[1]] = bits
        words = out.view(np.uint64).T.copy()
        return words, np.bitwise_count(words).sum(axis=0, dtype=np.int64)

    def fewest(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What the distance of text p[k] to text q[k] is at least: an edit changes at most one character that the longer has and the other lacks."""
        words, total = self.counted
        both = np.zeros(len(p), np.int64)
        for word in words:
            both += np.bitwise_count(word[p] & word[q])
        return np.maximum(total[p], total[q]) - both


def distances(texts: Texts, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Levenshtein's distance of text p[k] to text q[k] for each k."""
    m, n = texts.length[p], texts.length[q]
    out = np.where(m == 0, n, m)
    some = np.flatnonzero((m > 0) & (n > 0))
    words = (m[some] + 63) >> 6
    some = some[np.lexsort((-n[some], words))]
    words = (m[some] + 63) >> 6
    for w in np.unique(words):
        own = some[words == w]
        for i in range(0, len(own), PAIRS_AT_A_TIME):
            part = own[i : i + PAIRS_AT_A_TIME]
            out[part] = _by_columns(texts, p[part], q[part], int(w))
    return out


def _by_columns(texts: Texts, p: np.ndarray, q: np.ndarray, words: int) -> np.ndarray:
    """Myers' algorithm: a column of the matrix of distances as bits, `words` of 64 for each p; all pairs advance together.

    q's lengths descend, so pairs that have ended are the last ones.
    """
    ps, p_at = np.unique(p, return_inverse=True)
    qs, q_at = np.unique(q, return_inverse=True)
    (a, a_there), (b, _) = texts.rows(ps), texts.rows(qs)
    known = np.unique(a[a_there])
    if len(ps) > 1 and len(ps) * (len(known) + 1) * words > TABLE:
        half = len(p) // 2
        return np.concatenate([_by_columns(texts, x, y, words) for x, y in ((p[:half], q[:half]), (p[half:], q[half:]))])
    # Characters by number; the last one stands for those that no p has.
    number = lambda x: np.where(known[k := np.minimum(np.searchsorted(known, x), len(known) - 1)] == x, k, len(known))
    a, b, wide = number(a), number(b), len(known) + 1
    table = np.zeros((words, len(ps) * wide), np.uint64)
    for i in range(a.shape[1]):
        own = np.flatnonzero(a_there[:, i])
        table[i >> 6, own * wide + a[own, i]] |= np.uint64(1 << (i & 63))
    b = np.ascontiguousarray(b.T)
    m, n = texts.length[p], texts.length[q]
    score, last, row = m.copy(), ((m - 1) & 63).astype(np.uint64), p_at * wide
    plus, minus = np.full((words, len(p)), ~np.uint64(0)), np.zeros((words, len(p)), np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    alive = len(n) - np.searchsorted(n[::-1], np.arange(n.max(initial=0)), "right")
    for j, k in enumerate(alive):
        at = row[:k] + b[j][q_at[:k]]
        up, down = one, np.uint64(0)
        for w in range(words):
            v, u, eq = plus[w, :k], minus[w, :k], table[w][at]
            x = eq | u
            eq |= down
            h = (((eq & v) + v) ^ v) | eq
            hp, hm = u | ~(h | v), v & h
            if w == words - 1:
                score[:k] += ((hp >> last[:k]) & one).astype(np.int64) - ((hm >> last[:k]) & one).astype(np.int64)
            over, under = hp >> top, hm >> top
            hp, hm = (hp << one) | up, (hm << one) | down
            plus[w, :k], minus[w, :k] = hm | ~(x | hp), hp & x
            up, down = over, under
    return score
