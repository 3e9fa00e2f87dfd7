"""Reconciliation of whole accounts, left row after left row, on numpy arrays.

Left rows choose in order, so only right rows still free are looked at, and of those only the ones that
can be at least as good as what is found already: first rows near in amount and day, whose texts need
not be alike, then rows near in one of them only. Texts are compared last, each two once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.functions.edits import Texts, distances
from ledgerloom.functions.scalars import letters

#: Accounts are settled together up to so many rows; pairs of a chunk of left rows, unless one row has more.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 20_000, 2_000_000
#: Of rows without date: no two are near.
NO_DAY = {0: 2**40, 1: 2**41}
KINDS = np.array(["exact", "fuzzy", "amount_date", "amount_only"])


def whole_accounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by account as tables that split no account, of at least ROWS_AT_ONCE rows but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        if sum(x.num_rows for x in held) + b.num_rows >= ROWS_AT_ONCE:
            of = b.column("account")
            cut = pc.index(of, of[-1]).as_py()
            if cut or held and held[-1].column("account")[-1] != of[-1]:
                table, held, b = pa.Table.from_batches([*held, b.slice(0, cut)]), [], b.slice(cut)
                yield table
                del table
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


class _Accounts:
    """Both sides of whole accounts, each sorted by account, day and id; right rows by number are also the order of preference."""

    def __init__(self, table: pa.Table, days: int, share: float, likeness: float, alike: float, floor: float, points: dict[str, tuple[float, float]]) -> None:
        self.days, self.share, self.likeness, self.alike, self.floor, self.points = days, share, likeness, alike, floor, points
        table = table.combine_chunks()
        side, account = np.asarray(table["side"]), _numbered(table["account"])
        self.at = [np.flatnonzero(side == k) for k in (0, 1)]
        day = table["day"].cast(pa.int64())
        self.day = [np.asarray(pc.fill_null(day, NO_DAY[k]))[at] for k, at in enumerate(self.at)]
        amount = np.asarray(pc.fill_null(table["amount"], np.nan))
        self.amount = [amount[at] for at in self.at]
        self.account = [account[at] for at in self.at]
        # Texts, each once; the last of their numbers stands for null, which is like nothing.
        texts = pa.chunked_array([*table["text1"].chunks, *table["text2"].chunks]).combine_chunks().dictionary_encode()
        number = np.asarray(pc.fill_null(texts.indices, len(texts.dictionary))).reshape(2, -1)
        self.text = [number[:, at] for at in self.at]
        known = [*texts.dictionary.to_pylist(), ""]
        self.texts = Texts(known)
        self.length = np.append(self.texts.length[:-1], -(10**9))
        self.letters = letters(pa.array(known, pa.string())).to_numpy()
        # Right rows in order of day, as they come, and of amount.
        self.by_day = self.key(1, self.day[1])
        self.steps = np.unique(self.amount[1][~np.isnan(self.amount[1])])
        priced = np.flatnonzero(~np.isnan(self.amount[1]))
        price = self.account[1][priced] * (len(self.steps) + 1) + np.searchsorted(self.steps, self.amount[1][priced])
        order = np.argsort(price, kind="stable")
        self.of_amount, self.by_amount = priced[order], price[order]
        # A row's copies of one id are taken together; left rows of one account, day and id choose together.
        self.id = _numbered(pc.binary_join_element_wise(table["account"].cast(pa.string()), table["id"].cast(pa.string()), "\0", null_handling="replace"))
        self.free = np.ones(len(self.at[1]), bool)
        self.copies: dict[int, list[int]] = {}
        ids = self.id[self.at[1]]
        if len(np.unique(ids)) < len(ids):
            for i, x in enumerate(ids.tolist()):
                self.copies.setdefault(x, []).append(i)
        left = self.id[self.at[0]]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1]) | (self.day[0][1:] != self.day[0][:-1])
        self.chooser = np.cumsum(new) - 1
        self.table = table.select(["account", "id", "day"])

    def key(self, side: int, day: np.ndarray) -> np.ndarray:
        return self.account[side] * 2**43 + (day + 2**32)

    def take(self, right: int) -> None:
        self.free[self.copies.get(int(self.id[self.at[1][right]]), right)] = False

    def ranges(self) -> list[np.ndarray]:
        """Where each left row's right rows of near days begin and end, and those of near amounts."""
        day = np.searchsorted(self.by_day, self.key(0, self.day[0] - self.days), "left"), np.searchsorted(self.by_day, self.key(0, self.day[0] + self.days), "right")
        x, wide = self.amount[0], (2 + self.share) / (2 - self.share) * (1 + 1e-9)
        ends = np.sort([x / wide, x * wide], axis=0)
        first = self.account[0] * (len(self.steps) + 1)
        low, high = np.searchsorted(self.steps, ends[0], "left"), np.searchsorted(self.steps, ends[1], "right")
        amount = np.searchsorted(self.by_amount, first + low, "left"), np.searchsorted(self.by_amount, first + high, "left")
        none = np.isnan(x)
        return [*day, np.where(none, 0, amount[0]), np.where(none, 0, amount[1])]

    def edges(self, left: np.ndarray, ranges: list[np.ndarray], every: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """Edges of some left rows to free right rows (left, right, confidence, kind), and from which confidence each chooser's are whole; every: from the floor."""
        places, choosers = np.unique(self.chooser[left], return_inverse=True)
        at, right = _spread(ranges[0][left], ranges[1][left])
        some = self.free[right]
        at, right = at[some], right[some]
        x, y, gap = self.amount[0][left[at]], self.amount[1][right], np.abs(self.day[0][left[at]] - self.day[1][right])
        near = _near(x, y, self.share)
        day = np.where(gap == 0, *self.points["date"])
        both = self.scored(left, at[near], right[near], np.where(x == y, *self.points["amount"])[near], day[near], None)
        best = np.full(len(places), self.floor)
        if not every:
            np.maximum.at(best, choosers[both[0]], both[2])
        # The same days at other amounts, and near amounts at other days: only what can be as good.
        other = ~near & (day + self.points["merchant"][0] >= best[choosers[at]])
        days = self.scored(left, at[other], right[other], np.zeros(other.sum()), day[other], best[choosers])
        begin, end = ranges[2][left], ranges[3][left]
        ask = self.points["amount"][0] + 0.0 + self.points["merchant"][0] >= best[choosers]
        at, right = _spread(np.where(ask, begin, 0), np.where(ask, end, 0))
        right = self.of_amount[right]
        some = self.free[right]
        at, right = at[some], right[some]
        x, y = self.amount[0][left[at]], self.amount[1][right]
        some = _near(x, y, self.share) & (np.abs(self.day[0][left[at]] - self.day[1][right]) > self.days)
        amount = np.where(x == y, *self.points["amount"])
        some &= amount + 0.0 + self.points["merchant"][0] >= best[choosers[at]]
        amounts = self.scored(left, at[some], right[some], amount[some], np.zeros(some.sum()), best[choosers])
        at, right, confidence, kind = (np.concatenate(c) for c in zip(both, days, amounts))
        some = confidence >= best[choosers[at]]
        return (left[at[some]], right[some], confidence[some], kind[some]), best

    def scored(self, left: np.ndarray, at: np.ndarray, right: np.ndarray, amount: np.ndarray, day: np.ndarray, best: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Those pairs that reach the floor. best: of each left row, what a pair must reach to matter; without it all are compared to `likeness`."""
        base = amount + day
        full, part = self.points["merchant"]
        need = np.full(len(at), self.likeness) if best is None else np.where(base + part >= best[at], self.likeness, self.alike)
        like = self.like(self.text[0][:, left[at]], self.text[1][:, right], need)
        confidence = base + np.where(like >= self.alike, full, np.where(like >= self.likeness, part, 0.0))
        likely, near = like >= self.likeness, (amount > 0) & (day > 0)
        exact = (amount == self.points["amount"][0]) & (day == self.points["date"][0]) & (like >= self.alike)
        kind = np.select([exact, near & likely, near], [0, 1, 2], 3)
        some = confidence >= self.floor
        return at[some], right[some], confidence[some], kind[some]

    def like(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The greatest similarity of each pair's texts, 0 where it is under `least` for certain."""
        out, pairs, keys, total = np.zeros(len(least)), [], [], len(self.length)
        for i in (0, 1):
            for k in (0, 1):
                p, q = left[i], right[k]
                # A second text that is the first one again was compared already.
                some = np.flatnonzero(((p != left[0]) if i else (p == p)) & ((q != right[0]) if k else (q == q)))
                x, y = self.length[p[some]], self.length[q[some]]
                most = np.maximum(x, y) * (1 - least[some]) + 1e-9
                close = (np.abs(x - y) <= most) & (x >= 0)
                some, most = some[close], most[close]
                a, b = self.letters[p[some]], self.letters[q[some]]
                close = np.maximum(np.bitwise_count(a & ~b), np.bitwise_count(b & ~a)) <= most
                some, most = some[close], most[close]
                some = some[self.texts.fewest(p[some], q[some]) <= most]
                pairs.append(some)
                keys.append(p[some].astype(np.int64) * total + q[some])
        pairs, (keys, back) = np.concatenate(pairs), np.unique(np.concatenate(keys), return_inverse=True)
        p, q = keys // total, keys % total
        longest = np.maximum(self.length[p], self.length[q])
        found = np.where(p == q, 1.0, 1 - distances(self.texts, q, p) / np.maximum(longest, 1))
        np.maximum.at(out, pairs, found[back])
        return out

    def matches(self) -> tuple[list[int], list[int], list[float], list[int]]:
        """(left, right, confidence, kind) of each left row's best right row still free."""
        out: list[tuple[int, int, float, int]] = []
        ranges = self.ranges()
        work = np.cumsum(ranges[1] - ranges[0] + ranges[3] - ranges[2])
        begin, total = 0, len(self.chooser)
        while begin < total:
            end = int(np.searchsorted(work, (work[begin - 1] if begin else 0) + PAIRS_AT_ONCE, "right"))
            end = int(np.searchsorted(self.chooser, self.chooser[max(begin, end - 1)], "right"))
            found = self.chosen(np.arange(begin, end), ranges)
            for edge in found:
                self.take(edge[1])
            out += found
            begin = end
        return tuple(map(list, zip(*out))) if out else ([], [], [], [])

    def chosen(self, left: np.ndarray, ranges: list[np.ndarray]) -> list[tuple[int, int, float, int]]:
        """What some left rows take, as if one chose after the other: whoever asks for what a later one holds gets it, and the later one asks on.

        So those who have asked for all edges made so far get the rest of theirs together.
        """
        wants: dict[int, list] = {}
        whole: dict[int, bool] = {}
        held: dict[int, tuple] = {}
        asking, every = left, False
        while len(asking):
            edges, least = self.edges(asking, ranges, every)
            order = np.lexsort((edges[1], -edges[2], self.chooser[edges[0]]))
            edges = [c[order] for c in edges]
            places = np.unique(self.chooser[asking])
            ends = np.searchsorted(self.chooser[edges[0]], places, "right").tolist()
            rows = list(zip(*[c.tolist() for c in edges], self.id[self.at[1][edges[1]]].tolist()))
            start, short = 0, []
            for who, end, enough in zip(places.tolist(), ends, (least <= self.floor).tolist()):
                wants[who], whole[who] = rows[start:end][::-1], enough
                start = end
            for who in places.tolist():
                while True:
                    if not wants[who]:
                        if not whole[who]:
                            short.append(who)
                        break
                    edge = wants[who].pop()
                    other = held.get(edge[4])
                    if other is None or other[0] > who:
                        held[edge[4]] = who, edge
                        if other is None:
                            break
                        who = other[0]
            asking, every = left[np.isin(self.chooser[left], np.array(short, np.int64))], True
        return [edge[:4] for _, edge in sorted(held.values())]


def _near(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x == y) | ((x != 0) & (y != 0) & (np.abs(x - y) / ((np.abs(x) + np.abs(y)) / 2) <= share))


def _numbered(c: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(c.combine_chunks().dictionary_encode().indices).astype(np.int64)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number of each range, and of which range it is."""
    many = end - begin
    at = np.repeat(np.arange(len(many)), many)
    return at, np.arange(len(at)) + np.repeat(begin - (np.cumsum(many) - many), many)


def _left_over(table: pa.Table) -> pa.Table:
    """The rows of sides 0 and 1 but for those that sides 2 and 3 name as taken."""
    side = np.asarray(table["side"])
    if not (side > 1).any():
        return table
    key = _numbered(pc.binary_join_element_wise(table["account"].cast(pa.string()), table["id"].cast(pa.string()), "\0", null_handling="replace")) * 2 + side % 2
    return table.filter(pa.array(~np.isin(key, key[side > 1])))


def settled(batches: Iterator[pa.RecordBatch], names: list[str], **rules) -> Iterator[pa.RecordBatch]:
    """Of rows (account, side, day, id, amount, text1, text2) sorted by account, day and id, no account split: the matches, its columns called `names`.

    Sides 2 and 3 have the ids of left and right rows that are taken already.
    """
    for table in map(_left_over, whole_accounts(batches)):
        if not table.num_rows:
            continue
        x = _Accounts(table, **rules)
        left, right, confidence, kind = x.matches()
        a, b = (x.table.take(pa.array(at[np.array(k, np.int64)])) for at, k in zip(x.at, (left, right)))
        day = lambda t: t["day"].cast(pa.int32()).cast(pa.date32())
        columns = [a["account"], a["id"], b["id"], day(a), day(b), pa.array(confidence, pa.float64()), pa.array(KINDS[np.array(kind, np.int64)].tolist(), pa.string())]
        yield from pa.Table.from_arrays(columns, names=names).to_batches()
