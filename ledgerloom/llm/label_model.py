"""A generative model of matching functions' votes.

Each candidate has a hidden class, match or not. Every function votes one of a few values; a function's
votes depend on the class and at most one other function, its parent in a forest that is learned from
the votes' mutual information given the class. So the model learns how often each function errs and which
functions err together. It is fitted by EM on counts of vote patterns, whose number depends on the
functions alone, never on the number of candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Mutual information, in nats a vote, from which on two functions are taken to depend on each other.
LEAST_SHARED = 0.05


@dataclass
class LabelModel:
    """votes[i] has values 0..sizes[i]-1; parent[i] is a function's index or -1; abstain[i] is the value
    by which it says nothing, or -1. An abstention tells neither for nor against a match."""

    sizes: list[int]
    prior: np.ndarray
    parent: list[int]
    tables: list[np.ndarray]  # [class, parent's value, value]
    abstain: list[int]

    def log_joint(self, patterns: np.ndarray) -> np.ndarray:
        out = np.tile(np.log(self.prior), (len(patterns), 1))
        for i, (up, t) in enumerate(zip(self.parent, self.tables)):
            above = patterns[:, up] if up >= 0 else np.zeros(len(patterns), int)
            out += np.where((patterns[:, i] == self.abstain[i])[:, None], 0.0, np.log(t[:, above, patterns[:, i]]).T)
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of a match of each pattern."""
        x = self.log_joint(patterns)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x[:, 1] / x.sum(axis=1)


def _tree(patterns: np.ndarray, weight: np.ndarray, sizes: list[int], abstain: list[int]) -> list[int]:
    """A maximum spanning forest over the functions by conditional mutual information; parents, -1 for roots.

    Only pairs that share LEAST_SHARED nats or more given the class are tied: weaker ties would let the
    model explain by dependence what the class explains.
    """
    n = len(sizes)
    info = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            total = 0.0
            both = (patterns[:, i] != abstain[i]) & (patterns[:, j] != abstain[j])
            for c in range(2):
                joint = np.full((sizes[i], sizes[j]), 0.1)
                np.add.at(joint, (patterns[both, i], patterns[both, j]), weight[both, c])
                p = joint / joint.sum()
                total += weight[both, c].sum() * (p * np.log(p / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))).sum()
            info[i, j] = info[j, i] = total
    parent, inside = [-1] * n, {0}
    while len(inside) < n:
        i, j = max(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda e: info[e])
        parent[j] = i if info[i, j] >= LEAST_SHARED * weight.sum() else -1
        inside.add(j)
    return parent


def fit(patterns: np.ndarray, counts: np.ndarray, sizes: list[int], start: np.ndarray, abstain: list[int], anchor: list[np.ndarray] | None = None, rounds: int = 60, smooth: float = 1.0) -> LabelModel:
    """EM from the starting probabilities of a match of each pattern.

    anchor: optional pseudo counts [class, value] per function, that keep the classes' meaning where
    votes are few.
    """
    p = np.clip(start, 0.02, 0.98)
    parent = [-1] * len(sizes)
    model = None
    for step in range(rounds):
        weight = np.stack([1 - p, p], axis=1) * counts[:, None]
        if step in (0, 5, 20):
            parent = _tree(patterns, weight, sizes, abstain)
        tables = []
        for i, up in enumerate(parent):
            base = np.full((2, sizes[i]), smooth) + (anchor[i] if anchor else 0)
            said = patterns[:, i] != abstain[i]
            for c in range(2):
                np.add.at(base[c], patterns[said, i], weight[said, c])
            base /= base.sum(axis=1, keepdims=True)
            t = np.zeros((2, sizes[up] if up >= 0 else 1, sizes[i]))
            above = patterns[:, up] if up >= 0 else np.zeros(len(patterns), int)
            heard = said & (above != abstain[up]) if up >= 0 else said
            for c in range(2):
                np.add.at(t[c], (above[heard], patterns[heard, i]), weight[heard, c])
            t += 20 * smooth * base[:, None, :]  # shrinks rare combinations to the function's own rates
            tables.append(t / t.sum(axis=2, keepdims=True))
        prior = (weight.sum(axis=0) + smooth) / (weight.sum() + 2 * smooth)
        model = LabelModel(sizes, prior, parent, tables, abstain)
        new = np.clip(model.posterior(patterns), 1e-9, 1 - 1e-9)
        if step > 25 and np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model
