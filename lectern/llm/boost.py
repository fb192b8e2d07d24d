"""Gradient-boosted trees for a yes-or-no label, fitted on every row through sums.

Rows are told apart by small whole-number features alone, so a table of distinct rows and
their numbers of either label (``Cells``) says all. Each level of a tree needs the sums of
gradients and curvatures by node, feature and bin; these come from arrays in memory or, where
the distinct rows are too many, from a pass over the table in which tasks add up their own.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BINS = 32
# Margins are rounded to this many digits, so that few distinct ones tell all of a calibration.
MARGIN_DIGITS = 3


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.raw_margin(x), MARGIN_DIGITS)

    def raw_margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i in range(len(self.value)):
            total += self.tree(i, x)
        return total

    def tree(self, i: int, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[i, node]] > self.threshold[i, node])
        return self.value[i, node - (2**self.depth - 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.of_margin(self.margin(x))

    def of_margin(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


@dataclass(frozen=True)
class Growing:
    """Finished trees and the inner nodes so far of the one that grows."""

    trees: Trees
    feature: np.ndarray
    threshold: np.ndarray
    level: int

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node of each row at this level, from 0."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.level):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return node - (2**self.level - 1)


class Cells:
    """Distinct rows ``x`` that occur ``no`` and ``yes`` times with either label."""

    def __init__(self, cuts: list[np.ndarray], x: np.ndarray, no: np.ndarray, yes: np.ndarray):
        self.x, self.no, self.yes = x, no, yes
        self.bins = np.stack([np.searchsorted(cut, x[:, j], "left") for j, cut in enumerate(cuts)], 1)
        self.margin, self.trees = None, 0

    def sums(self, growing: Growing) -> np.ndarray:
        """Gradients and curvatures by node, feature and bin: ``[2, nodes, features, BINS]``."""
        if self.margin is None:
            self.margin = np.full(len(self.x), growing.trees.base)
        while self.trees < len(growing.trees.value):
            self.margin += growing.trees.tree(self.trees, self.x)
            self.trees += 1
        p = 1 / (1 + np.exp(-self.margin))
        grad = self.yes * (1 - p) - self.no * p
        hess = (self.yes + self.no) * np.maximum(p * (1 - p), 1e-6)
        nodes, width = 2**growing.level, self.x.shape[1]
        at = growing.nodes(self.x) * BINS
        out = np.zeros((2, nodes, width, BINS))
        for j in range(width):
            place = at + self.bins[:, j]
            for k, values in enumerate((grad, hess)):
                out[k, :, j] = np.bincount(place, values, nodes * BINS).reshape(nodes, BINS)
        return out


def quantile_cuts(counts: np.ndarray) -> list[np.ndarray]:
    """Cuts of each feature at its quantiles; ``counts[feature, value]`` are numbers of rows."""
    cuts = []
    for own in counts:
        upto = np.cumsum(own)
        wanted = np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1)
        cuts.append(np.unique(np.searchsorted(upto, wanted, "right")).astype(float) if upto[-1] else np.zeros(1))
    return cuts


def grow(
    share: float,
    cuts: list[np.ndarray],
    sums: Callable[[Growing], np.ndarray],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.3,
    ridge: float = 1.0,
) -> Trees:
    """Newton boosting of the logistic loss; ``sums`` gives those of all rows, see ``Cells``.

    ``share`` is the share of rows with label 1.
    """
    share = np.clip(share, 1e-3, 1 - 1e-3)
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    model = none
    for _ in range(trees):
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth + 1):
            found = sums(Growing(model, feature, threshold, level))
            if level == depth:
                # Any feature's bins add up to the whole leaf.
                grad, hess = found[:, :, 0].sum(2)
                break
            for node in range(2**level):
                gl, hl = np.cumsum(found[0, node], 1), np.cumsum(found[1, node], 1)
                g, h = gl[0, -1], hl[0, -1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                # Rounded, so that the order in which rows were added does not choose among equals.
                best, where = 1e-9, None
                for j, cut in enumerate(cuts):
                    own = np.round(gain[j, : len(cut)], 6)
                    k = int(own.argmax()) if len(own) else 0
                    if len(own) and own[k] > best:
                        best, where = own[k], (j, cut[k])
                if where:
                    feature[2**level - 1 + node], threshold[2**level - 1 + node] = where
        value = np.round(rate * grad / (hess + ridge), 9)
        model = Trees(
            depth,
            np.concatenate([model.feature, feature[None]]),
            np.concatenate([model.threshold, threshold[None]]),
            np.concatenate([model.value, value[None]]),
            none.base,
        )
    return model


def fit(x: np.ndarray, y: np.ndarray, **options) -> Trees:
    """Trees of rows in memory; splits at quantiles of each feature."""
    if not len(y):
        return grow(0.5, [], lambda growing: np.zeros(0), trees=0)
    cuts = [np.unique(np.quantile(own, np.linspace(0, 1, BINS + 1)[1:-1])) for own in x.T]
    return grow(y.mean(), cuts, Cells(cuts, x, 1.0 - y, y).sums, **options)


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """Platt scaling on rows that the trees have not seen."""
    return calibrate_margins(model, model.margin(x), 1.0 - y, y)


def calibrate_margins(model: Trees, m: np.ndarray, no: np.ndarray, yes: np.ndarray, steps: int = 50) -> Trees:
    """The same by how many rows of either label have each margin (Newton steps, smoothed targets)."""
    n, n_yes = no.sum() + yes.sum(), yes.sum()
    if not n:
        return model
    above, below = (n_yes + 1) / (n_yes + 2), 1 / (n - n_yes + 2)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = (no + yes) * np.maximum(p * (1 - p), 1e-9)
        d = yes * (above - p) + no * (below - p)
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * m).sum() - 1e-3 * (a - 1), d.sum()]))
        a, b = a + step[0], b + step[1]
    model.slope, model.shift = float(a), float(b)
    return model
