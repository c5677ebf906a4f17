"""Gradient-boosted trees for two classes on a bounded matrix, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of depth 2: (feature, cut, left (feature, cut), right (feature, cut), four leaf values)."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, cut, (lf, lcut), (rf, rcut), leaves in self.trees:
            right = x[:, f] > cut
            inner = np.where(right, x[:, rf] > rcut, x[:, lf] > lcut)
            z += np.asarray(leaves)[2 * right + inner]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _split(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, ridge: float) -> tuple[float, int, float]:
    """(gain, feature, cut) of the best split, over up to 32 cuts for each feature."""
    best = (0.0, 0, np.inf)
    g, h = slope.sum(), bend.sum()
    if len(x) < 2:
        return best
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1], method="lower")):
            left = x[:, f] <= cut
            gl, hl = slope[left].sum(), bend[left].sum()
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, f, float(cut))
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Trees fit to the logistic loss of labels y in {0, 1} by second-order steps."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    z = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        slope, bend = p - y, p * (1 - p)
        gain, f, cut = _split(x, slope, bend, ridge)
        if gain <= 1e-6:
            break
        right = x[:, f] > cut
        inner, leaves = np.zeros(len(x), bool), []
        children = []
        for side in (~right, right):
            _, cf, ccut = _split(x[side], slope[side], bend[side], ridge)
            inner[side] = x[side, cf] > ccut
            children.append((cf, ccut))
        leaf = 2 * right + inner
        for k in range(4):
            own = leaf == k
            leaves.append(float(-rate * slope[own].sum() / (bend[own].sum() + ridge)))
        model.trees.append((f, cut, *children, tuple(leaves)))
        z += np.array(leaves)[leaf]
    return model
