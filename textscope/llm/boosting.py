"""Gradient-boosted trees for a bounded labelled sample, written out as SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """trees: nested (feature, threshold, left, right) or leaf floats; left takes
    values up to the threshold."""

    bias: float
    trees: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if not isinstance(node, tuple):
                out[rows] += node
                return
            f, t, left, right = node
            below = x[rows, f] <= t
            walk(left, rows[below])
            walk(right, rows[~below])

        out = np.full(len(x), self.bias)
        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out

    def sql(self, names: list[str]) -> str:
        """Probability as a SQL expression of the named features."""

        def text(node) -> str:
            if not isinstance(node, tuple):
                return f"{node!r}D"
            f, t, left, right = node
            return f"if({names[f]} <= {t!r}D, {text(left)}, {text(right)})"

        total = " + ".join([f"{self.bias!r}D", *map(text, self.trees)])
        return f"(1D / (1D + exp(-({total}))))"


def _grow(x, gradient, hessian, rows, depth, ridge, least):
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values = x[order, f]
            cut = np.flatnonzero(np.diff(values) > 0)
            cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
            if not len(cut):
                continue
            gl, hl = np.cumsum(gradient[order])[cut], np.cumsum(hessian[order])[cut]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((values[cut[k]] + values[cut[k] + 1]) / 2))
    _, f, t = best
    if f is None:
        return float(-g / (h + ridge))
    below = x[rows, f] <= t
    return (f, t, *(_grow(x, gradient, hessian, part, depth - 1, ridge, least) for part in (rows[below], rows[~below])))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting of the logistic loss; the same data give the same trees."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(share / (1 - share))), [])

    def shrunk(node):
        return node * rate if not isinstance(node, tuple) else (*node[:2], *map(shrunk, node[2:]))

    margin = model.margin(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = shrunk(_grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, ridge, least))
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).margin(x)
    return model


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out precision is at least as asked."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero((right >= precision) & np.concatenate([np.diff(p[order]) < 0, [True]]))
    return float(p[order][fine[-1]]) if len(fine) else 1.1
