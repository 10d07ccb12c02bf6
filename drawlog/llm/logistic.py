"""Small dense models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = _sigmoid(z @ w)
            grad = z.T @ (p - y) + penalty * w
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, grad)
            w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Forest:
    """Random forest of binary trees, as flat arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.trees = trees  # per tree: feature (-1 for a leaf), threshold, left child (right is next), chance

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, least: int = 3, bins: int = 32, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        tries = max(1, round(np.sqrt(x.shape[1])))
        out = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            feature, threshold, left, chance = [-1], [0.0], [0], [0.5]
            queue = [(0, rows, 0)]
            while queue:
                at, own, level = queue.pop()
                good = y[own].sum()
                chance[at] = float(good / len(own))
                if level == depth or len(own) < 2 * least or good in (0, len(own)):
                    continue
                best = (1e-9, -1, 0)
                for f in rng.permutation(x.shape[1])[:tries]:
                    n = np.bincount(binned[own, f], minlength=len(cuts[f]) + 1)
                    g = np.bincount(binned[own, f], weights=y[own], minlength=len(cuts[f]) + 1)
                    nl, gl = n.cumsum()[:-1], g.cumsum()[:-1]
                    nr, gr = len(own) - nl, good - gl
                    ok = (nl >= least) & (nr >= least)
                    if not ok.any():
                        continue
                    gini = lambda n, g: 2 * g * (n - g) / np.maximum(n, 1)
                    gain = np.where(ok, gini(len(own), good) - gini(nl, gl) - gini(nr, gr), -1.0)
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), int(f), c)
                if best[1] < 0:
                    continue
                _, f, c = best
                child = len(feature)
                feature[at], threshold[at], left[at] = f, float(cuts[f][c]), child
                feature += [-1, -1]
                threshold += [0.0, 0.0]
                left += [0, 0]
                chance += [0.5, 0.5]
                low = binned[own, f] <= c
                queue += [(child, own[low], level + 1), (child + 1, own[~low], level + 1)]
            out.append((np.array(feature), np.array(threshold), np.array(left), np.array(chance)))
        return cls(out)

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, chance in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at])
                at = np.where(inner, go, at)
            total += chance[at]
        return total / len(self.trees)
