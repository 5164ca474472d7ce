"""Small numpy fits of one daily series, used inside grouped tasks.

A group is one series (and fold, target, component), so its rows are bounded by
the calendar.  Spark deals the groups out; nothing here sees more than one.
"""

from __future__ import annotations

import numpy as np


def quantile_bins(x: np.ndarray, bins: int) -> list:
    """Cut points of each column."""
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]


def binned(x: np.ndarray, cuts: list) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)


class Trees:
    """Boosted regression trees on binned columns, weighted squared loss.

    ``rounds`` grows until ``patience`` rounds pass without a lower absolute error on
    the holdout rows (or ``max_rounds``); ``fit_all`` then fits all rows with the best
    number of rounds.  ``subsample`` and ``features`` are the shares of rows and
    columns that a tree may use.
    """

    def __init__(self, depth: int, rate: float, min_leaf: int, max_rounds: int, patience: int,
                 subsample: float, features: float, bins: int, seed: int):
        self.depth, self.rate, self.min_leaf = depth, rate, min_leaf
        self.max_rounds, self.patience = max_rounds, patience
        self.subsample, self.features, self.bins, self.seed = subsample, features, bins, seed

    def _tree(self, xb: np.ndarray, r: np.ndarray, w: np.ndarray, rng, gain: np.ndarray):
        n, f = xb.shape
        cols = rng.permutation(f)[:max(1, round(self.features * f))]
        use = rng.random(n) < self.subsample
        xs, rs, ws = xb[use][:, cols], r[use], w[use]
        node, split = np.zeros(len(xs), np.int64), []
        width = self.bins + 1
        for level in range(self.depth):
            k = 1 << level
            at = ((node[:, None] * len(cols) + np.arange(len(cols))) * width + xs).ravel()
            size = k * len(cols) * width
            count, sw, swr = (np.bincount(at, np.repeat(v, len(cols)), size).reshape(k, len(cols), width).cumsum(axis=2)
                              for v in (np.ones(len(xs)), ws, ws * rs))
            left = (count[..., :-1], sw[..., :-1], swr[..., :-1])
            right = tuple(a[..., -1:] - b for a, b in zip((count, sw, swr), left))
            whole = swr[..., -1:] ** 2 / np.maximum(sw[..., -1:], 1e-12)
            score = left[2] ** 2 / np.maximum(left[1], 1e-12) + right[2] ** 2 / np.maximum(right[1], 1e-12) - whole
            score[(left[0] < self.min_leaf) | (right[0] < self.min_leaf)] = -np.inf
            best = score.reshape(k, -1).argmax(axis=1)
            value = score.reshape(k, -1).max(axis=1)
            col, cut = cols[best // (width - 1)], best % (width - 1)
            cut = np.where(value > 1e-12, cut, width)            # no split: all rows go left
            for c, v in zip(col[value > 1e-12], value[value > 1e-12]):
                gain[c] += v
            split.append((col, cut))
            node = node * 2 + (xb[use][np.arange(len(xs)), col[node]] > cut[node])
        sw, swr = np.bincount(node, ws, 1 << self.depth), np.bincount(node, ws * rs, 1 << self.depth)
        return split, swr / np.maximum(sw, 1e-12)

    @staticmethod
    def _apply(tree, xb: np.ndarray) -> np.ndarray:
        split, leaf = tree
        node = np.zeros(len(xb), np.int64)
        for col, cut in split:
            node = node * 2 + (xb[np.arange(len(xb)), col[node]] > cut[node])
        return leaf[node]

    def _boost(self, xb, y, w, rounds, held=None):
        rng, gain = np.random.default_rng(self.seed), np.zeros(xb.shape[1])
        base = float(np.average(y, weights=w))
        p, trees = np.full(len(y), base), []
        q = np.full(len(held[0]), base) if held else None
        best, best_error = 0, np.mean(np.abs(held[1] - q)) if held else 0.0
        for i in range(rounds):
            t = self._tree(xb, y - p, w, rng, gain)
            trees.append(t)
            p += self.rate * self._apply(t, xb)
            if held:
                q += self.rate * self._apply(t, held[0])
                error = np.mean(np.abs(held[1] - q))
                if error < best_error:
                    best, best_error = i + 1, error
                elif i + 1 - best >= self.patience:
                    break
        return base, trees, gain, best

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, holdout: np.ndarray):
        """``holdout`` marks the rows that pick the number of rounds."""
        self.cuts = quantile_bins(x, self.bins)
        xb = binned(x, self.cuts)
        self.best_round = self.max_rounds
        if holdout.any() and not holdout.all():
            a = ~holdout
            self.best_round = self._boost(xb[a], y[a], w[a], self.max_rounds, (xb[holdout], y[holdout]))[3]
        self.base, self.trees, self.gain, _ = self._boost(xb, y, w, self.best_round)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        xb = binned(x, self.cuts)
        return self.base + self.rate * sum((self._apply(t, xb) for t in self.trees), np.zeros(len(x)))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float):
    """(predict) of ||y - Zw - b||^2 + alpha ||w||^2 on z-scored columns."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd == 0, 1.0, sd)
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda v: ((v - mu) / sd) @ w + y.mean()


def trend_season(days: np.ndarray, doy: np.ndarray, dow: np.ndarray, flags: np.ndarray, y: np.ndarray,
                 changepoints: int, yearly: int, weekly: int, reg: float, trend_reg: float):
    """(predict) of a piecewise linear trend + Fourier seasons + campaign flags.

    Hinges stand over the first 80% of the span and are held back by ``trend_reg``.
    After the last day seen the trend stays where it is: a slope fitted to a few
    months isn't carried years ahead."""
    first, last = days.min(), days.max()
    span = max(last - first, 1)
    at = first + span * 0.8 * np.arange(1, changepoints + 1) / (changepoints + 1)

    def design(d, doy, dow, flags):
        t = np.minimum(d, last)
        cols = [(t - first) / 365.25, *[np.maximum(t - c, 0) / 365.25 for c in at]]
        for k in range(1, yearly + 1):
            cols += [np.sin(2 * np.pi * k * doy / 365.25), np.cos(2 * np.pi * k * doy / 365.25)]
        for k in range(1, weekly + 1):
            cols += [np.sin(2 * np.pi * k * dow / 7), np.cos(2 * np.pi * k * dow / 7)]
        return np.column_stack([*cols, flags])

    x = design(days, doy, dow, flags)
    mu = x.mean(axis=0)
    penalty = np.full(x.shape[1], reg)
    penalty[1:1 + changepoints] = trend_reg
    c = x - mu
    w = np.linalg.solve(c.T @ c + np.diag(penalty + 1e-9), c.T @ (y - y.mean()))
    return lambda *v: (design(*v) - mu) @ w + y.mean()
