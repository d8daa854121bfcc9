"""A linear-chain conditional random field over tokens with sparse binary features.

Training maximises the log-likelihood by AdaGrad over padded batches (forward
and backward sums in log space); decoding is Viterbi. Features are strings,
hashed to a fixed number of weights, so the model has a fixed size.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Hashed feature slots.
SLOTS = 1 << 15


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SLOTS - 1)


class Crf:
    """``labels`` classes; ``w`` the weights of features by label, ``t`` those of label pairs, ``begin`` those of a chain's first label."""

    def __init__(self, labels: int):
        self.w = np.zeros((SLOTS + 1, labels))  # the last slot is padding and stays zero
        self.t = np.zeros((labels, labels))
        self.begin = np.zeros(labels)

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        """(tokens, labels) emission scores of a chain."""
        lens = [len(f) for f in feats]
        flat = self.w[np.concatenate([np.asarray(f, dtype=np.int64) for f in feats])]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0)

    def viterbi(self, feats: list[list[int]], joins: list[bool] | None = None) -> list[int]:
        """The best labels of a chain; of equal ones the lower label. Where ``joins``
        is given, the last label is possible only for tokens at which it holds."""
        e = self.scores(feats)
        if joins is not None:
            e[~np.asarray(joins), -1] = -1e9
        best, back = self.begin + e[0], []
        for row in e[1:]:
            step = best[:, None] + self.t
            k = step.argmax(axis=0)
            back.append(k)
            best = step[k, np.arange(len(k))] + row
        path = [int(best.argmax())]
        for k in reversed(back):
            path.append(int(k[path[-1]]))
        return path[::-1]

    def fit(self, chains: list[tuple[list[list[int]], list[int]]], epochs: int, rate: float, l2: float, seed: int) -> Crf:
        """Trains on (features, labels) chains in seeded order."""
        rng, labels = np.random.default_rng(seed), len(self.begin)
        gw, gt, gb = np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8), np.full_like(self.begin, 1e-8)
        width = max(len(f) for feats, _ in chains for f in feats)
        for _ in range(epochs):
            order = rng.permutation(len(chains))
            for start in range(0, len(order), 64):
                part = [chains[i] for i in order[start : start + 64]]
                n, m = len(part), max(len(y) for _, y in part)
                x = np.full((n, m, width), SLOTS)
                y = np.zeros((n, m), dtype=int)
                real = np.zeros((n, m), dtype=bool)
                for i, (feats, lab) in enumerate(part):
                    for j, f in enumerate(feats):
                        x[i, j, : len(f)] = f
                    y[i, : len(lab)], real[i, : len(lab)] = lab, True
                e = self.w[x].sum(axis=2)
                a, b = np.empty((n, m, labels)), np.zeros((n, m, labels))
                a[:, 0] = self.begin + e[:, 0]
                for j in range(1, m):
                    new = np.logaddexp.reduce(a[:, j - 1, :, None] + self.t, axis=1) + e[:, j]
                    a[:, j] = np.where(real[:, j, None], new, a[:, j - 1])
                for j in range(m - 2, -1, -1):
                    new = np.logaddexp.reduce(self.t + (e[:, j + 1] + b[:, j + 1])[:, None, :], axis=2)
                    b[:, j] = np.where(real[:, j + 1, None], new, 0)
                z = np.logaddexp.reduce(a[:, -1], axis=1)
                node = np.exp(a + b - z[:, None, None]) * real[:, :, None]
                one = np.eye(labels)[y] * real[:, :, None]
                diff = (one - node) / n
                dt = np.zeros_like(self.t)
                for j in range(1, m):
                    pair = np.exp(a[:, j - 1, :, None] + self.t + (e[:, j] + b[:, j])[:, None, :] - z[:, None, None])
                    pair *= real[:, j, None, None]
                    dt += (one[:, j - 1, :, None] * one[:, j, None, :] - pair).sum(axis=0) / n
                dw = np.zeros_like(self.w)
                np.add.at(dw, x.reshape(-1), np.repeat(diff, width, axis=1).reshape(-1, labels))
                dw[SLOTS] = 0
                touched = np.unique(x)
                dw[touched] -= l2 * self.w[touched]
                for value, grad, sums in ((self.w, dw, gw), (self.t, dt, gt), (self.begin, diff[:, 0].sum(axis=0), gb)):
                    sums += grad * grad
                    value += rate * grad / np.sqrt(sums)
                self.w[SLOTS] = 0
        return self
