"""Small linear-chain conditional random field in numpy; sequences are scored in padded batches."""

from __future__ import annotations

import numpy as np


class LinearChain:
    def __init__(self, tags: int, features: int):
        self.emit = np.zeros((features, tags))
        self.move = np.zeros((tags, tags))
        self.start = np.zeros(tags)

    def _log_sums(self, x: np.ndarray, mask: np.ndarray):
        scores = x @ self.emit
        n, length, _ = scores.shape
        alpha = np.empty_like(scores)
        alpha[:, 0] = scores[:, 0] + self.start
        for t in range(1, length):
            step = _lse(alpha[:, t - 1, :, None] + self.move, 1) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        beta = np.zeros_like(scores)
        for t in range(length - 2, -1, -1):
            step = _lse(self.move + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        return scores, alpha, beta, _lse(alpha[:, -1], 1)

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Maximum likelihood by Adagrad on the whole (bounded) training batch."""
        n, tags = len(x), self.emit.shape[1]
        onehot = np.eye(tags)[y] * mask[..., None]
        # rows of like length are worked on together, without the padding the longest ones need
        sizes = mask.sum(1)
        groups = []
        for part in np.array_split(np.argsort(sizes, kind="stable"), min(8, n)):
            most = max(int(sizes[part].max()), 1)
            inside = mask[part, :most]
            groups.append((x[part, :most], inside, onehot[part, :most], inside[:, 1:] & inside[:, :-1]))
        seen = sum(np.einsum("nti,ntj->ij", o[:, :-1] * p[..., None], o[:, 1:]) for _, _, o, p in groups)
        sums = [np.full_like(p, 1e-6) for p in (self.emit, self.move, self.start)]
        for _ in range(rounds):
            emit, move, start = -decay * self.emit, seen / n - decay * self.move, -decay * self.start
            for xs, inside, o, pairs in groups:
                scores, alpha, beta, z = self._log_sums(xs, inside)
                node = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
                edge = np.exp(alpha[:, :-1, :, None] + self.move + (scores + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
                emit = emit + np.tensordot(xs, o - node, ((0, 1), (0, 1))) / n
                move = move - edge.sum((0, 1)) / n
                start = start + (o[:, 0] - node[:, 0]).sum(0) / n
            for p, g, s in zip((self.emit, self.move, self.start), (emit, move, start), sums):
                s += g * g
                p += rate * g / np.sqrt(s)

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tag sequence of each row (Viterbi); places outside the mask hold no meaning."""
        scores = x @ self.emit
        n, length, tags = scores.shape
        best = scores[:, 0] + self.start
        back = np.zeros((n, length, tags), np.int8)
        for t in range(1, length):
            paths = best[:, :, None] + self.move
            back[:, t] = paths.argmax(1)
            step = paths.max(1) + scores[:, t]
            inside = mask[:, t, None]
            back[:, t] = np.where(inside, back[:, t], np.arange(tags))
            best = np.where(inside, step, best)
        out = np.zeros((n, length), np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + np.squeeze(top, axis)
