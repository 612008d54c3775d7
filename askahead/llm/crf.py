"""A linear-chain conditional random field over hashed features, with three tags: outside, begin, inside."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS, BUCKETS = 3, 1 << 13
# An inside tag needs a begin or inside tag before it.
_FORBIDDEN = -1e4


def bucket(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode()) % (BUCKETS - 1)


@dataclass
class Crf:
    """``weights`` (buckets, tags) for the features of a token, ``steps`` (tag, next tag) between neighbours."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in features]).reshape(-1, TAGS)

    def viterbi(self, features: list[list[int]], joined: list[bool]) -> list[int]:
        """Best tags; a token that is not ``joined`` to the one before cannot be inside."""
        if not features:
            return []
        score = self.emissions(features)
        for i, j in enumerate(joined):
            if not j:
                score[i, INSIDE] += _FORBIDDEN
        steps = self.steps.copy()
        steps[OUTSIDE, INSIDE] += _FORBIDDEN
        best, back = score[0].copy(), []
        best[INSIDE] += _FORBIDDEN
        for row in score[1:]:
            paths = best[:, None] + steps
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        tags = [int(best.argmax())]
        for pointers in reversed(back):
            tags.append(int(pointers[tags[-1]]))
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(
    sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 80, rate: float = 0.1, penalty: float = 1e-3
) -> Crf:
    """Maximum penalised likelihood by Adam over all sequences at once; none gives a field that tags all outside."""
    weights, steps = np.zeros((BUCKETS, TAGS)), np.zeros((TAGS, TAGS))
    sequences = [s for s in sequences if s[1]]
    if not sequences:
        weights[:, OUTSIDE] = 1.0
        return Crf(weights, steps)
    n, length = len(sequences), max(len(t) for _, t in sequences)
    width = max(len(f) for fs, _ in sequences for f in fs)
    features = np.zeros((n, length, width), np.int64)  # bucket 0 is no feature
    tags, sizes = np.zeros((n, length), np.int64), np.zeros(n, np.int64)
    for i, (fs, ts) in enumerate(sequences):
        sizes[i] = len(ts)
        tags[i, : len(ts)] = ts
        for j, f in enumerate(fs):
            features[i, j, : len(f)] = f
    live = np.arange(length) < sizes[:, None]
    truth = np.eye(TAGS)[tags] * live[..., None]
    pairs = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    moments = [np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(weights), np.zeros_like(steps)]
    flat = features.reshape(-1)
    for round_no in range(1, rounds + 1):
        score = weights[features].sum(axis=2)
        forward = np.empty_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, length):
            moved = _log_sum(forward[:, t - 1, :, None] + steps, 1) + score[:, t]
            forward[:, t] = np.where(live[:, t, None], moved, forward[:, t - 1])
        total = _log_sum(forward[:, -1], 1)
        backward = np.zeros_like(score)
        expected = np.zeros((TAGS, TAGS))
        for t in range(length - 2, -1, -1):
            after = score[:, t + 1] + backward[:, t + 1]
            moved = _log_sum(steps + after[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], moved, 0.0)
            joint = np.exp(forward[:, t, :, None] + steps + after[:, None, :] - total[:, None, None])
            expected += (joint * live[:, t + 1, None, None]).sum(axis=0)
        marginal = np.exp(forward + backward - total[:, None, None]) * live[..., None]
        error = (marginal - truth).reshape(-1, TAGS)
        slope = np.stack(
            [np.bincount(flat, np.repeat(error[:, k], width), BUCKETS) for k in range(TAGS)], axis=1
        ) / n + penalty * weights
        slope[0] = 0
        for i, (value, grad) in enumerate(((weights, slope), (steps, (expected - pairs) / n + penalty * steps))):
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * grad**2
            mean, spread = moments[i] / (1 - 0.9**round_no), moments[i + 2] / (1 - 0.99**round_no)
            value -= rate * mean / (np.sqrt(spread) + 1e-8)
    return Crf(weights, steps)
