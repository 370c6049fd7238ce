"""A linear-chain conditional random field in numpy: training on few sequences, Viterbi for batches of many."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Training sequences are cut to this many tokens; decoding takes any length.
TRAIN_LENGTH = 24


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    features: dict[str, int]
    emission: np.ndarray  # (features + 1, labels); the last row is zero and stands for unknown features
    transition: np.ndarray

    def decode(self, sequences: list[list[list[str]]]) -> list[list[str]]:
        """The best labels of every sequence, a sequence being a list of tokens, a token a list of features."""
        out: list[list[str]] = [[] for _ in sequences]
        if len(self.labels) < 2:
            return [[self.labels[0]] * len(s) for s in sequences]
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        start = 0
        while start < len(order):
            # like lengths together: padding at most doubles a batch, and a batch has a bounded number of cells
            stop, longest = start, 2 * len(sequences[order[start]])
            while stop < len(order) and len(sequences[order[stop]]) <= longest and (stop - start + 1) * len(sequences[order[stop]]) <= 1 << 16 or stop == start:
                stop += 1
            batch = [sequences[i] for i in order[start:stop]]
            for i, path in zip(order[start:stop], self._viterbi(batch)):
                out[i] = [self.labels[k] for k in path]
            start = stop
        return out

    def scores(self, batch: list[list[list[str]]], length: int) -> np.ndarray:
        none = len(self.emission) - 1
        score = np.zeros((len(batch), length, len(self.labels)))
        for i, tokens in enumerate(batch):
            for t, names in enumerate(tokens[:length]):
                score[i, t] = self.emission[[self.features.get(n, none) for n in names]].sum(0)
        return score

    def _viterbi(self, batch: list[list[list[str]]]) -> list[list[int]]:
        length = len(batch[-1])
        score = self.scores(batch, length)
        sizes = np.array([len(s) for s in batch])
        best, back = score[:, 0], np.zeros((len(batch), length, len(self.labels)), np.int8)
        for t in range(1, length):
            via = best[:, :, None] + self.transition[None]
            back[:, t] = via.argmax(1)
            new = via.max(1) + score[:, t]
            best = np.where((t < sizes)[:, None], new, best)
        at = best.argmax(1)
        paths = np.zeros((len(batch), length), np.int64)
        rows = np.arange(len(batch))
        for t in range(length - 1, -1, -1):
            paths[:, t] = at
            at = np.where(t < sizes, back[rows, t, at], at) if t else at
        return [p[:n].tolist() for p, n in zip(paths, sizes)]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(
    sequences: list[list[list[str]]], tagged: list[list[str]], labels: tuple[str, ...], rounds: int = 60, rate: float = 0.2, decay: float = 1e-3
) -> Model:
    """Maximum likelihood by Adam with a small L2 penalty; features seen once are left out. Deterministic."""
    seen = Counter(f for s in sequences for token in s for f in token)
    features = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    size, none = len(labels), len(features)
    emission, transition = np.zeros((none + 1, size)), np.zeros((size, size))
    if not features or {y for t in tagged for y in t} <= {labels[0]}:
        return Model(labels[:1], {}, np.zeros((1, 1)), np.zeros((1, 1)))
    n, length, width = len(sequences), TRAIN_LENGTH, max(len(t) for s in sequences for t in s)
    x, y, mask = np.full((n, length, width), none), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    number = {label: i for i, label in enumerate(labels)}
    for i, (s, tags) in enumerate(zip(sequences, tagged)):
        for t, (token, tag) in enumerate(zip(s[:length], tags)):
            for k, f in enumerate(token):
                x[i, t, k] = features.get(f, none)
            y[i, t], mask[i, t] = number[tag], True
    gold = np.zeros((n, length, size))
    np.put_along_axis(gold, y[:, :, None], 1.0, 2)
    gold *= mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.bincount((y[:, :-1] * size + y[:, 1:])[both], minlength=size * size).reshape(size, size)
    flat = x.ravel()
    moments = [np.zeros_like(p) for p in (emission, transition, emission, transition)]
    for step in range(1, rounds + 1):
        score = emission[x].sum(2)
        forward = np.zeros((n, length, size))
        forward[:, 0] = score[:, 0]
        for t in range(1, length):
            new = _sum_exp(forward[:, t - 1, :, None] + transition[None], 1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        total = _sum_exp(forward[:, -1], 1)
        backward = np.zeros((n, length, size))
        pairs = np.zeros((size, size))
        for t in range(length - 1, 0, -1):
            after = score[:, t] + backward[:, t]
            joint = forward[:, t - 1, :, None] + transition[None] + after[:, None, :] - total[:, None, None]
            pairs += (np.exp(np.minimum(joint, 0)) * mask[:, t, None, None]).sum(0)
            backward[:, t - 1] = np.where(mask[:, t, None], _sum_exp(transition[None] + after[:, None, :], 2), backward[:, t])
        marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * mask[:, :, None]
        miss = marginal - gold
        grad_e = np.stack([np.bincount(flat, np.repeat(miss[:, :, k].ravel(), width), none + 1) for k in range(size)], 1) / n + decay * emission
        grad_e[none] = 0
        grad_t = (pairs - gold_pairs) / n + decay * transition
        for k, (p, g) in enumerate(((emission, grad_e), (transition, grad_t))):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            p -= rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, features, emission, transition)
