"""Listwise steps inside a task: a few weights, copied to every shard and averaged after a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .lazy import BETA1, BETA2, EPS, lists



class Adam:
    """Moments of a parameter array, and its steps."""

    def __init__(self, values: np.ndarray, first: np.ndarray, second: np.ndarray, steps: int, lr: float):
        self.values, self.first, self.second = values, first, second
        self.steps, self.lr = steps, lr

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.first = BETA1 * self.first + (1 - BETA1) * gradient
        self.second = BETA2 * self.second + (1 - BETA2) * gradient**2
        mean = self.first / (1 - BETA1**self.steps)
        spread = np.sqrt(self.second / (1 - BETA2**self.steps))
        self.values = self.values - self.lr * mean / (spread + EPS)


def listwise_round(weights, first, second, lr: float, decay: float, count: int, steps: int, clip: float, seed: int):
    """The part of a round that one shard of ranking sets takes, under the softmax loss: a function of its rows.

    The sets are taken in a seeded order in ``count`` steps of even size, the steps ``steps + 1``
    and on; a step that has no set is left out. Rows have ``set``, ``row_id``, ``label`` and ``x``;
    the result is one row with the weights, the moments, the sets and the loss.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("set", "ascending"), ("row_id", "ascending")])
        x = lists(rows.column("x"))
        label = rows.column("label").to_numpy().astype(float)
        key = rows.column("set").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(start, append=len(key))
        adam = Adam(np.array(weights), np.array(first), np.array(second), steps, lr)
        order = np.random.default_rng((seed, steps, len(start))).permutation(len(start))
        lost = 0.0
        for number, pick in enumerate(np.array_split(order, count)):
            if not len(pick):
                continue
            adam.steps = steps + number
            n = size[pick]
            at_ = np.concatenate(([0], np.cumsum(n)[:-1]))
            index = np.arange(n.sum()) + np.repeat(start[pick] - at_, n)
            score = x[index] @ adam.values
            score -= np.repeat(np.maximum.reduceat(score, at_), n)
            mass = np.repeat(np.add.reduceat(np.exp(score), at_), n)
            target = label[index] / np.repeat(np.maximum(np.add.reduceat(label[index], at_), 1e-9), n)
            lost -= float((target * (score - np.log(mass))).sum())
            gradient = x[index].T @ (np.exp(score) / mass - target) / len(pick) + decay * adam.values
            norm = float(np.linalg.norm(gradient))
            adam.step(gradient * min(1.0, clip / norm) if norm else gradient)
        wrap = lambda v: pa.array([v.tolist()], pa.list_(pa.float64()))
        return pa.table(
            {"w": wrap(adam.values), "m": wrap(adam.first), "u": wrap(adam.second),
             "sets": [len(start)], "loss": [lost]}
        )

    return run
