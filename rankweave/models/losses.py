"""Losses of rows of embedded ids, with their gradients, for the local steps of a round.

A loss says which columns of the rows it reads, and gives the gradient of the rows' own parameters
(one row an id: a weight, then the factors) and of the dense ones (one flat vector).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .lazy import lists, scatter


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def fm_parts(params: np.ndarray, ids: np.ndarray):
    """Logits of rows of ids without bias, and the pieces their gradients need.

    `params` has the weight in its first column and the factors in the others.
    """
    own = params[ids]
    total = own[:, :, 1:].sum(axis=1)
    square = (own[:, :, 1:] ** 2).sum(axis=(1, 2))
    return own[:, :, 0].sum(axis=1) + 0.5 * ((total**2).sum(axis=1) - square), own, total


def fm_gradient(size: int, ids: np.ndarray, pull: np.ndarray, own: np.ndarray, total: np.ndarray):
    """Gradient of every parameter, given the derivative of the loss by each row's logit."""
    parts = np.empty_like(own)
    parts[:, :, 0] = 1.0
    parts[:, :, 1:] = total[:, None, :] - own[:, :, 1:]
    parts *= pull[:, None, None]
    return scatter(size, ids, parts)


class PointLoss:
    """Log loss of a factorization machine; the first dense value is the bias."""

    def read(self, rows: pa.Table) -> dict[str, np.ndarray]:
        return {"ids": lists(rows.column("ids")), "label": rows.column("label").to_numpy()}

    def gradient(self, params, ids, dense, rows, rng):
        z, own, total = fm_parts(params, ids)
        pull = (sigmoid(z + dense[0]) - rows["label"]) / len(ids)
        whole = np.zeros_like(dense)
        whole[0] = pull.sum()
        return fm_gradient(len(params), ids, pull, own, total), whole


class PairLoss:
    """Logistic loss of the difference of two rows; nothing dense, the bias cancels."""

    def read(self, rows: pa.Table) -> dict[str, np.ndarray]:
        both = [lists(rows.column(c)) for c in ("ids", "other")]
        return {"ids": np.concatenate(both, axis=1)}

    def gradient(self, params, ids, dense, rows, rng):
        half = ids.shape[1] // 2
        both = np.concatenate((ids[:, :half], ids[:, half:]))
        z, own, total = fm_parts(params, both)
        n = len(ids)
        pull = -sigmoid(z[n:] - z[:n]) / n
        return fm_gradient(len(params), both, np.concatenate((pull, -pull)), own, total), np.zeros_like(dense)


@dataclass
class Tower:
    """A network on embedded ids: a hidden layer over all embeddings and numbers, plus the
    factorization term and the linear terms, one output a task."""

    fields: int
    factors: int
    numbers: int
    hidden: int
    weights: list[float]
    dropout: float = 0.0

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        tasks = len(self.weights)
        wide = self.fields * self.factors + self.numbers
        return {
            "w1": (wide, self.hidden), "b1": (self.hidden,), "w2": (self.hidden, tasks), "b2": (tasks,),
            "numeric": (self.numbers, tasks), "projection": (tasks,),
        }

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def start(self, seed: int) -> np.ndarray:
        """Dense values at the start: uniform within one over the root of the inputs."""
        rng = np.random.default_rng(seed)
        reach = {"w1": self.shapes["w1"][0], "b1": self.shapes["w1"][0], "w2": self.hidden, "b2": self.hidden,
                 "numeric": self.numbers, "projection": 1}
        parts = [rng.uniform(-1, 1, s).ravel() / max(reach[n], 1) ** 0.5 for n, s in self.shapes.items()]
        return np.concatenate(parts)

    def parts(self, dense: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = dense[at : at + size].reshape(shape)
            at += size
        return out

    def read(self, rows: pa.Table) -> dict[str, np.ndarray]:
        numbers = lists(rows.column("numbers")) if self.numbers else np.zeros((len(rows), 0))
        return {"ids": lists(rows.column("ids")), "numbers": numbers, "label": lists(rows.column("labels"))}

    def forward(self, own: np.ndarray, numbers: np.ndarray, dense: np.ndarray, mask=None):
        """Logits by task; `own` is (rows, fields, 1 + factors)."""
        d = self.parts(dense)
        vectors = own[:, :, 1:]
        total = vectors.sum(axis=1)
        pairs = 0.5 * (total**2 - (vectors**2).sum(axis=1)).sum(axis=1)
        x = np.concatenate((vectors.reshape(len(own), -1), numbers), axis=1)
        hidden = np.maximum(x @ d["w1"] + d["b1"], 0.0)
        if mask is not None:
            hidden = hidden * mask
        z = hidden @ d["w2"] + d["b2"] + numbers @ d["numeric"]
        z = z + pairs[:, None] * d["projection"] + own[:, :, 0].sum(axis=1)[:, None]
        return z, (d, total, pairs, x, hidden)

    def gradient(self, params, ids, dense, rows, rng):
        own, numbers = params[ids], rows["numbers"]
        mask = None
        if self.dropout:
            mask = (rng.random((len(ids), self.hidden)) >= self.dropout) / (1 - self.dropout)
        z, (d, total, pairs, x, hidden) = self.forward(own, numbers, dense, mask)
        pull = (sigmoid(z) - rows["label"]) * np.array(self.weights) / z.size
        back = pull @ d["w2"].T
        back = np.where(hidden > 0, back if mask is None else back * mask, 0.0)
        whole = [x.T @ back, back.sum(0), hidden.T @ pull, pull.sum(0), numbers.T @ pull, pairs @ pull]
        grown = np.zeros(len(dense))
        flat = np.concatenate([w.ravel() for w in whole])
        grown[: len(flat)] = flat
        parts = np.empty_like(own)
        parts[:, :, 0] = pull.sum(axis=1)[:, None]
        wide = (back @ d["w1"].T)[:, : self.fields * self.factors]
        parts[:, :, 1:] = wide.reshape(len(ids), self.fields, self.factors)
        parts[:, :, 1:] += (pull @ d["projection"])[:, None, None] * (total[:, None, :] - own[:, :, 1:])
        return scatter(len(params), ids, parts), grown
