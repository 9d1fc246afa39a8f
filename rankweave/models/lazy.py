"""Adam on a table of parameters of which a step touches a few.

A parameter that no row of a step touches has no gradient there, yet its moments fade and still
move it. That is made up for when the parameter is next read: the fading is a power, the movement
a geometric series with known sums. L2 and decay are charged with the steps that touch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
#: how the movement of an untouched parameter shrinks from step to step
FADE = BETA1 / BETA2**0.5
#: steps after which the corrections for the start are 1 in double precision
SETTLED = 1 << 16
#: up to this many bytes of parameters are broadcast to score rows, more are joined
BROADCAST_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _series() -> np.ndarray:
    """By steps taken: the sum over all later steps of the fading movement, corrected for the start."""
    t = np.arange(1, SETTLED + 1)
    factor = np.sqrt(1 - BETA2**t) / (1 - BETA1**t)
    out = np.empty(SETTLED + 1)
    out[SETTLED] = FADE / (1 - FADE)
    for s in range(SETTLED - 1, -1, -1):
        out[s] = FADE * (factor[s] + out[s + 1])
    return out


def fading(since: np.ndarray, now: int) -> np.ndarray:
    """The movement between two steps, in units of rate * first / sqrt(second)."""
    series = _series()
    gap = now - since
    return series[np.minimum(since, SETTLED)] - FADE**gap * series[min(now, SETTLED)]


class LazyAdam:
    """Parameters (one row each) with their moments and the step up to which they are current."""

    def __init__(self, values, first, second, at, lr: float, l2: float = 0.0, decay: float = 0.0):
        self.values, self.first, self.second, self.at = values, first, second, at
        self.lr, self.l2, self.decay = lr, l2, decay

    def catch_up(self, rows, now: int) -> None:
        """Brings `rows` (numbers or a slice) to the state after step `now`."""
        since = self.at[rows]
        gap = (now - since)[:, None]
        moved = self.lr * fading(since, now)[:, None]
        # the floor of the spread, as the first of these steps has it
        floor = EPS * np.sqrt(1 - BETA2 ** (since + 1.0))[:, None]
        self.values[rows] -= moved * self.first[rows] / (np.sqrt(self.second[rows]) + floor)
        self.first[rows] *= BETA1**gap
        self.second[rows] *= BETA2**gap
        self.at[rows] = now

    def step(self, rows, gradient: np.ndarray, now: int) -> None:
        """Step `now` of `rows`, which are current up to the step before."""
        values = self.values[rows]
        gradient = gradient + self.l2 * values
        first = BETA1 * self.first[rows] + (1 - BETA1) * gradient
        second = BETA2 * self.second[rows] + (1 - BETA2) * gradient**2
        mean = first / (1 - BETA1**now)
        spread = np.sqrt(second / (1 - BETA2**now))
        self.values[rows] = values * (1 - self.lr * self.decay) - self.lr * mean / (spread + EPS)
        self.first[rows], self.second[rows], self.at[rows] = first, second, now


def lists(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of an array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def as_lists(values: np.ndarray) -> pa.Array:
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values).ravel()), values.shape[1])
    return flat.cast(pa.list_(flat.type.value_type))


def array_of(params, rows: int, width: int) -> np.ndarray:
    """A small table (id, p) as an array; ids below 0 count from its end."""
    table = params.toArrow()
    out = np.zeros((rows, width))
    if table.num_rows:
        out[table.column("id").to_numpy()] = lists(table.column("p"))
    return out


def scatter(size: int, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums of `parts` by id."""
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    out = np.zeros((size, parts.shape[-1]))
    out[flat[order][first]] = np.add.reduceat(parts.reshape(-1, parts.shape[-1])[order], first, axis=0)
    return out


def train_shard(loss, lr: float, l2: float, decay: float, first: int, count: int, seed: int):
    """The pass of one shard of a round: a function of its rows and its parameters.

    Rows are taken in a seeded order in `count` steps of even size, the steps `first + 1` and on;
    a step that has no row is left out. `loss` reads its columns (`loss.read`), tells the ids of
    rows, and gives gradients. Parameters come as `id, at, p, m, u`; ids below 0 are the dense
    ones, `width` values each, from -1 downwards.
    """

    def run(rows: pa.Table, params: pa.Table) -> pa.Table:
        params = params.sort_by("id")
        known = params.column("id").to_numpy()
        state = [lists(params.column(c)).astype(float) for c in ("p", "m", "u")]
        adam = LazyAdam(*state, params.column("at").to_numpy().copy(), lr, l2, decay)
        rows = rows.sort_by("row_id")
        data = loss.read(rows)
        dense = int(np.searchsorted(known, 0))
        ids = np.searchsorted(known, data["ids"])
        touched = np.bincount(ids.ravel(), minlength=len(known))
        touched[:dense] = len(ids)
        rng = np.random.default_rng((seed, first, len(ids)))
        order = rng.permutation(len(ids))
        for now, pick in enumerate(np.array_split(order, count), first + 1):
            if not len(pick):
                continue
            own, local = np.unique(ids[pick], return_inverse=True)
            local = local.reshape(len(pick), -1)
            adam.catch_up(own, now - 1)
            adam.catch_up(slice(0, dense), now - 1)
            flat = adam.values[:dense][::-1].ravel()
            part = {n: v[pick] for n, v in data.items() if n != "ids"}
            gradient, whole = loss.gradient(adam.values[own], local, flat, part, rng)
            adam.step(own, gradient, now)
            if dense:
                adam.step(slice(0, dense), whole.reshape(dense, -1)[::-1], now)
        adam.catch_up(slice(0, len(known)), first + count)
        return pa.table(
            {
                "id": known,
                "touched": touched,
                "s": as_lists(np.concatenate((adam.values, adam.first, adam.second), axis=1)),
            }
        )

    return run
