"""Fitting an encoder to pairs of queries and texts: a projection of another encoder's vectors, by contrast within batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.embed import Encoder, HashingEncoder


@dataclass
class Arguments:
    """most_pairs bounds the sample that is fitted on: pairs of least hash, collected to the driver."""

    epochs: int = 5
    batch: int = 64
    rate: float = 0.5
    temperature: float = 0.1
    held_out: float = 0.1
    most_pairs: int = 50_000
    seed: int = 42


@dataclass
class State:
    """What callbacks see and may change: stop ends the fitting after the epoch."""

    epoch: int = 0
    loss: float = float("inf")
    held_out_loss: float = float("inf")
    best: float = float("inf")
    stop: bool = False
    weights: np.ndarray | None = None
    history: list[tuple[float, float]] = field(default_factory=list)


class Callback:
    def begin(self, state: State) -> None: ...

    def epoch_end(self, state: State) -> None: ...

    def end(self, state: State) -> None: ...


class EarlyStopping(Callback):
    """Stops after patience epochs without a held-out loss that is lower by least."""

    def __init__(self, patience: int = 2, least: float = 0.0):
        self.patience, self.least, self.bad, self.best = patience, least, 0, float("inf")

    def epoch_end(self, state: State) -> None:
        if state.held_out_loss < self.best - self.least:
            self.best, self.bad = state.held_out_loss, 0
        else:
            self.bad += 1
            state.stop = state.stop or self.bad >= self.patience


class SaveBest(Callback):
    """Writes the weights of the lowest held-out loss to a file of the driver."""

    def __init__(self, path: str):
        self.path = path

    def epoch_end(self, state: State) -> None:
        if state.held_out_loss <= state.best:
            np.save(self.path, state.weights)


class Projected:
    """An encoder: unit vectors of another encoder's times a matrix."""

    def __init__(self, base: Encoder, weights: np.ndarray):
        self.base, self.weights, self.dimension = base, weights, weights.shape[1]

    def encode(self, text: Column) -> Column:
        weights, size = self.weights, self.dimension

        def run(vectors: pa.Array) -> pa.Array:
            out = _matrix(vectors) @ weights
            out /= np.maximum(np.sqrt(np.square(out).sum(1)), 1e-12)[:, None]
            return pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), pa.array(out.reshape(-1)))

        run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "array<double>")(self.base.encode(text))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _step(x: np.ndarray, y: np.ndarray, w: np.ndarray, heat: float) -> tuple[float, np.ndarray]:
    """Loss and gradient: each query's own text against the others of its batch."""
    a, b = x @ w, y @ w
    score = a @ b.T / heat
    score -= score.max(1, keepdims=True)
    part = np.exp(score)
    part /= part.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(np.diag(part), 1e-12)).mean())
    gap = (part - np.eye(len(x))) / (len(x) * heat)
    return loss, x.T @ (gap @ b) + y.T @ (gap.T @ a)


def fit(pairs: DataFrame, base: Encoder | None = None, dimension: int = 64, arguments: Arguments | None = None, callbacks: Sequence[Callback] = ()) -> tuple[Projected, State]:
    """An encoder fitted to pairs (query, positive), and how the fitting went. ValueError without two pairs."""
    given, base = arguments or Arguments(), base or HashingEncoder()
    rows = pairs.where("query is not null and positive is not null").select("query", "positive").distinct()
    sample = rows.orderBy(F.xxhash64("query", "positive")).limit(given.most_pairs)
    table = sample.select(base.encode(F.col("query")).alias("q"), base.encode(F.col("positive")).alias("p")).toArrow().combine_chunks()
    if table.num_rows < 2:
        raise ValueError("fitting needs two pairs")
    x, y = (_matrix(table[c].chunk(0)) for c in ("q", "p"))
    rng = np.random.default_rng(given.seed)
    order = rng.permutation(len(x))
    cut = min(max(1, int(len(x) * given.held_out)), len(x) // 2)
    apart, own = order[:cut], order[cut:]
    state = State(weights=rng.normal(size=(x.shape[1], dimension)) / np.sqrt(dimension))
    best = state.weights
    for c in callbacks:
        c.begin(state)
    for state.epoch in range(1, given.epochs + 1):
        losses = []
        for some in np.array_split(rng.permutation(own), max(1, round(len(own) / given.batch))):
            loss, slope = _step(x[some], y[some], state.weights, given.temperature)
            state.weights = state.weights - given.rate * slope
            losses.append(loss)
        state.loss = float(np.mean(losses))
        state.held_out_loss = _step(x[apart], y[apart], state.weights, given.temperature)[0]
        state.history.append((state.loss, state.held_out_loss))
        if state.held_out_loss <= state.best:
            state.best, best = state.held_out_loss, state.weights
        for c in callbacks:
            c.epoch_end(state)
        if state.stop:
            break
    for c in callbacks:
        c.end(state)
    return Projected(base, best), state
