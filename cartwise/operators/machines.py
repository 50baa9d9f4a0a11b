"""Support-vector machines over baskets (L09–L11), several fitted in one pass over the rows.

``train`` fits k machines at once.  Each has its own training rows: machine j leaves out the
rows whose ``left_out`` is j, so the k machines of a cross-validation, or a machine and the
one that calibrates it, share every pass.  Rows are packed once into blocks of items' positions
(kernel features are made from them in each pass, some rows at a time); a step evaluates all machines' trial points in one
job, and after a refused step the shorter ones that would follow it too, whose tasks add up gradients by feature and whose sums are combined by a shuffle
on stretches of features (or, where all tasks' sums are few, in the driver).  What reaches the driver
is of the size of the coefficient table, features x machines: bounded by the catalogue and
checked against ``MAX_CELLS``.

Kernels are approximated by feature maps, made of one vector per item of the basket:

* rbf: random Fourier features (Rahimi and Recht 2007); an item's projection row comes from
  a generator seeded by the item, in the tasks, so no item x feature matrix exists anywhere;
* poly, sigmoid: Nystroem landmarks (Williams and Seeger 2001), the ``n_components`` baskets
  first in hash order, with the inverse root of their kernel matrix (positive eigenvalues); the
  root is applied to weights and gradients in the driver, never to rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

BLOCK_ROWS = 1 << 14
DENSE_ROWS = 256            # rows whose dense features a task holds at a time
VECTOR_BYTES = 1 << 26      # item vectors that a worker keeps from one pass to the next
MAX_CELLS = 50_000_000      # features x machines that the driver holds
DIRECT_CELLS = 2_000_000    # (tasks x) features x machines whose partial sums the driver adds up itself
AHEAD = 7                   # shorter steps that a pass evaluates beside one, at most, after others were refused
STRETCH = 1 << 14           # features that are added up as one row of that shuffle
SMOOTH = 0.1                # width of the rounded corner of the hinge


# Item statistics ------------------------------------------------------------------------
@dataclass
class ItemStats:
    """Per machine: rows by class; per item: in how many training rows of each machine it is."""
    items: list
    held: np.ndarray            # items x machines
    rows: np.ndarray            # 2 x machines: rows of class 0 and 1

    @property
    def n(self) -> np.ndarray:
        return self.rows.sum(axis=0)

    def first(self, machines: int) -> ItemStats:
        return ItemStats(self.items, self.held[:, :machines], self.rows[:, :machines])

    def deviation(self) -> np.ndarray:
        """Sample standard deviation of each item's 0/1 column, by machine."""
        n = np.maximum(self.n, 1)
        p = self.held / n
        return np.sqrt(p * (1 - p) * n / np.maximum(n - 1, 1))


def item_stats(rows: DataFrame, items: str, machines: int, max_cells: int = MAX_CELLS) -> ItemStats:
    """From ``rows`` with ``label`` and ``left_out``; one aggregate by item, one by class."""
    by_class = rows.groupBy("left_out", "label").agg(F.count(F.lit(1)).alias("n")).collect()    # 2 x (machines + 1) rows
    count = np.zeros((2, machines), np.int64)
    for r in by_class:
        count[r["label"]] += r["n"]
        if 0 <= r["left_out"] < machines:
            count[r["label"], r["left_out"]] -= r["n"]
    held = (rows.select("left_out", F.explode(F.array_distinct(items)).alias("item")).filter(F.col("item").isNotNull())
            .groupBy("item").agg(*[F.count_if(F.col("left_out") != j).alias(f"n{j}") for j in range(machines)]))
    held = held.persist(StorageLevel.MEMORY_AND_DISK)       # counted before it is brought here
    try:
        distinct = held.count()
        if distinct * machines > max_cells:
            raise ValueError(f"{distinct} items x {machines} machines is more than max_cells = {max_cells}")
        found = sorted(held.collect(), key=lambda r: r["item"])
    finally:
        held.unpersist()
    table = np.array([[r[f"n{j}"] for j in range(machines)] for r in found], np.float64).reshape(len(found), machines)
    return ItemStats([r["item"] for r in found], table, count)


# Feature maps ---------------------------------------------------------------------------
class Block(NamedTuple):
    """Baskets of a task: the known items' positions row by row, the classes (+1, -1), the machine that leaves each row out."""
    idx: np.ndarray
    ptr: np.ndarray             # where each row begins in ``idx``
    y: np.ndarray | None = None
    out: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.ptr) - 1

    def by_length(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows, those with most items first; where each begins; its length."""
        length = np.diff(self.ptr)
        order = np.argsort(-length, kind="stable")
        return order, self.ptr[:-1][order], length[order]


def positions(held: pa.Array, index: dict) -> Block:
    """The distinct known items of each basket, in order of their positions."""
    flat = held.flatten().dictionary_encode()
    place = np.array([index.get(item, -1) for item in flat.dictionary.to_pylist()] + [-1], np.int64)
    at = place[flat.indices.fill_null(len(place) - 1).to_numpy(zero_copy_only=False)]
    of = np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    width = max(len(index), 1)
    known = np.unique((of * width + at)[at >= 0])
    return Block((known % width).astype(np.int32), np.searchsorted(known, np.arange(len(held) + 1) * width).astype(np.int32))


def listed(baskets) -> pa.Array:
    return pa.array([None if b is None else list(b) for b in baskets], pa.list_(pa.string()))


@dataclass
class Positions:
    """The linear machine's features: the positions of a basket's known items."""
    index: dict

    @property
    def size(self) -> int:
        return len(self.index)

    width = size

    def lift(self, weights: np.ndarray) -> np.ndarray:
        return weights

    lower = lift

    def encode(self, held: pa.Array) -> Block:
        return positions(held, self.index)

    def pieces(self, block: Block, weights: np.ndarray) -> Iterator[tuple]:
        """The whole block: its rows, their margins by machine, the function that adds row values up by feature.

        The p-th items of all rows that have as many are added in one go.
        """
        order, first, length = block.by_length()
        many = [np.count_nonzero(length > p) for p in range(length.max(initial=0))]
        at = np.concatenate([block.idx[first[:m] + p] for p, m in enumerate(many)] or [block.idx]).astype(np.intp)
        margins, begun = np.zeros((block.n, weights.shape[1])), 0
        for m in many:
            margins[:m] += np.take(weights, at[begun:begun + m], axis=0)
            begun += m

        def add(d: np.ndarray) -> np.ndarray:
            columns = np.ascontiguousarray(d.T)
            return np.stack([np.bincount(at, weights=np.concatenate([c[:m] for m in many] or [c[:0]]), minlength=len(weights)) for c in columns], axis=1)

        yield order, margins, add


@dataclass
class KernelMap:
    """Dense features made of the items' vectors, added up or multiplied (``join``); items without a scale are ignored.

    Passes work on raw features (``width`` of them), of which the features are a linear map:
    it is applied to weights (``lift``) and gradients (``lower``) and never to rows.
    """
    scale: dict                                 # item -> 1 / standard deviation
    gamma: float
    size: int

    @property
    def names(self) -> list:
        """Items by position, those of small scale first: these are the frequent ones, whose vectors a task keeps."""
        return sorted((i for i, s in self.scale.items() if s), key=lambda i: (self.scale[i], i))

    @cached_property
    def index(self) -> dict:
        return {item: k for k, item in enumerate(self.names)}

    @cached_property
    def kept(self) -> tuple[list, np.ndarray, np.ndarray]:
        """The items by position; vectors of the first of them, and one that changes nothing; which vectors were made."""
        names = list(self.index)
        top = min(len(names), VECTOR_BYTES // (self.width * np.dtype(self.unit).itemsize))
        table = np.full((top + 1, self.width), self.join.identity, self.unit)
        return names, table, np.arange(top + 1) == top

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("kept", "index")}

    def encode(self, held: pa.Array) -> Block:
        """The items' positions: dense features are made in each pass, some rows at a time, and never kept."""
        return positions(held, self.index)

    def joined(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their items' vectors joined), at most ``DENSE_ROWS`` of them; rows without items come last, with one row for all."""
        names, table, made = self.kept
        top = len(table) - 1
        at = np.minimum(block.idx, top)
        for k in np.unique(at[~made[at]]).tolist():
            table[k], made[k] = self.vector(names[k]), True
        order, first, length = block.by_length()
        some, rare, extra = np.count_nonzero(length), np.flatnonzero(block.idx >= top), {}
        begun, into = np.empty((2, min(some, DENSE_ROWS), self.width), self.unit)       # used again by the next rows
        for begin in range(0, some, DENSE_ROWS):
            rows, starts, held = (x[begin:min(begin + DENSE_ROWS, some)] for x in (order, first, length))
            out = np.take(table, at[starts], axis=0, out=begun[:len(rows)], mode="clip")
            for p, m in enumerate(len(rows) - np.cumsum(np.bincount(held))[1:-1], 1):      # rows with more than p items
                self.join(out[:m], np.take(table, at[starts[:m] + p], axis=0, out=into[:m], mode="clip"), out=out[:m])
            if len(rare):
                for r, (start, n) in enumerate(zip(starts.tolist(), held.tolist(), strict=True)):
                    for k in rare[np.searchsorted(rare, start):np.searchsorted(rare, start + n)]:
                        i = int(block.idx[k])
                        self.join(out[r], extra[i] if i in extra else extra.setdefault(i, self.vector(names[i])), out=out[r])
            yield rows, out
        if some < block.n:
            yield order[some:], table[top:].copy()

    def pieces(self, block: Block, weights: np.ndarray) -> Iterator[tuple]:
        """As with ``Positions``, but ``DENSE_ROWS`` rows at a time; ``weights`` are of raw features."""
        columns = [np.ascontiguousarray(w) for w in weights.T] if weights.shape[1] < 4 else None    # narrow products are faster one by one
        for rows, held in self.joined(block):
            x = self.raw(held)

            def add(d: np.ndarray, x: np.ndarray = x) -> np.ndarray:
                d = d if len(x) == len(d) else d.sum(axis=0, keepdims=True)
                return x.T @ d if columns is None else np.stack([np.ascontiguousarray(c) @ x for c in d.T], axis=1)

            margins = x @ weights if columns is None else np.stack([x @ w for w in columns], axis=1)
            yield rows, np.broadcast_to(margins, (len(rows), weights.shape[1])), add

    def of_rows(self, block: Block, finish: Callable, width: int) -> np.ndarray:
        out = np.empty((block.n, width))
        for rows, held in self.joined(block):
            out[rows] = finish(held)
        return out

    def features(self, baskets: list) -> np.ndarray:
        return self.of_rows(self.encode(listed(baskets)), lambda held: self.lower(self.raw(held).T).T, self.size)

    def margins(self, held: pa.Array, weights: np.ndarray) -> np.ndarray:
        """The products of features and weights, without the features."""
        lifted = self.lift(weights[:, None])[:, 0]
        return self.of_rows(self.encode(held), lambda held: (self.raw(held) @ lifted)[:, None], 1)[:, 0]

    def decoder(self) -> Callable[[dict], np.ndarray]:
        """From a packed row to its features."""
        def dense(row: dict) -> np.ndarray:
            block = Block(np.frombuffer(row["idx"], np.int32), np.frombuffer(row["ptr"], np.int32))
            return self.of_rows(block, lambda held: self.lower(self.raw(held).T).T, self.size).astype(np.float32)

        return dense


@dataclass
class FourierMap(KernelMap):
    """Random Fourier features of the rbf kernel exp(-gamma |x - y|^2): sqrt(2 / size) times raw cosines.

    An item's vector has the points of the unit circle at its angles: the product of a basket's
    items is at the sum of their angles, and its real part is the cosine, which is dear to compute.
    """
    seed: int = 42
    unit, join = np.complex64, np.multiply

    @property
    def width(self) -> int:
        return self.size

    def _normals(self, name: str) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.md5(f"{self.seed}|{name}".encode()).digest()[:8], "big"))

    def vector(self, item) -> np.ndarray:
        return np.exp(1j * (self._normals(f"item|{item}").standard_normal(self.size) * (np.sqrt(2 * self.gamma) * self.scale[item])))

    @cached_property
    def shift(self) -> np.ndarray:
        return np.exp(1j * self._normals("shift").uniform(0, 2 * np.pi, self.size)).astype(self.unit)

    def raw(self, held: np.ndarray) -> np.ndarray:
        held *= self.shift
        return held.real.astype(np.float64)

    def lift(self, weights: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / self.size) * weights

    lower = lift

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma * d)


@dataclass
class LandmarkMap(KernelMap):
    """Nystroem features of a dot-product kernel: poly (gamma x.y + coef0)^degree or sigmoid tanh(gamma x.y + coef0).

    Raw features are a basket's kernels with the landmarks; items of no landmark add nothing and have no position.
    """
    kind: str = "poly"
    degree: int = 3
    coef0: float = 0.0
    landmarks: list = field(default_factory=list)
    root: np.ndarray | None = None
    unit, join = np.float64, np.add

    @property
    def width(self) -> int:
        return len(self.landmarks)

    @property
    def names(self) -> list:
        return sorted(self.holders, key=lambda i: (self.scale[i], i))

    def __post_init__(self):
        self.holders = {}
        for k, b in enumerate(self.landmarks):
            for i in {i for i in (() if b is None else b) if self.scale.get(i)}:
                self.holders.setdefault(i, []).append(k)
        if self.root is None:
            values, vectors = np.linalg.eigh(self.of_rows(self.encode(listed(self.landmarks)), self.raw, self.width))
            keep = values > max(1e-8 * np.abs(values).max(initial=0.0), 1e-12)
            if not keep.any():
                raise ValueError("the landmarks' kernel matrix has no positive eigenvalue")
            self.root = vectors[:, keep] / np.sqrt(values[keep])
        self.size = self.root.shape[1]

    def vector(self, item) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.holders[item]] = self.scale[item] ** 2
        return out

    def of_dots(self, dots: np.ndarray) -> np.ndarray:
        if self.kind == "poly" and self.degree in range(1, 9):      # a power of floats takes many times as long
            out = inner = self.gamma * dots + self.coef0
            for _ in range(int(self.degree) - 1):
                out = out * inner
            return out
        of = (lambda x: x ** self.degree) if self.kind == "poly" else np.tanh
        out = np.full(dots.shape, of(np.float64(self.coef0)))
        some = np.flatnonzero(dots)         # a basket shares items with few landmarks
        out.reshape(-1)[some] = of(self.gamma * dots.reshape(-1)[some] + self.coef0)
        return out

    raw = of_dots

    def lift(self, weights: np.ndarray) -> np.ndarray:
        return self.root @ weights

    def lower(self, slopes: np.ndarray) -> np.ndarray:
        return self.root.T @ slopes

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.of_dots(a @ b.T)


# Training -------------------------------------------------------------------------------
def pack(rows: DataFrame, items: str, encoder, parallelism: int) -> DataFrame:
    """Blocks of rows encoded by ``encoder`` (or its broadcast) with classes (+1, -1) and the machine that leaves each row out."""
    fields = ["y", "out", "idx", "ptr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder.value if isinstance(encoder, Broadcast) else encoder
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                block = own.encode(part.column(0))
                values = (2 * part.column(1).to_numpy().astype(np.int8) - 1, part.column(2).to_numpy().astype(np.int32), block.idx, block.ptr)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=fields)

    return (rows.select(items, F.col("label").cast("int"), F.col("left_out").cast("int")).coalesce(parallelism)
            .mapInArrow(run, "y binary, out binary, idx binary, ptr binary"))


def unpack(row: tuple) -> Block:
    y, out, idx, ptr = row
    return Block(np.frombuffer(idx, np.int32), np.frombuffer(ptr, np.int32), np.frombuffer(y, np.int8), np.frombuffer(out, np.int32))


def evaluate(blocks: RDD, encoder: Broadcast, machines: list[int], weights: np.ndarray, bias: np.ndarray, tasks: int,
             direct_cells: int = DIRECT_CELLS):
    """Sums over each machine's rows of the loss and its gradients: (loss, by raw feature, by intercept).

    A machine may come more than once, with other weights.  Tasks return their sums by
    feature.  Where all tasks' sums are few they are added up here, else by a shuffle on
    stretches of features, so that the driver gets each feature once.
    """
    size, k = weights.shape
    chosen = np.array(machines)

    def run(packed: Iterator[tuple]) -> Iterator[np.ndarray]:
        total, seen, own = np.zeros((size + 2, k)), False, encoder.value        # the last two rows: intercepts, losses
        for block in map(unpack, packed):
            seen = True
            for rows, margins, add in own.pieces(block, weights):
                y = block.y[rows].astype(np.float64)[:, None]
                slack = 1 - y * (margins + bias)
                bent = np.clip(slack / SMOOTH, 0, 1) * (block.out[rows][:, None] != chosen)
                d = -y * bent
                total[:size] += add(d)
                total[size] += d.sum(axis=0)
                total[size + 1] += (bent * (slack - SMOOTH / 2 * bent)).sum(axis=0)
        if seen:
            yield total

    sums, out = blocks.mapPartitions(run), np.zeros((size + 2, k))
    if tasks * (size + 2) * k > direct_cells:
        parts = sums.flatMap(lambda total: [(at, total[at:at + STRETCH]) for at in range(0, size + 2, STRETCH)])
        for at, part in parts.reduceByKey(np.add, tasks).collect():
            out[at:at + STRETCH] = part
    else:
        for total in sums.collect():
            out += total
    return out[size + 1], out[:size], out[size]


class Descent:
    """L-BFGS with a backtracking step for one machine; ``trial`` is the point to evaluate next."""

    def __init__(self, size: int, tol: float, memory: int = 10):
        self.point, self.trial = np.zeros(size), np.zeros(size)
        self.value = self.slope = self.way = None
        self.pairs, self.memory, self.tol, self.step, self.done, self.steps = [], memory, tol, 1.0, False, 0
        self.refused = 0        # passes in which the present step was refused

    def _turn(self) -> np.ndarray:
        q, used = -self.slope, []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            q = q - a * y
            used.append(a)
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(self.pairs, reversed(used), strict=True):
            q = q + (a - r * (y @ q)) * s
        return q

    @property
    def cut(self) -> int:
        return 2 if self.pairs else 4

    def trials(self, ahead: int = AHEAD) -> list:
        """The point to evaluate next, and those that follow it should it be refused: twice as many after each pass that refused."""
        more = min(2 ** self.refused - 1, ahead)
        return [self.trial, *[self.point + self.step / self.cut ** k * self.way for k in range(1, more + 1)]]

    def awaits(self, point: np.ndarray) -> bool:
        return not self.done and np.array_equal(point, self.trial)

    def feed(self, value: float, slope: np.ndarray) -> None:
        if self.value is not None:
            if value > self.value + 1e-4 * self.step * (self.slope @ self.way):
                self.step /= self.cut
                self.done = self.step < 1e-10
                self.trial = self.point + self.step * self.way
                return
            s, y = self.trial - self.point, slope - self.slope
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[-self.memory + 1:], (s, y, 1 / (s @ y))]
            self.done = abs(self.value - value) <= self.tol * max(abs(value), abs(self.value), 1e-9)
        self.point, self.value, self.slope, self.steps, self.refused = self.trial, value, slope, self.steps + 1, 0
        norm = np.linalg.norm(slope)
        self.done = self.done or norm < 1e-9
        self.way = self._turn()
        if self.way @ slope >= 0:
            self.pairs, self.way = [], -slope
        self.step = 1.0 if self.pairs else min(1.0, 1 / max(norm, 1e-12))
        self.trial = self.point + self.step * self.way


@dataclass
class Trained:
    weights: np.ndarray         # features x machines, for unscaled features
    bias: np.ndarray
    losses: np.ndarray          # the objective that each machine reached
    passes: int                 # evaluations of all machines together


def train(rows: DataFrame, items: str, encoder, stats: ItemStats, C: float = 1.0, deviation: np.ndarray | None = None,
          max_iter: int = 100, tol: float = 1e-5, direct_cells: int = DIRECT_CELLS) -> Trained:
    """Soft-margin machines, 1/n sum of losses + |u|^2 / (2 C n) each, ``u`` the weights of features over ``deviation``.

    A machine without rows of both classes is not fitted (weights and intercept 0).
    """
    size, k, n = encoder.size, stats.rows.shape[1], np.maximum(stats.n, 1)
    scale = np.ones((size, k)) if deviation is None else np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    context = rows.sparkSession.sparkContext
    tasks = context.defaultParallelism       # the cluster's cores
    shared = context.broadcast(encoder)
    # Some hundred small jobs: as an RDD, the blocks need no query planned for each.
    blocks = pack(rows, items, shared, tasks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    machines = {j: Descent(size + 1, tol) for j in range(k) if stats.rows[:, j].all()}
    passes = 0
    try:
        while live := [j for j, m in machines.items() if not m.done and m.steps <= max_iter]:
            begun = {j: machines[j].steps for j in live}
            points = [(j, point) for j in live for point in machines[j].trials()]
            of, trial = [j for j, _ in points], np.stack([point for _, point in points], axis=1)
            loss, slope, lean = evaluate(blocks, shared, of, encoder.lift(trial[:size] * scale[:, of]), trial[size], tasks, direct_cells)
            slope = encoder.lower(slope)
            passes += 1
            for c, (j, point) in enumerate(points):
                if not machines[j].awaits(point):
                    continue
                u = point[:size]
                penalty = 1 / (C * n[j])
                machines[j].feed(loss[c] / n[j] + penalty / 2 * (u @ u),
                                 np.concatenate([slope[:, c] * scale[:, j] / n[j] + penalty * u, [lean[c] / n[j]]]))
            for j in live:
                machines[j].refused += machines[j].steps == begun[j]
    finally:
        blocks.unpersist()
        shared.unpersist()
    weights, bias, losses = np.zeros((size, k)), np.zeros(k), np.full(k, np.nan)
    for j, m in machines.items():
        weights[:, j], bias[j], losses[j] = m.point[:size] * scale[:, j], m.point[size], m.value
    return Trained(weights, bias, losses, passes)


def calibrate(margins: DataFrame, steps: int = 30) -> tuple[float, float]:
    """Platt scaling: a, b of 1 / (1 + exp(-(a margin + b))) by Newton steps on one aggregate each.

    ``margins``: ``_margin`` and ``label``.  Classes count as (n1 + 1) / (n1 + 2) and
    1 / (n0 + 2), so separable margins have a finite fit.
    """
    size = margins.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).first()
    target = F.when(F.col("label") == 1, (size["n1"] + 1) / (size["n1"] + 2)).otherwise(1 / (size["n0"] + 2))
    a, b, m = 0.0, float(np.log((size["n1"] + 1) / (size["n0"] + 1))), F.col("_margin")

    def at(a: float, b: float):
        z = m * a + b
        p = 1 / (1 + F.exp(-z))
        gap, bend = p - target, p * (1 - p)
        return margins.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (
            F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z))) - target * z, gap * m, gap, bend * m * m, bend * m, bend)]).first()

    now = at(a, b)
    for _ in range(steps):
        loss, ga, gb, haa, hab, hbb = now
        hess = np.array([[haa, hab], [hab, hbb]]) + 1e-10 * np.eye(2)
        da, db = np.linalg.solve(hess, [ga, gb])
        rate = 1.0
        while rate > 1e-6 and (then := at(a - rate * da, b - rate * db))[0] > loss:
            rate /= 2
        if rate <= 1e-6:
            break
        a, b, now = a - rate * da, b - rate * db, then
        if loss - then[0] < 1e-9 * max(1.0, abs(loss)):
            break
    return float(a), float(b)
