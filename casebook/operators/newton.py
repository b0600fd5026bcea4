"""Many linear classifiers fitted side by side by trust-region Newton steps.

A problem is one convex objective ``|w|^2 / 2 + C * sum of weighted losses`` over the rows of one
group that its fold and calibration part let it see. Problems share the passes over the rows: in
each one a task multiplies its blocks with one matrix that holds the columns of all problems that are
still at work, whatever step they are at (gradient or Hessian product).

The rows of a group beyond ``LOCAL_BYTES`` stay where they are: a pass is a job, tasks add up by
slices of features, and the driver steps. The number of jobs is that of the slowest problem; large
stacks are taken in turns, so the driver's vectors are bounded. The rows of a smaller group travel to
its problems instead: each of a number of tasks has all of them and a share of the problems, and goes
through the same steps on the rows that a problem sees; the whole fit is one job.

Coefficients are staged where they arise and read back as far as they are wanted, so the driver never
holds a whole stack. SVMs that leave out a calibration part are calibrated on it at once.

Losses: ``soft`` is the multinomial logistic one, ``logit`` its two-class form with one vector,
both with a free intercept; ``hinge`` is the squared hinge, whose intercept is penalised as well,
which makes it strictly convex.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebook.operators.isotonic import curve, curves, fit_isotonic, pooled_scores
from casebook.sources.staging import compact, lean, stage

#: Rows and cells of a block; one long row may have more cells.
BLOCK_ROWS = 512
BLOCK_CELLS = 1 << 17
#: Numbers of a matrix product that a task holds at a time, and columns that share them: both stay in
#: the processor's cache.
_CELLS = 1 << 15
_COLUMNS = 4
#: Cells whose features are added to at a time.
_SPREAD = 1 << 17
#: Bytes of coefficients that are at work or on the driver at a time, and of a slice of their sums.
STACK_BYTES = 32 << 20
_SLICE_BYTES = 4 << 20
#: Cells of a group that a task may hold beside its share of the problems, in bytes.
LOCAL_BYTES = 128 << 20
_CELL_BYTES = 12
#: Staged rows of about a megabyte that are written or read together: parquet's own checks of a row
#: group's size begin at 100 rows, and its reader takes 4,096 rows of a group at once.
_FEW_ROWS = {"parquet.block.row.count.limit": "16"}


Curve = tuple[np.ndarray, np.ndarray]


# --- sparse rows --------------------------------------------------------------------------------


def _sums(
    ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, matrix: np.ndarray
) -> np.ndarray:
    """For every stretch of ``ptr``, none of them empty, the sum of ``val * matrix[idx]`` by column."""
    columns = np.ascontiguousarray(matrix.T)
    out = np.empty((len(columns), len(ptr) - 1))
    room = np.empty(max(_CELLS, int(np.diff(ptr).max(initial=0))))
    for few in range(0, len(columns), _COLUMNS):
        first = 0
        while first < len(ptr) - 1:
            end = int(np.searchsorted(ptr, ptr[first] + _CELLS, "right")) - 1
            end = min(max(end, first + 1), len(ptr) - 1)
            low, high = ptr[first], ptr[end]
            cells, places = room[:high - low], idx[low:high].astype(np.intp)
            for j in range(few, min(few + _COLUMNS, len(columns))):
                np.take(columns[j], places, out=cells, mode="clip")
                cells *= val[low:high]
                np.add.reduceat(cells, ptr[first:end] - low, out=out[j, first:end])
            first = end
    return out.T


@dataclass
class Sparse:
    """Rows with a last feature of 1, by row (``ptr``, ``idx``, ``val``)."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """``rows @ matrix``; a matrix in order of its columns is not copied."""
        return _sums(self.ptr, self.idx, self.val, matrix)

    def add_transposed(self, r: np.ndarray, out: np.ndarray) -> None:
        """``out += rows.T @ r``."""
        columns = np.ascontiguousarray(r.T)
        first = 0
        while first < len(self):
            end = int(np.searchsorted(self.ptr, self.ptr[first] + _SPREAD, "right")) - 1
            end = max(end, first + 1)
            low, high = self.ptr[first], self.ptr[end]
            places, lengths = self.idx[low:high].astype(np.intp), np.diff(self.ptr[first:end + 1])
            for j, column in enumerate(columns):
                cells = np.repeat(column[first:end], lengths)
                cells *= self.val[low:high]
                out[:, j] += np.bincount(places, cells, len(out))
            first = end

    def kept(self, mine: np.ndarray) -> Sparse:
        """The rows that are marked."""
        lengths = np.diff(self.ptr)
        cells = np.repeat(mine, lengths)
        return Sparse(
            np.concatenate([[0], np.cumsum(lengths[mine])]), self.idx[cells], self.val[cells])


def sparse_rows(vectors: pa.StructArray, width: int) -> Sparse:
    """From stored vectors (``type, size, indices, values``), dense or sparse."""
    kinds = vectors.field("type").to_numpy()
    values = vectors.field("values")
    lengths = np.diff(values.offsets.to_numpy())
    val = values.flatten().to_numpy(zero_copy_only=False)
    row_ends = np.cumsum(lengths)
    idx = np.arange(len(val)) - np.repeat(row_ends - lengths, lengths)  # as if all were dense
    sparse = np.repeat(kinds == 0, lengths)
    idx[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    ptr = np.concatenate([[0], np.cumsum(lengths + 1)])
    all_idx, all_val = np.full(ptr[-1], width), np.ones(ptr[-1])
    inner = np.ones(ptr[-1], bool)
    inner[ptr[1:] - 1] = False
    all_idx[inner], all_val[inner] = idx, val
    return Sparse(ptr, all_idx, all_val)


_BLOCK = (
    "g int, n int, cells long, ptr binary, idx binary, val binary, y binary, fold binary, cal binary"
)


def pack(rows: DataFrame, width: int) -> DataFrame:
    """Staged blocks of ``(g, y, fold, cal, features)`` rows: group, class number, fold, and the
    calibration part for every mask. A block has rows of one group and a bounded number of cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("g").to_numpy()
            for g in np.unique(groups).tolist():
                own = batch.take(pa.array(np.flatnonzero(groups == g)))
                cells = np.cumsum(np.diff(own.column("features").field("values").offsets.to_numpy()) + 1)
                at = 0
                while at < own.num_rows:
                    most = BLOCK_CELLS + (cells[at - 1] if at else 0)
                    end = min(int(np.searchsorted(cells, most, "right")), at + BLOCK_ROWS)
                    end = max(end, at + 1)
                    yield _packed(own.slice(at, end - at), int(g), width)
                    at = end

    lean(rows.sparkSession)
    named = compact(rows.select("g", "y", "fold", "cal", F.unwrap_udt("features").alias("features")))
    return stage(named.mapInArrow(run, _BLOCK), "blocks", **_FEW_ROWS)


def _packed(batch: pa.RecordBatch, g: int, width: int) -> pa.RecordBatch:
    x = sparse_rows(batch.column("features"), width)
    cal = batch.column("cal").flatten().to_numpy()
    cells = [
        x.ptr, x.idx.astype(np.int32), x.val,
        batch.column("y").to_numpy().astype(np.int32),
        batch.column("fold").to_numpy().astype(np.int32), cal.astype(np.int16),
    ]
    names = "ptr idx val y fold cal".split()
    return pa.RecordBatch.from_arrays(
        [pa.array([g], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([len(x.idx)], pa.int64()),
         *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["g", "n", "cells", *names])


class Block:
    """Rows of one group; a packed one is read without copies."""

    def __init__(self, row: dict):
        def cell(name, kind):
            return np.frombuffer(row[name], kind)

        self.g, self.n = row["g"], row["n"]
        self.x = Sparse(cell("ptr", np.int64), cell("idx", np.int32), cell("val", np.float64))
        self.y, self.fold = cell("y", np.int32), cell("fold", np.int32)
        self.cal = cell("cal", np.int16).reshape(self.n, -1)

    @classmethod
    def _of(cls, g: int, x: Sparse, y: np.ndarray, fold: np.ndarray, cal: np.ndarray) -> Block:
        out = cls.__new__(cls)
        out.g, out.n, out.x, out.y, out.fold, out.cal = g, len(x), x, y, fold, cal
        return out

    @classmethod
    def merged(cls, blocks: Sequence[Block]) -> Block:
        """All rows of the blocks as one; the blocks lose their cells on the way."""
        lengths = np.concatenate([np.diff(b.x.ptr) for b in blocks])
        joined = {}
        for name in ("idx", "val"):
            joined[name] = np.concatenate([getattr(b.x, name) for b in blocks])
            for b in blocks:
                setattr(b.x, name, None)
        x = Sparse(np.concatenate([[0], np.cumsum(lengths)]), **joined)
        return cls._of(blocks[0].g, x, *(
            np.concatenate([getattr(b, name) for b in blocks]) for name in ("y", "fold", "cal")))

    def kept(self, mine: np.ndarray) -> Block:
        """The rows that are marked; all of them are not copied."""
        if mine.all():
            return self
        return Block._of(self.g, self.x.kept(mine), self.y[mine], self.fold[mine], self.cal[mine])

    def add_transposed(self, r: np.ndarray, out: np.ndarray) -> None:
        """``out += rows.T @ r``."""
        self.x.add_transposed(r, out)


# --- problems -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Problem:
    """One fit: ``mask`` 0 sees all folds, ``1 + f`` all but fold ``f``; ``part`` of ``parts`` is left
    out for calibration (-1: none). ``weights`` holds one number for each class of the group, 0 for
    classes that its rows lack; ``target`` is the class that a two-sided loss tells from the rest."""

    key: tuple
    group: int
    kind: str
    c: float
    weights: tuple[float, ...]
    mask: int = 0
    part: int = -1
    parts: int = 1
    target: int = -1

    @property
    def classes(self) -> list[int]:
        return [i for i, w in enumerate(self.weights) if w > 0]

    @property
    def columns(self) -> int:
        return len(self.classes) if self.kind == "soft" else 1

    def in_mask(self, block: Block) -> np.ndarray:
        return block.fold != self.mask - 1 if self.mask else np.ones(block.n, bool)

    def left_out(self, block: Block) -> np.ndarray:
        """The rows of the calibration part, of those that the mask shows."""
        if self.part < 0:
            return np.zeros(block.n, bool)
        return self.in_mask(block) & (block.cal[:, self.mask] % self.parts == self.part)

    def seen(self, block: Block) -> np.ndarray:
        return self.in_mask(block) & ~self.left_out(block)

    def row_weights(self, block: Block) -> np.ndarray:
        return np.array(self.weights)[block.y] * self.seen(block)

    def bends(self, block: Block, z: np.ndarray) -> np.ndarray:
        """The rows with a share in the Hessian: with the squared hinge those short of the margin."""
        if self.kind != "hinge":
            return np.ones(block.n, bool)
        return np.where(block.y == self.target, z[:, 0], -z[:, 0]) < 1

    def terms(self, block: Block, z: np.ndarray, zv: np.ndarray | None):
        """The loss, and what its gradient (or, with ``zv``, the Hessian product) weighs rows by."""
        w = self.row_weights(block)
        if self.kind == "soft":
            place = np.zeros(len(self.weights), int)
            place[self.classes] = np.arange(self.columns)
            top = z.max(1, keepdims=True)
            p = np.exp(z - top)
            total = p.sum(1, keepdims=True)
            p /= total
            if zv is not None:
                return 0.0, w[:, None] * p * (zv - (p * zv).sum(1, keepdims=True))
            own = np.arange(len(z)), place[block.y]
            loss = float((w * (np.log(total[:, 0]) + top[:, 0] - z[own])).sum())
            p[own] -= 1
            return loss, w[:, None] * p
        t = np.where(block.y == self.target, 1.0, -1.0)
        m = t * z[:, 0]
        if self.kind == "hinge":
            gap = np.maximum(1 - m, 0)
            if zv is not None:
                return 0.0, (2 * w * (gap > 0))[:, None] * zv
            return float((w * gap * gap).sum()), (-2 * w * t * gap)[:, None]
        s = 1 / (1 + np.exp(np.clip(m, -700, 700)))  # how wrong the row is
        if zv is not None:
            return 0.0, (w * s * (1 - s))[:, None] * zv
        return float((w * np.logaddexp(0, -m)).sum()), (-w * t * s)[:, None]


def _joined(own: list) -> np.ndarray:
    """The columns of all orders ``(problem, w, v)`` of a group, those of the products behind."""
    return np.asfortranarray(np.concatenate(
        [w for _, w, _ in own] + [v for _, _, v in own if v is not None], axis=1))


def _nothing(width: int, columns: int) -> np.ndarray:
    """Zeros for the sums of a pass, in order of the columns."""
    return np.zeros((width + 1, columns), order="F")


def _summer(orders, width: int):
    """One pass: every group's orders over the task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, sums, losses = {}, {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                g = row["g"]
                own = orders.value.get(g)
                if own is None:
                    continue
                if g not in joined:
                    joined[g], losses[g] = _joined(own), np.zeros(len(own))
                    sums[g] = _nothing(width, sum(p.columns for p, _, _ in own))
                _add(Block(row), own, joined[g], losses[g], sums[g])
        for g, total in sums.items():
            step = max(1, _SLICE_BYTES // (8 * total.shape[1]))
            for part, first in enumerate(range(0, len(total), step)):
                yield _row(g, part, total[first:first + step].tobytes())
            yield _row(g, -1, losses[g].tobytes())

    return run


def _add(block: Block, own: list, joined: np.ndarray, losses: np.ndarray, sums: np.ndarray) -> None:
    z = block.x.times(joined)
    at, behind, residuals = 0, sums.shape[1], []
    for i, (p, _, v) in enumerate(own):
        zv = None
        if v is not None:
            zv = z[:, behind:behind + p.columns]
            behind += p.columns
        loss, r = p.terms(block, z[:, at:at + p.columns], zv)
        at += p.columns
        losses[i] += loss
        residuals.append(r)
    block.add_transposed(np.concatenate(residuals, axis=1), sums)


_SUM = "g int, part int, cells binary"


def _row(g: int, part: int, cells: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([g], pa.int32()), pa.array([part], pa.int32()), pa.array([cells], pa.binary())],
        ["g", "part", "cells"])


def _added(table):
    """The sum of one slice over the tasks."""
    total = None
    for cell in table["cells"]:
        part = np.frombuffer(cell.as_py())
        total = part.copy() if total is None else total + part
    row = table.slice(0, 1)
    return pa.table(
        {"g": row["g"], "part": row["part"], "cells": pa.array([total.tobytes()], pa.binary())})


# --- steps --------------------------------------------------------------------------------------


class _Fit:
    """The state of one problem: a trust-region Newton method, one pass for each :meth:`take`."""

    def __init__(self, problem: Problem, width: int, tol: float, most: int):
        self.p, self.tol, self.most = problem, tol, most
        self.w = _nothing(width, problem.columns)
        self.held = np.ones((width + 1, 1))  # what the penalty holds
        if problem.kind != "hinge":
            self.held[-1] = 0
        self.f = self.g = self.first = self.radius = None
        self.steps, self.done = 0, False
        self.s = np.zeros_like(self.w)
        self.direction = None

    def order(self):
        if self.direction is not None:
            return self.p, self.w, self.direction
        self.tried = self.w + self.s
        return self.p, self.tried, None

    def take(self, loss: float, cells: np.ndarray) -> None:
        if self.direction is not None:
            self._product(self.held * self.direction + self.p.c * cells)
            return
        w = self.tried
        f = 0.5 * float((self.held * w * w).sum()) + self.p.c * loss
        self._arrive(w, f, self.held * w + self.p.c * cells)

    def _arrive(self, w, f, g) -> None:
        if self.f is None:
            self.w, self.f, self.g = w, f, g
            self.first = self.radius = float(np.linalg.norm(g))
        else:
            length, slope = float(np.linalg.norm(self.s)), float((self.g * self.s).sum())
            promised = -0.5 * (slope - float((self.s * self.r).sum()))
            got = self.f - f
            if self.steps == 0:
                self.radius = min(self.radius, length)
            curve = f - self.f - slope
            grow = 4.0 if curve <= 0 else max(0.25, -0.5 * slope / curve)
            ratio = got / promised if promised > 0 else -1.0
            if ratio < 1e-4:
                self.radius = min(max(grow, 0.25) * length, 0.5 * self.radius)
            elif ratio < 0.25:
                self.radius = max(0.25 * self.radius, min(grow * length, 0.5 * self.radius))
            elif ratio < 0.75:
                self.radius = max(0.25 * self.radius, min(grow * length, 4 * self.radius))
            else:
                self.radius = max(self.radius, min(grow * length, 4 * self.radius))
            self.steps += 1
            if ratio > 1e-4:
                self.w, self.f, self.g = w, f, g
            flat = abs(got) <= 1e-14 * abs(self.f) and abs(promised) <= 1e-14 * abs(self.f)
            if flat or self.steps >= self.most:
                self.done = True
        if np.linalg.norm(self.g) <= self.tol * self.first or self.first == 0:
            self.done = True
        if not self.done:
            self.s, self.r = np.zeros_like(self.w), -self.g
            self.direction, self.square = self.r.copy(), float((self.r * self.r).sum())
            self.enough = 0.1 * float(np.linalg.norm(self.g))

    def _product(self, h) -> None:
        """One step of conjugate gradients towards the Newton step, within the trust region."""
        d = self.direction
        bend = float((d * h).sum())
        if bend <= 0:
            self._reach_edge(d, h)
            return
        alpha = self.square / bend
        s = self.s + alpha * d
        if np.linalg.norm(s) > self.radius:
            self._reach_edge(d, h)
            return
        self.s, self.r = s, self.r - alpha * h
        square = float((self.r * self.r).sum())
        if np.sqrt(square) <= self.enough:
            self.direction = None
            return
        self.direction, self.square = self.r + square / self.square * d, square

    def _reach_edge(self, d, h) -> None:
        sd, ss, dd = float((self.s * d).sum()), float((self.s ** 2).sum()), float((d * d).sum())
        room = max(self.radius ** 2 - ss, 0.0)
        root = np.sqrt(sd * sd + dd * room)
        alpha = room / (sd + root) if sd >= 0 else (root - sd) / dd
        self.s, self.r, self.direction = self.s + alpha * d, self.r - alpha * h, None

    def row(self, i: int, score_curve: Curve | None = None) -> dict:
        """What is staged of the fit."""
        cells = score_curve or (np.zeros(0), np.zeros(0))
        return {
            "i": i, "w": self.w.tobytes(), "gradient": float(np.abs(self.g).max()),
            "first": self.first, "steps": self.steps,
            "scores": cells[0].tobytes(), "values": cells[1].tobytes()}


_FITTED = pa.schema([
    ("i", pa.int32()), ("w", pa.binary()), ("gradient", pa.float64()), ("first", pa.float64()),
    ("steps", pa.int32()), ("scores", pa.binary()), ("values", pa.binary())])
_FITTED_DDL = (
    "i int, w binary, gradient double, first double, steps int, scores binary, values binary")


class Coefficients:
    """Staged coefficients of numbered problems. A few of them are kept on the driver at a time."""

    def __init__(self, problems: Sequence[Problem], width: int):
        self.problems, self.width = problems, width
        self.tables: list[DataFrame] = []
        self._held: dict[int, np.ndarray] = {}

    def size(self, i: int) -> int:
        return 8 * (self.width + 1) * self.problems[i].columns

    def read(self, numbers: Iterable[int]) -> dict[int, np.ndarray]:
        wanted = sorted(numbers)
        out = {}
        for table in self.tables if wanted else []:
            found = table.where(F.col("i").between(wanted[0], wanted[-1]) & F.col("i").isin(wanted))
            for row in found.select("i", "w").toLocalIterator():
                columns = self.problems[row["i"]].columns
                out[row["i"]] = np.frombuffer(row["w"]).reshape(self.width + 1, columns)
        return out

    def of(self, i: int) -> np.ndarray:
        """One matrix; those that follow it are read along."""
        if i not in self._held:
            end, size = i, 0
            while end < len(self.problems) and (end == i or size + self.size(end) <= STACK_BYTES):
                size += self.size(end)
                end += 1
            self._held = self.read(range(i, end))
        return self._held[i]


@dataclass
class Solution:
    """Where the coefficients lie (the last row is the intercept), the largest gradient entry there, the
    length of the gradient at the start, and the calibration curve of an SVM."""

    problem: Problem
    number: int
    stored: Coefficients = field(repr=False)
    gradient: float = 0.0
    first: float = 0.0
    steps: int = 0
    curve: Curve | None = field(default=None, repr=False)

    @property
    def w(self) -> np.ndarray:
        return self.stored.of(self.number)


def solve(
    blocks: DataFrame, problems: Sequence[Problem], width: int, tol: float = 1e-4, most: int = 1000
) -> dict[tuple, Solution]:
    """Fit all problems; ``tol`` is the share of the first gradient's length that may be left."""
    lean(blocks.sparkSession)
    # Problems that see the same rows are neighbours.
    problems = sorted(problems, key=lambda p: (p.group, p.mask, p.part))
    stored = Coefficients(problems, width)
    sizes = blocks.groupBy("g").agg(F.sum("cells").alias("cells")).collect()  # one row for each group
    cells = {r["g"]: r["cells"] for r in sizes}
    near, far = [], []
    for i, p in enumerate(problems):
        (near if cells.get(p.group, 0) * _CELL_BYTES <= LOCAL_BYTES else far).append(i)
    out: dict[int, Solution] = {}
    if near:
        _dealt(blocks, near, stored, cells, tol, most, out)
    while far:
        turn, size = [], 0
        while far and (not turn or size + stored.size(far[0]) <= STACK_BYTES):
            size += stored.size(far[0])
            turn.append(far.pop(0))
        _in_passes(blocks, turn, stored, tol, most, out)
    return {problems[i].key: out[i] for i in sorted(out)}


def _collected(table: DataFrame, stored: Coefficients, out: dict[int, Solution]) -> None:
    """All of the solutions but their coefficients."""
    stored.tables.append(table)
    for row in table.drop("w").toArrow().to_pylist():
        scores = np.frombuffer(row["scores"])
        found = (scores, np.frombuffer(row["values"])) if len(scores) else None
        out[row["i"]] = Solution(
            stored.problems[row["i"]], row["i"], stored, row["gradient"], row["first"], row["steps"], found)


def _in_passes(
    blocks: DataFrame, turn: list[int], stored: Coefficients, tol: float, most: int,
    out: dict[int, Solution],
) -> None:
    """A turn of problems over rows that stay where they are."""
    fits = [_Fit(stored.problems[i], stored.width, tol, most) for i in turn]
    own = blocks.where(F.col("g").isin(sorted({f.p.group for f in fits})))
    # A task adds up its rows, however many: what is shuffled grows with the tasks.
    own = own.coalesce(own.sparkSession.sparkContext.defaultParallelism)
    _run(own, fits, stored.width)
    svms = [(i, f.p, f.w) for i, f in zip(turn, fits) if f.p.part >= 0]
    found = curves(fit_isotonic(_held_out(own, svms))) if svms else {}
    rows = [f.row(i, found.get(i)) for i, f in zip(turn, fits)]
    table = blocks.sparkSession.createDataFrame(pa.Table.from_pylist(rows, _FITTED))
    _collected(stage(table, "solutions", **_FEW_ROWS), stored, out)


def _held_out(blocks: DataFrame, solved: list[tuple[int, Problem, np.ndarray]]) -> DataFrame:
    """``(fit, score, hit, weight)``: what every SVM says of the calibration part it did not see."""
    sent = blocks.sparkSession.sparkContext.broadcast(solved)
    schema = pa.schema([
        ("fit", pa.int32()), ("score", pa.float64()), ("hit", pa.float64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict = defaultdict(list)
        for i, p, w in sent.value:
            by_group[p.group].append((i, p, w))
        joined = {
            g: np.asfortranarray(np.concatenate([w for _, _, w in own], axis=1))
            for g, own in by_group.items()}
        for batch in batches:
            for row in batch.to_pylist():
                if row["g"] not in by_group:
                    continue
                block = Block(row)
                z = block.x.times(joined[block.g])
                for at, (i, p, _) in enumerate(by_group[block.g]):
                    mine = p.left_out(block)
                    k = int(mine.sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(k, i, np.int32)), pa.array(z[mine, at]),
                        pa.array((block.y[mine] == p.target).astype(float)),
                        pa.array(np.ones(k))], schema=schema)

    return blocks.mapInArrow(run, "fit int, score double, hit double, weight double")


def _by_group(fits: list[_Fit]) -> dict[int, list[_Fit]]:
    groups: dict[int, list[_Fit]] = {}
    for f in fits:
        if not f.done:
            groups.setdefault(f.p.group, []).append(f)
    return groups


def _run(blocks: DataFrame, fits: list[_Fit], width: int) -> None:
    """Steps on the driver, passes as jobs."""
    context = blocks.sparkSession.sparkContext
    while groups := _by_group(fits):
        sent = context.broadcast({g: [f.order() for f in own] for g, own in groups.items()})
        sums = blocks.mapInArrow(_summer(sent, width), _SUM).groupBy("g", "part").applyInArrow(
            _added, _SUM)
        parts: dict[int, dict[int, np.ndarray]] = {}
        for row in sums.toArrow().to_pylist():
            parts.setdefault(row["g"], {})[row["part"]] = np.frombuffer(row["cells"])
        sent.destroy()
        for g, own in groups.items():
            cells, columns = parts.get(g, {}), sum(f.p.columns for f in own)
            losses, total = np.zeros(len(own)), _nothing(width, columns)
            if cells:  # else a group without rows
                losses = cells[-1]
                total = np.asfortranarray(np.concatenate(
                    [cells[i] for i in sorted(cells) if i >= 0]).reshape(-1, columns))
            _share_out(own, losses, total)


def _fitted(fit: _Fit, block: Block, width: int) -> None:
    """All steps of one fit over rows at hand. The scores at its place serve all products there, and
    the rows that bend the objective there are picked once for these."""
    bent = None
    while not fit.done:
        p, w, v = fit.order()
        if v is None:
            rows, z = block, block.x.times(w)
            loss, r = p.terms(rows, z, None)
        else:
            if bent is None:
                mine = p.bends(block, scores)
                bent = block.kept(mine), scores[mine]
            rows, z = bent
            loss, r = p.terms(rows, z, rows.x.times(v))
        total = _nothing(width, p.columns)
        rows.add_transposed(r, total)
        fit.take(loss, total)
        if v is None and fit.w is w:
            scores, bent = z, None


def _shares(
    problems: Sequence[Problem], numbers: Sequence[int], cells: dict[int, int], n: int
) -> list[list[int]]:
    """About ``n`` lists of neighbouring problems of one group, of about equal work."""
    work = {i: cells.get(problems[i].group, 0) * problems[i].columns for i in numbers}
    most, load, out = sum(work.values()) / n, 0.0, []
    for i in numbers:
        other = not out or problems[out[-1][-1]].group != problems[i].group
        if other or load + work[i] / 2 > most:
            out.append([])
            load = 0.0
        out[-1].append(i)
        load += work[i]
    return out


def _dealt(
    blocks: DataFrame, numbers: list[int], stored: Coefficients, cells: dict[int, int], tol: float,
    most: int, out: dict[int, Solution],
) -> None:
    """All steps in tasks that hold all rows of a group and a share of its problems each."""
    context, width, problems = blocks.sparkSession.sparkContext, stored.width, stored.problems
    shares = _shares(problems, numbers, cells, 2 * context.defaultParallelism)
    sent = context.broadcast([[(i, problems[i]) for i in share] for share in shares])

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        whole = Block.merged([Block(row) for batch in batches for row in batch.to_pylist()])
        sight, rows = None, whole
        for i, p in sent.value[key[0].as_py()]:
            if sight != (p.mask, p.part, p.parts):
                rows = None  # the rows of the last sight go first
                sight, rows = (p.mask, p.part, p.parts), whole.kept(p.seen(whole))
            fit = _Fit(p, width, tol, most)
            _fitted(fit, rows, width)
            found = None
            if p.part >= 0:
                mine = p.left_out(whole)
                hit = (whole.y[mine] == p.target).astype(float)
                found = curve(*pooled_scores(whole.x.kept(mine).times(fit.w)[:, 0], hit))
            yield pa.RecordBatch.from_pylist([fit.row(i, found)], _FITTED)

    of_group: dict[int, list] = defaultdict(list)
    for k, share in enumerate(shares):
        of_group[problems[share[0]].group].append(k)
    dealt = F.create_map(*[
        x for g, own in of_group.items() for x in (F.lit(g), F.array(*[F.lit(k) for k in own]))])
    copies = blocks.withColumn("share", F.explode(F.try_element_at(dealt, F.col("g"))))
    found = copies.repartitionByRange(len(shares), "share").groupBy("share").applyInArrow(
        run, _FITTED_DDL)
    _collected(stage(found, "solutions", **_FEW_ROWS), stored, out)
    sent.destroy()


def _share_out(own: list[_Fit], losses: np.ndarray, total: np.ndarray) -> None:
    at = 0
    for f, loss in zip(own, losses):
        f.take(float(loss), total[:, at:at + f.p.columns])
        at += f.p.columns
