"""Fitted linear classifiers and their probabilities, added to rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casebook.operators.newton import Sparse, sparse_rows


@dataclass
class Logistic:
    """A fitted L2 logistic regression; with two classes one column tells the second one."""

    classes: list[str]
    w: np.ndarray = field(repr=False)

    @property
    def matrices(self) -> list[np.ndarray]:
        return [self.w]

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        if len(self.classes) == 2:
            z = np.column_stack([np.zeros(len(z)), z])
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def add_probabilities(self, df: DataFrame, out: str) -> DataFrame:
        return Ensemble(self.classes, [self]).add_probabilities(df, out)


Curve = tuple[np.ndarray, np.ndarray]


@dataclass
class CalibratedSvc:
    """Linear SVMs, one per class and calibration part, with isotonic probability maps.

    With two classes only the second one has a model; the first gets the complement.
    """

    classes: list[str]
    members: list[list[tuple[np.ndarray, Curve]]] = field(repr=False)

    @property
    def matrices(self) -> list[np.ndarray]:
        return [w for member in self.members for w, _ in member]

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """The mean over the parts of the calibrated scores, made to add up to 1 (even if all are 0)."""
        mean, at = np.zeros((len(z), len(self.classes))), 0
        for member in self.members:
            p = np.column_stack([
                np.interp(z[:, at + i], *curve) for i, (_, curve) in enumerate(member)])
            at += len(member)
            if len(self.classes) == 2:
                p = np.column_stack([1 - p, p])
            else:
                total = p.sum(1, keepdims=True)
                p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / len(self.classes))
            mean += p
        return mean / len(self.members)

    def add_probabilities(self, df: DataFrame, out: str) -> DataFrame:
        return Ensemble(self.classes, [self]).add_probabilities(df, out)


@dataclass
class Ensemble:
    """Soft vote of the logistic regression and, where it could be fitted, the SVM.

    Without a model its single class is certain.
    """

    classes: list[str]
    models: list[Logistic | CalibratedSvc] = field(repr=False)

    def add_probabilities(self, df: DataFrame, out: str) -> DataFrame:
        scored = probabilities({(0, 0): [self]}, {0: self.classes})
        one = scored(F.lit(0), F.lit(0), F.unwrap_udt("features"))
        return df.withColumn(out, one[0])

    def class_array(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes])


def _vote(ensemble: Ensemble, z: np.ndarray, at: int, n: int, classes: Sequence[str]):
    """Mean probabilities over ``classes``; a class the models never saw has 0."""
    out = np.zeros((n, len(classes)))
    places = [list(classes).index(c) for c in ensemble.classes]
    if not ensemble.models:
        out[:, places] = 1.0
        return out, at
    for model in ensemble.models:
        width = sum(m.shape[1] for m in model.matrices)
        out[:, places] += model.probabilities(z[:, at:at + width]) / len(ensemble.models)
        at += width
    return out, at


def probabilities(votes: dict[tuple[int, int], list[Ensemble]], classes: dict[int, list[str]]):
    """A function of ``(group, mask, features struct)`` to an array of probability arrays.

    The models of a (group, mask) are listed in ``votes``; their arrays follow that order, each
    over the classes of the group. The models travel as one broadcast, the function's ``models``.
    """
    sent = SparkSession.active().sparkContext.broadcast((votes, classes))

    @F.arrow_udf("array<array<double>>")
    def scored(groups: pa.Array, masks: pa.Array, vectors: pa.Array) -> pa.Array:
        table, names = sent.value
        groups, masks = groups.to_numpy(), masks.to_numpy()
        out: list = [None] * len(groups)
        keys, place = np.unique(np.column_stack([groups, masks]), axis=0, return_inverse=True)
        place = place.ravel()
        for k, (g, mask) in enumerate(keys.tolist()):
            rows = np.flatnonzero(place == k)
            own = table[g, mask]
            mats = [m for e in own for model in e.models for m in model.matrices]
            z = np.zeros((len(rows), 0))
            if mats:
                joined = np.asfortranarray(np.concatenate(mats, axis=1))
                x: Sparse = sparse_rows(vectors.take(pa.array(rows)), len(joined) - 1)
                z = x.times(joined)
            at, cells = 0, []
            for ensemble in own:
                p, at = _vote(ensemble, z, at, len(rows), names[g])
                cells.append(p)
            for r, row in zip(rows.tolist(), np.stack(cells, axis=1).tolist()):
                out[r] = row
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    scored.models = sent
    return scored
