"""Exact nearest vectors by inner product, with norm order, rotated partial sums and residual bounds.

Vectors are rounded down to integers, ``floor(256 x)``, and scores are exact integers. Candidates
are dealt by a range sort on descending length (ties by id, so copies of one vector spread), and
every task reads its own in that order. Queries come in blocks of bounded size, which travel to
all tasks. A task turns vectors and queries by the eigenvectors of the candidates' second moments
(the right singular vectors of the table), so most of a product lies in the first places. After
each of a few cuts the sum so far plus the product of the two remaining lengths (Cauchy-Schwarz)
bounds the score from above; candidates that can't reach the ``k``-th best score of any query end
there. A task stops when even its longest vector left can't. Bounds carry a margin for rounding;
what survives them is multiplied out in integers. The first bars are the queries' best scores
among themselves, so tasks put out little.

Null vectors and those with null or infinite components or NaN take no part. Shorter vectors end in
zeros; an empty one has score 0. Ties go to the smaller id, a null id comes last. A row is never
a candidate for the query of its own id; of rows that repeat a query's id the least vector asks.
Scores beyond 64 bits are held at their ends. Fewer candidates than ``k`` give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from casebook.sources.staging import fresh_path, stage

SCALE = 256
EVERY = 50
TOP = 5
#: Numbers in a block of queries (rows times dimensions) and in a table of scores in a task.
QUERY_CELLS = 1 << 20
SCORE_CELLS = 1 << 22
#: Bytes of vectors of a task.
TASK_BYTES = 4 << 20
#: Shares of the table's square length at which a sum is held against the bars.
CUTS = (0.5, 0.75, 0.9)
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)
_NO_ID = (1 << 63) - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of whole numbers, with zeros behind short ones."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        out = values.reshape(-1, width)
    else:
        out = np.zeros((len(lengths), width))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, places] = values
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -np.finfo(float).max, np.finfo(float).max)


def _moments(width: int):
    """Sums of products of components, over a task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column("vector"), width)
            with np.errstate(over="ignore", invalid="ignore"):
                total += rows.T @ rows
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
            ["i", "j", "value"])

    return run


@dataclass
class Rotation:
    """An orthogonal turn and the numbers of leading places at which sums are checked."""

    axes: np.ndarray
    cuts: list[int]


def rotation(candidates: DataFrame, width: int) -> Rotation:
    """From the table's second moments: ``width`` squared numbers meet on the driver."""
    sums = candidates.select("vector").mapInArrow(
        _moments(width), "i int, j int, value double",
    ).groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    moments = np.zeros((width, width))
    moments[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["value"].to_numpy()
    if not np.isfinite(moments).all():
        return Rotation(np.eye(width), [])
    values, axes = np.linalg.eigh(moments)
    share = np.cumsum(np.maximum(values[::-1], 0)) / max(float(np.maximum(values, 0).sum()), 1.0)
    cuts = {int(np.searchsorted(share, c)) + 1 for c in CUTS}
    return Rotation(np.ascontiguousarray(axes[:, ::-1]), sorted(c for c in cuts if c < width))


class _Queries:
    """A block of queries with their best candidates so far, kept as a table of ``top`` columns."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, turn: Rotation, top: int):
        self.ids, self.rows, self.turn, self.top = ids, rows, turn, top
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((rows * rows).sum(1))
            self.turned = rows @ turn.axes if np.isfinite(self.norms).all() else rows
        self.bars = np.full(len(ids), -np.inf)  # no score below can be among the best
        self.scores = np.full((len(ids), top), -np.inf)
        self.found = np.full((len(ids), top), _NO_ID, np.int64)
        self.filled = np.zeros((len(ids), top), bool)

    def seed(self) -> None:
        """Bars from the other queries of the block, which are candidates too."""
        step = max(1, SCORE_CELLS // max(1, len(self.ids)))
        for at in range(0, len(self.ids), step):
            mine = slice(at, at + step)
            scores = self._table(self.rows[mine], self.rows, self.norms[mine].max(), self.norms.max())
            scores = np.where(self.ids[mine, None] == self.ids[None], -np.inf, scores.astype(float))
            if scores.shape[1] > self.top:
                best = np.partition(scores, -self.top, axis=1)[:, -self.top]
                self.bars[mine] = np.nextafter(best, -np.inf) if np.abs(best).max() >= _EXACT else best

    @staticmethod
    def _table(a: np.ndarray, b: np.ndarray, most_a: float, most_b: float) -> np.ndarray:
        """Exact products of whole numbers, all pairs; long ones by Python's integers."""
        if most_a * most_b < _EXACT:
            return a @ b.T
        a, b = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
        cells = [[sum(x * y for x, y in zip(p, q)) for q in b] for p in a]
        return np.clip(np.array(cells, object), *_LONG)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> bool:
        """Hold candidates against all queries; False if later, shorter ones can't matter."""
        with np.errstate(over="ignore"):
            norms = np.sqrt((rows * rows).sum(1))
        most = float(norms.max())
        if not (float(self.norms.max()) * most < _EXACT):
            q, c = (x.ravel() for x in np.mgrid[:len(self.ids), :len(ids)])
            table = self._table(self.rows, rows, np.inf, np.inf)
            self._take(q, ids[c], table.ravel())
            return True
        with np.errstate(invalid="ignore"):
            open_ = self.norms * most >= self.bars
        if not open_.any():
            return False
        asked = np.flatnonzero(open_)
        turned = rows @ self.turn.axes
        left = np.arange(len(ids))
        sums = np.zeros((len(asked), len(left)))
        rest_q, rest_c = self.norms[asked] ** 2, norms ** 2
        margin = 1e-9 * (self.norms[asked].max() * most + 1)
        at, alive = 0, None
        for cut in self.turn.cuts:
            a, b = self.turned[asked, at:cut], turned[left, at:cut]
            sums += a @ b.T
            rest_q = np.maximum(rest_q - (a * a).sum(1), 0)
            rest_c = np.maximum(rest_c - (b * b).sum(1), 0)
            slack = np.sqrt(rest_q + margin)[:, None] * np.sqrt(rest_c + margin)[None]
            alive = sums + slack + margin >= self.bars[asked, None]
            stay = alive.any(0)
            if not stay.all():
                left, sums, rest_c, alive = left[stay], sums[:, stay], rest_c[stay], alive[:, stay]
            at = cut
            if not len(left):
                return True
        if alive is None or alive.mean() > 0.05:
            scores = self.rows[asked] @ rows[left].T  # exact: all sums stay below 2^53
            q, c = np.nonzero(scores >= self.bars[asked, None])
            scores = scores[q, c]
        else:
            q, c = np.nonzero(alive)
            scores = np.einsum("ij,ij->i", self.rows[asked[q]], rows[left[c]])
        self._take(asked[q], ids[left[c]], scores)
        return True

    def _take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put candidates into the table of the best, ``q`` ascending."""
        worst, last = self.scores[q, -1], self.found[q, -1]
        good = (self.ids[q] != ids) & (
            (scores > worst) | (scores == worst) & ((ids < last) | ~self.filled[q, -1]))
        good &= scores >= self.bars[q]
        q, ids, scores = q[good], ids[good], scores[good]
        if not len(q):
            return
        own = np.unique(q)
        old_q = np.repeat(own, self.top)
        old = self.filled[own].ravel()
        all_q = np.concatenate([old_q[old], q])
        all_ids = np.concatenate([self.found[own].ravel()[old], ids])
        all_scores = np.concatenate([self.scores[own].ravel()[old], scores])
        if all_scores.dtype == object:
            order = np.array(sorted(
                range(len(all_q)), key=lambda i: (all_q[i], -all_scores[i], all_ids[i])))
        else:
            order = np.lexsort((all_ids, -all_scores, all_q))
        all_q, all_ids, all_scores = all_q[order], all_ids[order], all_scores[order]
        place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
        kept = place < self.top
        q, place = all_q[kept], place[kept]
        if all_scores.dtype == object and self.scores.dtype != object:
            self.scores = self.scores.astype(object)
        self.scores[own], self.found[own], self.filled[own] = -np.inf, _NO_ID, False
        self.scores[q, place], self.found[q, place] = all_scores[kept], all_ids[kept]
        self.filled[q, place] = True
        full = own[self.filled[own, -1]]
        self.bars[full] = np.maximum(self.bars[full], self.scores[full, -1].astype(float))

    def best(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.filled)
        found = self.found[q, place]
        scores = pa.array([int(x) for x in self.scores[q, place].tolist()], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[q]), pa.array(found, mask=found == _NO_ID), scores],
            ["query_id", "vec_id", "score"])


def _searcher(block, width: int, turn: Rotation, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, bars = block.value
        queries = _Queries(ids, rows, turn, top)
        queries.bars = bars.copy()
        step = max(64, SCORE_CELLS // max(1, len(ids)))
        going = True
        for batch in batches:
            if not going:
                continue  # the rest is read, but not held against anything
            own = batch.column("id")
            numbers = own.fill_null(_NO_ID).to_numpy()
            vectors = _matrix(batch.column("vector"), width)
            for at in range(0, len(numbers), step):
                going = queries.meet(numbers[at:at + step], vectors[at:at + step])
                if not going:
                    break
        yield queries.best()

    return run


def candidates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, vector, length)`` of the usable rows, staged in ranges of descending length."""
    named = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = named.where(usable(F.col("vector"))).withColumn(
        "vector", F.col("vector").cast("array<double>"))
    square = F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE).cast("double"), 2))
    rows = stage(rows.withColumn("length", F.sqrt(square)), "vectors")
    order = [F.desc("length"), F.col("id").asc_nulls_last()]
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    tasks = (size[0] or 0) * max(1, size[1] or 1) * 8 // TASK_BYTES + 1
    return stage(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order), "ranged")


def search(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` candidates of every query.

    ``rows`` comes from :func:`candidates`; ``queries`` are ``(id, vector)`` rows of the same kind.
    """
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score long"
    asked = queries.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    n = asked.count()
    width = rows.agg(F.max(F.size("vector"))).first()[0] if n else 0
    if not n or width is None:
        empty = spark.createDataFrame([], schema)
        return _ranked(empty, top)
    width = max(1, width, asked.agg(F.max(F.size("vector"))).first()[0])
    turn = rotation(rows, width)
    blocks = n * width // QUERY_CELLS + 1
    asked = stage(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    parts = []
    for b in range(blocks):  # one job for each block of bounded size, over all candidates
        table = asked.where(F.col("block") == b).orderBy("id").toArrow()
        if not table.num_rows:
            continue
        block = _Queries(
            table["id"].to_numpy(), _matrix(table["vector"].combine_chunks(), width), turn, top)
        block.seed()
        sent = spark.sparkContext.broadcast((block.ids, block.rows, block.bars))
        found = rows.select("id", "vector").mapInArrow(_searcher(sent, width, turn, top), schema)
        if blocks == 1:
            return _ranked(found, top)
        parts.append(fresh_path(spark, f"best_{b}"))
        _ranked(found, top).write.parquet(parts[-1])
        sent.unpersist()
    return spark.read.parquet(*parts)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """The ``top`` nearest rows of every row whose id is divisible by ``every``."""
    rows = candidates(vectors)
    return search(rows, rows.where(F.col("id") % every == 0), top)
