"""All fits of a classification level as one stack: grid cells, folds, calibration parts, groups.

A level has a label and, for level-2 models, a group column: each group is a problem of its own. With
folds, every model is also fitted without each fold, and these columns of the stack give the grid
scores and the out-of-fold probabilities; the column that saw all rows is the refit. All of them
share the passes of :mod:`casebook.operators.newton`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casebook.operators.evaluate import macro_f1, outcomes
from casebook.operators.linear import CalibratedSvc, Ensemble, Logistic, probabilities
from casebook.operators.newton import STACK_BYTES, Problem, Solution, pack, solve
from casebook.operators.sampling import edges_below, fold_edges
from casebook.operators.voting import argmax_label
from casebook.sources.staging import bounded, stage

MODELS = ("logistic", "svc")


@dataclass(frozen=True)
class Settings:
    """Training parameters shared by all fits.

    ``train_rows`` bounds the labelled rows that a fit uses: beyond it, rows are chosen by the hash
    of their id, the same share of every class but the ``LEAST_ROWS`` of lowest hash of each at
    least; with two levels a class is a pair of labels. ``max_classes`` tells a label column from
    a mistaken one; a level has that many groups times classes at most. ``tol`` is the share of
    the first gradient's length that a fit may leave.
    """

    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4
    calibration_folds: int = 3
    folds: int = 5
    threads: int = 8
    id_column: str = "doc_id"
    train_rows: int | None = None
    max_classes: int = 1000


def balanced(sizes: dict) -> dict:
    n, k = sum(sizes.values()), len(sizes)
    return {c: n / (k * m) for c, m in sizes.items()}


class Fits:
    """Models by (model, group, mask, c). Their coefficients are read when they are asked for."""

    def __init__(self, solutions: dict[tuple, Solution], classes: dict[int, list[str]]):
        self.classes = classes
        self.parts: dict = defaultdict(list)
        # In order of their keys: the members of a part are in the order of the classes.
        for key in sorted(solutions):
            self.parts[key[:4]].append(solutions[key])

    def __contains__(self, key: tuple) -> bool:
        return key in self.parts

    def __getitem__(self, key: tuple) -> Logistic | CalibratedSvc:
        return self.loaded([key])[key]

    def size(self, key: tuple) -> int:
        return sum(s.stored.size(s.number) for s in self.parts[key])

    def loaded(self, keys: Iterable[tuple]) -> dict[tuple, Logistic | CalibratedSvc]:
        """Models with one reading of the coefficients."""
        wanted = {key: self.parts[key] for key in keys}
        stored = next((s.stored for own in wanted.values() for s in own), None)
        w = stored.read(s.number for own in wanted.values() for s in own) if stored else {}
        out: dict = {}
        for key, own in wanted.items():
            names = [self.classes[key[1]][y] for y in own[0].problem.classes]
            if key[0] == "logistic":
                out[key] = Logistic(names, w[own[0].number])
                continue
            members: dict = defaultdict(list)
            for s in own:
                members[s.problem.part].append((w[s.number], s.curve))
            out[key] = CalibratedSvc(names, [members[p] for p in sorted(members)])
        return out


@dataclass
class Level:
    """The fitted models of a level. Group 0 stands for all rows where there is no group column."""

    label: str
    group: str | None
    groups: list
    classes: dict[int, list[str]]
    grid: list[float]
    fits: Fits = field(repr=False)
    present: dict = field(repr=False)  # (group, mask) -> its classes
    solutions: dict = field(repr=False)
    rows: DataFrame = field(repr=False)
    best: dict = field(default_factory=dict)  # (model, group) -> c
    scores: DataFrame | None = None

    def _fitted(self, model: str, g: int, mask: int, c: float) -> list[tuple]:
        """The key of a model; where the SVM could not be fitted the logistic regression stands in."""
        keys = [(m, g, mask, c) for m in (model, "logistic")]
        return [key for key in keys if key in self.fits][:1]

    def _best(self, g: int, mask: int) -> list[tuple]:
        """The keys of both models with their best C, as far as they could be fitted."""
        keys = [(m, g, mask, self.best[m, g]) for m in MODELS if (m, g) in self.best]
        return [key for key in keys if key in self.fits]

    def _votes(self, wanted: dict[tuple[int, int], list[list[tuple]]]) -> dict:
        """Ensembles by (group, mask) from the keys of their models."""
        found = self.fits.loaded({key for lists in wanted.values() for keys in lists for key in keys})

        def made(at, keys):
            models = [found[key] for key in keys]
            return Ensemble(models[0].classes if models else self.present.get(at, [])[:1], models)

        return {at: [made(at, keys) for keys in lists] for at, lists in wanted.items()}

    def alone(self, model: str, g: int, mask: int, c: float) -> Ensemble:
        """One model; where the SVM could not be fitted the logistic regression stands in."""
        return self._votes({(g, mask): [self._fitted(model, g, mask, c)]})[g, mask][0]

    def ensemble(self, g: int = 0, mask: int = 0) -> Ensemble:
        """Both models with their best C, as far as they could be fitted."""
        return self._votes({(g, mask): [self._best(g, mask)]})[g, mask][0]

    def group_number(self) -> Column:
        """The group of a row; null where no group was trained."""
        if self.group is None:
            return F.lit(0)
        names = F.array(*[F.lit(g) for g in self.groups])
        place = F.array_position(names, F.col(self.group)) - 1
        return F.when(place >= 0, place.cast("int"))

    def class_names(self, g: Column) -> Column:
        lists = [F.array(*[F.lit(c) for c in self.classes[i]]) for i in range(len(self.groups))]
        return F.element_at(F.array(*lists), g + 1)

    def add_probabilities(self, df: DataFrame, out: str, g: Column | None = None) -> DataFrame:
        """Probabilities of the refitted ensembles, over the classes of the row's group."""
        votes = self._votes({(i, 0): [self._best(i, 0)] for i in range(len(self.groups))})
        scored = probabilities(votes, self.classes)
        own = self.group_number() if g is None else g
        return df.withColumn(out, scored(own, F.lit(0), F.unwrap_udt("features"))[0])

    def out_of_fold(self, out: str) -> DataFrame:
        """Training rows with probabilities by ensembles that never saw their fold."""
        masks = {k for k in self.present if k[1]}
        scored = probabilities(self._votes({k: [self._best(*k)] for k in masks}), self.classes)
        rows = self.rows.withColumn(
            out, scored(F.col("_g"), F.col("_fold") + 1, F.unwrap_udt("features"))[0])
        return rows.drop("_g", "_y", "_fold", "_cal")


# --- rows ---------------------------------------------------------------------------------------


def _sizes(df: DataFrame, group: str | None, label: str, most: int) -> dict:
    """Rows by (group, label) on the driver, in ascending order."""
    by = [F.col(group).alias("g") if group else F.lit(0).alias("g"), F.col(label).alias("y")]
    rows = df.groupBy(*by).count().orderBy("g", "y").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return {(r["g"], r["y"]): r["count"] for r in rows}


def _masks(fold: str | None, folds: Sequence[int]) -> Column:
    """The masks under which a row is seen: 0, and 1 + f for every fold f but its own."""
    everything = F.array(*[F.lit(m) for m in (0, *[1 + f for f in folds])])
    return F.filter(everything, lambda m: m != F.col(fold) + 1) if fold else everything


def _with_parts(rows: DataFrame, id_column: str, masks: Column, width: int, ways: int) -> DataFrame:
    """Add ``_cal``: for every mask the row's calibration part, stratified over the mask's rows.

    Only ids and labels are seen once for each mask, to find where the parts of a class end; every row
    then compares itself with these few edges, so rows with features are not shuffled.
    """
    salt = "calibration-42"
    seen = rows.select(F.col(id_column).alias("id"), "_g", "_y", F.explode(masks).alias("mask"))
    seen = seen.withColumn("s", F.concat_ws("|", "mask", "_g", "_y"))
    place = [F.split_part("stratum", F.lit("|"), F.lit(i)).cast("int") for i in (1, 2, 3)]
    edges = fold_edges(seen, "id", "s", ways, salt).groupBy("stratum").agg(
        F.collect_list("edge").alias("edges"))
    by_class = stage(
        edges.select(*[c.alias(n) for c, n in zip(place, ("_mask", "_g", "_y"))], "edges")
        .groupBy("_g", "_y")
        .agg(F.map_from_entries(F.collect_list(F.struct("_mask", "edges"))).alias("_ends")),
        "edges")
    part = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda m: F.when(
            F.array_contains(masks, m),
            F.greatest(edges_below(F.try_element_at("_ends", m), id_column, salt), F.lit(0)))
        .otherwise(F.lit(-1)))
    return rows.join(bounded(by_class), ["_g", "_y"], "left").select(
        *rows.columns, part.alias("_cal"))


# --- problems -----------------------------------------------------------------------------------


def _counts(rows: DataFrame, masks: Column, width: int, ways: int) -> dict:
    """Rows by (group, mask), class and calibration part, on the driver."""
    cells = rows.select("_g", "_y", "_cal", F.explode(masks).alias("mask")).groupBy(
        "_g", "mask", "_y", F.element_at("_cal", F.col("mask") + 1).alias("part")).count()
    out: dict = defaultdict(lambda: defaultdict(dict))
    for r in cells.collect():
        out[r["_g"], r["mask"]][r["_y"]][r["part"]] = r["count"]
    return out


def _listed(weights: dict, n: int) -> tuple[float, ...]:
    return tuple(float(weights.get(y, 0.0)) for y in range(n))


def _problems(
    counts: dict, classes: dict, grid: Sequence[float], s: Settings, models: Sequence[str]
) -> list[Problem]:
    """Every fit of the stack. A class of one row leaves the SVM out, a single class needs no fit."""
    out = []
    for (g, mask), cells in sorted(counts.items()):
        sizes = {y: sum(parts.values()) for y, parts in sorted(cells.items())}
        n = len(classes[g])
        if len(sizes) < 2:
            continue
        whole = _listed(balanced(sizes), n)
        kind = "logit" if len(sizes) == 2 else "soft"
        parts = min(s.calibration_folds, min(sizes.values()))
        targets = list(sizes)[1:] if len(sizes) == 2 else list(sizes)
        for c in grid:
            if "logistic" in models:
                out.append(Problem(
                    ("logistic", g, mask, c), g, kind, c, whole, mask, target=targets[0]))
            if "svc" not in models or parts < 2:
                continue
            for part in range(parts):
                fitting = balanced({
                    y: sum(k for p, k in own.items() if p % parts != part)
                    for y, own in cells.items()})
                for t in targets:
                    weights = fitting if len(sizes) == 2 else {
                        y: w if y == t else 1.0 for y, w in fitting.items()}
                    out.append(Problem(
                        ("svc", g, mask, c, part, t), g, "hinge", c, _listed(weights, n),
                        mask, part, parts, t))
    return out


def fit_level(
    train: DataFrame, label: str, s: Settings, grid: Sequence[float] | None = None,
    group: str | None = None, fold: str | None = None, models: Sequence[str] = MODELS,
) -> Level:
    """Fit both models of a level for every C of the grid, for all groups, in one stack.

    With ``fold`` every fit is also made without each fold. A grid needs folds: the C of the best
    mean macro F1 is taken, the first one on ties, for each group and model. Rows without a
    label or group train nothing.
    """
    if grid is not None and fold is None:
        raise ValueError("a grid needs folds")
    known = train.where(F.col(label).isNotNull())
    if group:
        known = known.where(F.col(group).isNotNull())
    sizes = _sizes(known, group, label, s.max_classes)
    groups = list(dict.fromkeys(g for g, _ in sizes))
    classes = {i: [y for g, y in sizes if g == name] for i, name in enumerate(groups)}
    places = known.sparkSession.createDataFrame(
        [(groups.index(g), classes[groups.index(g)].index(y), g, y) for g, y in sizes],
        T.StructType([
            T.StructField("_g", T.IntegerType()), T.StructField("_y", T.IntegerType()),
            T.StructField("_group", known.schema[group].dataType if group else T.IntegerType()),
            T.StructField("_label", known.schema[label].dataType)]))
    same = F.col(label) == F.col("_label")
    if group:
        same &= F.col(group) == F.col("_group")
    rows = known.join(F.broadcast(places), same).drop("_group", "_label")
    rows = rows.withColumn("_fold", F.col(fold).cast("int") if fold else F.lit(-1))
    # fold numbers; one row for each
    folds = sorted(r[0] for r in rows.select("_fold").distinct().collect()) if fold else []
    masks, width = _masks("_fold" if fold else None, folds), 1 + (max(folds) + 1 if folds else 0)
    ways = math.lcm(*range(1, s.calibration_folds + 1))
    # A fold can hold the only row of a class, so without folds alone it is known that no SVM fits.
    least = [min(n for (own, _), n in sizes.items() if own == name) for name in groups]
    if "svc" in models and (fold or any(n > 1 for n in least)):
        rows = _with_parts(rows, s.id_column, masks, width, ways)
    else:
        rows = rows.withColumn("_cal", F.array_repeat(F.lit(-1), width))
    rows = stage(rows, "level_rows")
    counts = _counts(rows, masks, width, ways)
    wanted = [s.c] if grid is None else list(grid)
    problems = _problems(counts, classes, wanted, s, models)
    first = rows.select(F.unwrap_udt("features").alias("v")).first()
    dims = 0 if first is None else (first["v"]["size"] or len(first["v"]["values"]))
    blocks = pack(rows.select(
        F.col("_g").alias("g"), F.col("_y").alias("y"), F.col("_fold").alias("fold"),
        F.col("_cal").alias("cal"), "features"), dims)
    solutions = solve(blocks, problems, dims, s.tol, s.max_iter) if problems else {}
    present = {
        k: [classes[k[0]][y] for y in sorted(cells)] for k, cells in counts.items()}
    level = Level(label, group, groups, classes, wanted, Fits(solutions, classes), present,
                  solutions, rows)
    level.best = {(m, g): wanted[0] for m in models for g in range(len(groups))}
    if grid is not None:
        level.scores, level.best = _graded(level, models)
    return level


def _turns(items: Iterable[tuple], size, most: int) -> Iterator[list[tuple]]:
    """Neighbouring items of bounded size together."""
    turn, total = [], 0
    for item in items:
        own = size(item)
        if turn and total + own > most:
            yield turn
            turn, total = [], 0
        turn.append(item)
        total += own
    if turn:
        yield turn


def _told(level: Level, cells: Sequence[tuple], turn: Sequence[tuple]) -> DataFrame:
    """``(_g, cell, _fold, t, p, n)`` of some (group, mask, cell): each scores the fold it left out."""
    mine: dict = defaultdict(list)
    for g, mask, i in turn:
        mine[g, mask].append(i)
    votes = level._votes({
        (g, mask): [level._fitted(cells[i][0], g, mask, cells[i][1]) for i in own]
        for (g, mask), own in mine.items()})
    scored = probabilities(votes, level.classes)
    numbers = F.create_map(*[
        x for (g, mask), own in mine.items()
        for x in (F.lit(f"{g}|{mask}"), F.array(*[F.lit(i) for i in own]))])
    mask = F.col("_fold") + 1
    rows = level.rows.withColumn("_cells", F.try_element_at(numbers, F.concat_ws("|", "_g", mask)))
    rows = rows.where(F.col("_cells").isNotNull())
    p = scored(F.col("_g"), mask, F.unwrap_udt("features"))
    rows = rows.select("_g", "_fold", F.col(level.label).alias("y_true"), "_cells", p.alias("_all"))
    one = rows.select("_g", "_fold", "y_true", F.inline(F.arrays_zip("_cells", "_all"))).toDF(
        "_g", "_fold", "y_true", "cell", "p")
    told = one.select(
        "_g", "_fold", "cell", "y_true",
        argmax_label(F.col("p"), level.class_names(F.col("_g"))).alias("y_pred"))
    counted = outcomes(told, by=["_g", "cell", "_fold"])
    scored.models.destroy()  # what it scored is staged
    return counted


def _graded(level: Level, models: Sequence[str]) -> tuple[DataFrame, dict]:
    """``(group, model, c, mean_macro_f1, best)`` and the best C of each (model, group).

    Models are scored in turns, so that the driver and the tasks hold a bounded number of them."""
    cells = [(m, c) for m in models for c in level.grid]
    items = [(g, mask, i) for g, mask in sorted(level.present) if mask for i in range(len(cells))]

    def size(item):
        g, mask, i = item
        return sum(level.fits.size(key) for key in level._fitted(cells[i][0], g, mask, cells[i][1]))

    by = ["_g", "cell", "_fold"]
    turns = [_told(level, cells, turn) for turn in _turns(items, size, STACK_BYTES)]
    if not turns:
        turns = [outcomes(level.rows.limit(0).selectExpr(*by[::2], "0 AS cell", "'' y_true", "'' y_pred"), by=by)]
    means = macro_f1(reduce(DataFrame.unionByName, turns), by).groupBy("_g", "cell").agg(
        F.avg("macro_f1").alias("score"))
    score = {(r["_g"], r["cell"]): r["score"] for r in means.collect()}  # groups times cells
    best = {}
    for g in range(len(level.groups)):
        for m in models:
            own = [(i, c) for i, (kind, c) in enumerate(cells) if kind == m]
            best[m, g] = max(own, key=lambda ic: score.get((g, ic[0]), 0.0))[1]
    lines = [
        (str(level.groups[g]), m, float(c), float(score.get((g, i), 0.0)), best[m, g] == c)
        for g in range(len(level.groups)) for i, (m, c) in enumerate(cells)]
    frame = level.rows.sparkSession.createDataFrame(
        lines, "`group` string, model string, c double, mean_macro_f1 double, best boolean")
    return frame, best
