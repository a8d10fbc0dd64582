"""L1-penalised regression on sparse covariates: logistic and proportional
hazards, along a path of penalties, for all folds at once.

Rows are written once as arrays of (feature, value). A pass over them sums, in
the tasks and for every model that is still moving, the loss, the loss on the
fold it holds out, the gradient of all features, and the curvature of a
*block* of at most ``BLOCK`` features. On the driver cyclic coordinate descent
solves the block's quadratic model under the penalty; the next pass tests the
step (it is halved while the penalised loss rises) and the optimality of all
features. Penalties fall from the one that keeps every coefficient at zero;
each fit starts from the one before.

What leaves the tasks has the size of the features and of a block, never of
the rows, and is summed on executors before it reaches the driver.

In proportional hazards the cumulative baseline hazard is a table of days. With
it, a row adds to gradient and curvature as in a Poisson model; the curvature
of the mean is profiled out by a free constant, which leaves an upper bound of
the true curvature. Ties count by Breslow's rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.plans.prediction.features import feature_index
from vitalspan.session import literal_frame, materialize, share_code

#: Features whose curvature one pass measures.
BLOCK = 256
#: Rows that a task holds densely.
CHUNK = 4096
#: Sums of more tasks than this are added in two steps.
FAN_IN = 64


def sparse_rows(covariates: DataFrame, population: DataFrame, label, fold=None, day=None) -> tuple[DataFrame, DataFrame]:
    """``row_id, y, fold, day, idx, val`` of every population row, written, and
    the feature index. ``fold`` 0 is in no held-out part."""
    kept = covariates.join(population.select("row_id"), "row_id", "left_semi")
    index = materialize(feature_index(kept), "features")
    entries = kept.join(index, "covariate_id").groupBy("row_id", "idx").agg(F.sum(F.col("covariate_value").cast("double")).alias("v")).filter("v <> 0")
    listed = entries.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_e"))
    base = population.select(
        "row_id", label.cast("double").alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        (F.lit(0.0) if day is None else day).cast("double").alias("day"))
    rows = base.join(listed, "row_id", "left").select(
        "row_id", "y", "fold", "day", F.coalesce(F.col("_e.idx"), F.array().cast("array<int>")).alias("idx"),
        F.coalesce(F.col("_e.v"), F.array().cast("array<double>")).alias("val"))
    return materialize(rows, "rows"), index


@dataclass
class _Fit:
    """One model on its way down the path."""

    fold: int
    size: int
    beta: np.ndarray = None
    constant: float = 0.0
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: int = 0
    before: tuple[np.ndarray, float] | None = None
    objective: float = math.inf
    halvings: int = 0

    def __post_init__(self):
        self.beta = np.zeros(self.size)


@dataclass(frozen=True)
class _Sums:
    """What a pass says about one model."""

    rows: float
    held_rows: float
    loss: float
    held_loss: float
    slope: float
    gradient: np.ndarray
    curvature: np.ndarray


def _flat_total(parts: DataFrame, n: int, tasks: int) -> np.ndarray:
    """Sum of one array per task, added on executors."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    if tasks > FAN_IN:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, "x binary")
    return np.frombuffer(parts.repartition(1).mapInArrow(add, "x binary").collect()[0]["x"], np.float64)  # first() would end the worker early


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    y, fold, day, idx, val = (b.column(i) for i in range(5))
    starts = idx.offsets.to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    return y.to_numpy(), fold.to_numpy(), day.to_numpy(), row, idx.flatten().to_numpy(), val.flatten().to_numpy()


def _margin(n: int, row: np.ndarray, idx: np.ndarray, val: np.ndarray, beta: np.ndarray, constant: float) -> np.ndarray:
    return constant + np.bincount(row, val * beta[idx], n)


def _pass(rows: DataFrame, size: int, fits: Sequence[_Fit], hazards: list | None, tasks: int) -> list[_Sums]:
    """Sums of every fit. ``hazards`` holds, for proportional hazards, the days
    and cumulative hazards of each."""
    plan = [(f.fold, f.beta, f.constant, f.block) for f in fits]
    lengths = [5 + size + (len(f.block) + 1) ** 2 for f in fits]
    shared = rows.sparkSession.sparkContext.broadcast((plan, hazards))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, hazards = shared.value
        totals = [np.zeros(n) for n in lengths]
        curves = [np.zeros((len(block) + 1,) * 2) for *_, block in plan]
        places = []
        for *_, block in plan:
            place = np.full(size, -1)
            place[block] = np.arange(len(block))
            places.append(place)
        for b in batches:
            y, fold, day, row, idx, val = _arrays(b)
            n = len(y)
            for m, (held, beta, constant, block) in enumerate(plan):
                eta = _margin(n, row, idx, val, beta, constant)
                mine = fold != held if held else np.ones(n, bool)
                if hazards is None:
                    loss = np.logaddexp(0, eta) - y * eta
                    mean = 0.5 * (1 + np.tanh(eta / 2))
                    weight = mean * (1 - mean)
                else:
                    days, cumulative = hazards[m]
                    loss = np.zeros(n)
                    mean = weight = np.exp(eta) * np.concatenate([[0.0], cumulative])[np.searchsorted(days, day, side="right")]
                residual = np.where(mine, mean - y, 0.0)
                t = totals[m]
                t[:5] += (mine.sum(), n - mine.sum(), loss[mine].sum(), loss[~mine].sum(), residual.sum())
                t[5:5 + size] += np.bincount(idx, val * residual[row], size)
                place = places[m]
                chosen = np.flatnonzero(place[idx] >= 0) if len(block) else np.zeros(0, int)
                edges = np.searchsorted(row[chosen], np.arange(0, n + CHUNK, CHUNK))
                for c, start in enumerate(range(0, n, CHUNK)):
                    stop = min(start + CHUNK, n)
                    dense = np.zeros((stop - start, len(block) + 1))
                    dense[:, 0] = 1
                    part = chosen[edges[c]:edges[c + 1]]
                    dense[row[part] - start, 1 + place[idx[part]]] = val[part]
                    curves[m] += dense.T @ (dense * (weight * mine)[start:stop, None])
        for t, curve in zip(totals, curves, strict=True):
            t[5 + size:] = curve.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(totals).tobytes()], pa.binary())], names=["x"])

    flat = _flat_total(rows.select("y", "fold", "day", "idx", "val").mapInArrow(work, "x binary"), sum(lengths), tasks)
    shared.unpersist()
    out, at = [], 0
    for f, n in zip(fits, lengths, strict=True):
        t = flat[at:at + n]
        at += n
        out.append(_Sums(*t[:5].tolist(), t[5:5 + size], t[5 + size:].reshape((len(f.block) + 1,) * 2)))
    return out


def _baseline(rows: DataFrame, days: np.ndarray, fits: Sequence[_Fit], tasks: int) -> tuple[list, list[float], list[float]]:
    """Cumulative hazards, loss and held-out loss (negative partial
    log-likelihoods) of every fit, from sums of a day."""
    plan = [(f.fold, f.beta) for f in fits]
    shared = rows.sparkSession.sparkContext.broadcast((plan, days))
    k = len(days)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, days = shared.value
        total = np.zeros((len(plan), 2, 3, k))  # trained and held: risk, events, margins of events
        for b in batches:
            y, fold, day, row, idx, val = _arrays(b)
            at = np.searchsorted(days, day)
            for m, (held, beta) in enumerate(plan):
                eta = _margin(len(y), row, idx, val, beta, 0.0)
                out = fold == held if held else np.zeros(len(y), bool)
                for side, chosen in enumerate((~out, out)):
                    for i, v in enumerate((np.exp(eta), y, y * eta)):
                        total[m, side, i] += np.bincount(at[chosen], v[chosen], k)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    parts = rows.select("y", "fold", "day", "idx", "val").mapInArrow(work, "x binary")
    total = _flat_total(parts, len(fits) * 6 * k, tasks).reshape(len(fits), 2, 3, k)
    shared.unpersist()
    hazards, losses, held = [], [], []
    for m in range(len(fits)):
        both = []
        for side in (0, 1):
            risk, events, margins = total[m, side]
            at_risk = np.cumsum(risk[::-1])[::-1]
            some = events > 0
            both.append(float(events[some] @ np.log(at_risk[some]) - margins.sum()))
            if not side:
                step = np.zeros(k)
                step[some] = events[some] / at_risk[some]
                hazards.append((days, np.cumsum(step)))
        losses.append(both[0])
        held.append(both[1])
    return hazards, losses, held


def _solve_block(beta: np.ndarray, slope: float, gradient: np.ndarray, curvature: np.ndarray, limit: float, sweeps: int = 1000) -> tuple[float, np.ndarray]:
    """Cyclic coordinate descent on the penalised quadratic model of a block:
    the step of the constant and the new coefficients."""
    g = np.concatenate([[slope], gradient])
    h = curvature + np.diag(np.r_[1e-10, np.full(len(beta), 1e-10)] * max(float(np.trace(curvature)) / len(g), 1e-300))
    new = np.concatenate([[0.0], beta])
    curve = np.diag(h).copy()
    scale = max(float(np.abs(g).max()), limit, 1e-300)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(new)):
            if curve[j] <= 0:
                continue
            wanted = curve[j] * new[j] - g[j]
            value = wanted / curve[j] if j == 0 else math.copysign(max(abs(wanted) - limit, 0.0), wanted) / curve[j]
            step = value - new[j]
            if step:
                g += step * h[:, j]
                new[j] = value
                most = max(most, abs(step) * curve[j])
        if most < 1e-13 * scale:
            break
    return float(new[0]), new[1:]


def violations(beta: np.ndarray, gradient: np.ndarray, limit: float) -> np.ndarray:
    """How far each feature is from the optimality conditions."""
    return np.where(beta != 0, np.abs(gradient + limit * np.sign(beta)), np.maximum(np.abs(gradient) - limit, 0.0))


@dataclass(frozen=True)
class Step:
    """A model at a penalty: its coefficients and what it leaves."""

    penalty: float
    fold: int
    rows: int
    held_rows: int
    loss: float
    held_loss: float
    constant: float
    beta: np.ndarray
    violation: float


@dataclass
class PathResult:
    """All steps, the chosen penalty, and the final model.

    ``penalties`` are per row: a coefficient is pulled by ``penalty * rows``.
    """

    family: str
    index: DataFrame
    rows: DataFrame
    penalties: list[float]
    steps: list[Step]
    final: Step

    def coefficients(self) -> DataFrame:
        """``covariate_id, coefficient`` of the final model, nonzero only."""
        at = np.flatnonzero(self.final.beta)
        table = literal_frame(self.index.sparkSession, [(int(i), float(self.final.beta[i])) for i in at], "idx int, coefficient double")
        return self.index.join(table, "idx").select("covariate_id", "coefficient")

    def fold_losses(self) -> DataFrame:
        """``penalty, fold, rows, loss``: negative log-likelihood on held-out rows."""
        held = [(s.penalty, s.fold, s.held_rows, s.held_loss) for s in self.steps if s.fold]
        return literal_frame(self.index.sparkSession, held, "penalty double, fold int, rows long, loss double")


def penalty_path(largest: float, count: int, ratio: float) -> list[float]:
    return [largest * ratio ** (i / max(count - 1, 1)) for i in range(count)]


def lasso_path(rows: DataFrame, index: DataFrame, family: str = "logistic", penalties: Sequence[float] | None = None, count: int = 8, ratio: float = 0.02,
               tolerance: float = 1e-7, final_tolerance: float = 1e-12, rounds: int = 200) -> PathResult:
    """Fits every fold's model and the whole one down the path; the penalty
    with the least held-out loss (of equals the largest) is fitted on all rows.

    Without ``penalties`` they fall in ``count`` equal ratios from the least
    one that selects nothing to ``ratio`` of it. Without folds the last
    penalty is taken. Rows must not be empty and, for a logistic model, have
    both outcomes. Raises if a model has not converged after ``rounds`` passes
    in a row, rather than returning an unfinished one.
    """
    size = index.count()
    folds = [r[0] for r in rows.filter("fold > 0").select("fold").distinct().orderBy("fold").collect()]
    share_code(rows.sparkSession)
    tasks = rows.rdd.getNumPartitions()
    if family == "cox":
        # risk sets need the days of all rows; whole days of a risk window bound them
        days = np.array([r[0] for r in rows.select("day").distinct().orderBy("day").collect()], float)
    fits = [_Fit(f, size) for f in (0, *folds)]
    if family == "logistic":
        means = {r["fold"]: (r["n"], r["s"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()}
        for f in fits:
            n, s = (sum(v[i] for k, v in means.items() if not f.fold or k != f.fold) for i in (0, 1))
            if not 0 < s < n:
                raise ValueError("every training part needs both outcomes")
            f.constant = math.log(s / (n - s))

    def measure(some: Sequence[_Fit]) -> list[_Sums]:
        if family == "logistic":
            return _pass(rows, size, some, None, tasks)
        hazards, losses, held = _baseline(rows, days, some, tasks)
        return [replace(s, loss=a, held_loss=b) for s, a, b in zip(_pass(rows, size, some, hazards, tasks), losses, held, strict=True)]

    first = measure(fits)
    whole = first[0]
    path = list(penalties) if penalties is not None else penalty_path(max(float(np.abs(whole.gradient).max(initial=0.0)) / whole.rows, 1e-12), count, ratio)
    def choose(f: _Fit, gradient: np.ndarray, limit: float, last: float) -> None:
        score = violations(f.beta, gradient, limit)
        score = np.where(f.beta != 0, score + 1e-6 * limit, score)
        strong = np.abs(gradient) >= max(2 * limit - last, 0.5 * limit)
        score = np.where((score == 0) & strong, 1e-9 * np.abs(gradient), score)
        top = np.argsort(-score, kind="stable")[:BLOCK]
        f.block = np.sort(top[score[top] > 0])

    def advance(f: _Fit, s: _Sums, targets: Sequence[float], accuracy: float) -> Step | None:
        """Takes one step of a model, or says it has converged."""
        limit = targets[f.at] * s.rows
        objective = s.loss + limit * float(np.abs(f.beta).sum())
        worst = max(float(violations(f.beta, s.gradient, limit).max(initial=0.0)), abs(s.slope) if family == "logistic" else 0.0)
        if worst <= accuracy * s.rows:
            return Step(targets[f.at], f.fold, int(s.rows), int(s.held_rows), s.loss, s.held_loss, f.constant, f.beta.copy(), worst)
        if f.before is not None and objective > f.objective + 1e-12 * abs(f.objective) and f.halvings < 30:
            f.beta, f.constant = (f.beta + f.before[0]) / 2, (f.constant + f.before[1]) / 2
            f.halvings += 1
            return None
        f.before, f.objective, f.halvings = (f.beta.copy(), f.constant), objective, 0
        gradient = s.gradient
        if s.curvature.shape[0] == len(f.block) + 1:
            move, new = _solve_block(f.beta[f.block], s.slope, gradient[f.block], s.curvature, limit)
            step = np.concatenate([[move], new - f.beta[f.block]])
            gradient = gradient.copy()
            gradient[f.block] += s.curvature[1:] @ step
            f.beta[f.block] = new
            if family == "logistic":
                f.constant += move
        choose(f, gradient, limit, limit / 0.7)
        return None

    def run(moving: list[_Fit], targets: Sequence[float], accuracy: float, sums: list[_Sums]) -> list[Step]:
        done: list[Step] = []
        tries = 0
        for f, s in zip(moving, sums, strict=True):
            choose(f, s.gradient, targets[f.at] * s.rows, targets[f.at] * s.rows)
        while moving:
            tries += 1
            if tries > rounds * len(targets):
                raise RuntimeError("penalised regression has not converged")
            left = []
            for f, s in zip(moving, measure(moving), strict=True):
                step = advance(f, s, targets, accuracy)
                if step is not None:
                    done.append(step)
                    f.at, f.before, f.objective, f.halvings = f.at + 1, None, math.inf, 0
                    if f.at < len(targets):
                        choose(f, s.gradient, targets[f.at] * s.rows, targets[f.at - 1] * s.rows)
                if f.at < len(targets):
                    left.append(f)
            moving = left
        return done

    steps = run(fits, path, tolerance, first)
    if folds:
        held = {p: sum(s.held_loss for s in steps if s.fold and s.penalty == p) for p in path}
        best = min(path, key=lambda p: (held[p], -p))
    else:
        best = path[-1]
    start = next(s for s in steps if not s.fold and s.penalty == best)
    last = _Fit(0, size, constant=start.constant)
    last.beta = start.beta.copy()
    final = run([last], [best], final_tolerance, measure([last]))[0]
    return PathResult(family, index, rows, path, steps, final)


# --- coordinate boosting ----------------------------------------------------------
@dataclass
class BoostResult:
    index: DataFrame
    constant: float
    weights: np.ndarray
    losses: list[float]

    def coefficients(self) -> DataFrame:
        """``covariate_id, coefficient`` of every feature, zeros too."""
        table = literal_frame(self.index.sparkSession, [(i, float(w)) for i, w in enumerate(self.weights)], "idx int, coefficient double")
        return self.index.join(table, "idx").select("covariate_id", "coefficient")


def _diagonal(rows: DataFrame, size: int, constant: float, weights: np.ndarray, tasks: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, and gradient and curvature of the constant and each feature."""
    shared = rows.sparkSession.sparkContext.broadcast((constant, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constant, weights = shared.value
        total = np.zeros(1 + 2 * (size + 1))
        for b in batches:
            y, _, _, row, idx, val = _arrays(b)
            eta = _margin(len(y), row, idx, val, weights, constant)
            mean = 0.5 * (1 + np.tanh(eta / 2))
            total[0] += (np.logaddexp(0, eta) - y * eta).sum()
            for at, v, power in ((1, mean - y, val), (2 + size, mean * (1 - mean), val * val)):
                total[at] += v.sum()
                total[at + 1:at + 1 + size] += np.bincount(idx, power * v[row], size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    flat = _flat_total(rows.select("y", "fold", "day", "idx", "val").mapInArrow(work, "x binary"), 1 + 2 * (size + 1), tasks)
    shared.unpersist()
    return float(flat[0]), flat[1:2 + size], flat[2 + size:]


def coordinate_boosting(rows: DataFrame, index: DataFrame, rounds: int = 10, rate: float = 0.3, l1: float = 0.0, l2: float = 1.0) -> BoostResult:
    """A linear booster: each round moves all weights by ``rate`` of their own
    Newton steps under an elastic net, from one gradient and one curvature sum
    per feature. The constant is not penalised. A round after which the
    penalised loss is higher is taken back and repeated at half the rate, so
    the loss never rises. ``losses`` holds the training loss before each round
    and after the last one.
    """
    share_code(rows.sparkSession)
    size, tasks = index.count(), rows.rdd.getNumPartitions()
    w = np.zeros(size + 1)
    shrink = np.r_[0.0, np.full(size, l1)], np.r_[0.0, np.full(size, l2)]

    def measure(w: np.ndarray):
        loss, gradient, curvature = _diagonal(rows, size, float(w[0]), w[1:], tasks)
        return loss, loss + float(shrink[0] @ np.abs(w) + shrink[1] @ (w * w) / 2), gradient, curvature

    loss, penalised, gradient, curvature = measure(w)
    losses = [loss]
    for _ in range(rounds):
        wanted = curvature * w - gradient
        target = np.sign(wanted) * np.maximum(np.abs(wanted) - shrink[0], 0.0) / np.maximum(curvature + shrink[1], 1e-12)
        while True:
            new = w + rate * (target - w)
            found = measure(new)
            if found[1] <= penalised or rate < 1e-9:
                break
            rate /= 2
        w, (loss, penalised, gradient, curvature) = new, found
        losses.append(loss)
    return BoostResult(index, float(w[0]), w[1:], losses)
