"""Support vector classifier with exact kernels: search over C, gamma and kernel, and Platt's probability.

The dual problem of every candidate and fold is solved whole, to the tolerance of libsvm; no row is left out and no
kernel approximated. A fit is one task that holds the training rows (numbers only) and blocks of the kernel, never the
whole kernel: memory grows with the rows, time with rows times support vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailquarry.ml.prepare import SEED

GRID = {"C": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", "auto", 0.001, 0.01, 0.1, 1.0], "kernel": ["rbf", "linear"]}
FOLDS = 5
TOLERANCE = 1e-3
CURVE = "C double, gamma double, kernel string, bias double, slope double, offset double"
#: Variables solved at once, and rows whose kernel with them is held at once
WORKING_SET, BLOCK_ROWS = 1024, 4096


@dataclass
class SvmModel:
    """Weighted support vectors (one weight vector for the linear kernel), bias and Platt's curve."""

    C: float
    gamma: float
    kernel: str
    support: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = -1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if len(self.weights):
            for at in range(0, len(x), BLOCK_ROWS):
                for of in range(0, len(self.weights), BLOCK_ROWS):
                    block = kernel(x[at:at + BLOCK_ROWS], self.support[of:of + BLOCK_ROWS], self.kernel, self.gamma)
                    out[at:at + BLOCK_ROWS] += block @ self.weights[of:of + BLOCK_ROWS]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _curve(self.slope * self.margin(x) + self.offset)

    def transform(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds the probability of the positive class as ``name``."""
        sent = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def positive(features: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in features:
                yield pd.Series(sent.value.probability(np.stack(batch.to_numpy())) if len(batch) else [], dtype="float64")

        return rows.withColumn(name, positive(vector_to_array("features")))

    def save(self, path: str) -> None:
        spark, curve = SparkSession.active(), [(self.C, self.gamma, self.kernel, self.bias, self.slope, self.offset)]
        schema = pa.schema([("support", pa.list_(pa.float64())), ("weight", pa.float64())])
        vectors = pa.table([pa.array([*self.support], schema.field(0).type), pa.array(self.weights)], schema=schema)
        spark.createDataFrame(curve, CURVE).write.mode("overwrite").parquet(f"{path}/curve")
        spark.createDataFrame(vectors).write.mode("overwrite").parquet(f"{path}/vectors")


def load(path: str) -> SvmModel:
    spark = SparkSession.active()
    x, weights = _matrix(spark.read.parquet(f"{path}/vectors"))
    return SvmModel(**spark.read.schema(CURVE).parquet(f"{path}/curve").first().asDict(), support=x, weights=weights)


def _matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of the first column as rows of a matrix, and the second column."""
    table = rows.toArrow()
    flat = table.column(0).combine_chunks().flatten().to_numpy()
    return flat.reshape(len(table), -1) if len(table) else flat.reshape(0, 0), table.column(1).to_numpy()


def kernel(a: np.ndarray, b: np.ndarray, name: str, gamma: float) -> np.ndarray:
    inner = a @ b.T
    if name == "linear":
        return inner
    inner *= 2.0
    inner -= (a * a).sum(axis=1)[:, None]
    inner -= (b * b).sum(axis=1)
    np.minimum(inner, 0.0, out=inner)
    inner *= gamma
    return np.exp(inner, out=inner)


def width(x: np.ndarray, gamma: str | float) -> float:
    """``scale`` and ``auto`` as numbers."""
    if gamma == "scale":
        spread = x.var()
        return float(1.0 / (x.shape[1] * spread)) if spread else 1.0
    return 1.0 / x.shape[1] if gamma == "auto" else float(gamma)


def _curve(t: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(t))
    return np.where(t >= 0, small, 1.0) / (1.0 + small)


def fit(x: np.ndarray, y: np.ndarray, C: float, gamma: float, name: str) -> SvmModel:
    """The classifier of labels ``y`` (true, false) for one candidate; with one class only, that class everywhere."""
    if y.all() or not y.any():
        return SvmModel(C, gamma, name, x[:0], np.zeros(0), 1.0 if y.any() else -1.0)
    sign = np.where(y, 1.0, -1.0)
    if name == "linear":
        if (found := _linear(x, sign, C)) is None:
            beta, bias = _decompose(x, sign, C, gamma, name)
            found = beta @ x, bias
        return SvmModel(C, gamma, name, found[0][None, :], np.ones(1), found[1])
    beta, bias = _decompose(x, sign, C, gamma, name)
    used = beta != 0
    return SvmModel(C, gamma, name, x[used], beta[used], bias)


def _linear(x: np.ndarray, sign: np.ndarray, C: float) -> tuple[np.ndarray, float] | None:
    """Weight vector and bias by a primal-dual interior point method on the dual, None if it does not reach the optimum;
    a step costs rows times features squared.

    min 1/2 |Z'a|^2 - sum(a), sign'a = 0, 0 <= a <= C, with Z the rows times their signs."""
    z = x * sign[:, None]
    n, d = z.shape
    a, low, high, bias = np.full(n, C / 2), np.ones(n), np.ones(n), 0.0

    def solved(part):
        """(diag(scale) + ZZ')^-1 part"""
        return part / scale - weighed @ np.linalg.solve(inside, z.T @ (part / scale))

    for _ in range(200):
        room, w = C - a, z.T @ a
        dual = 1.0 - z @ w - sign * bias + low - high
        gap = a @ low + room @ high
        if gap <= 1e-9 * (1.0 + a.sum()) and np.abs(dual).max() <= TOLERANCE / 10 and abs(sign @ a) <= 1e-9 * (1.0 + a.sum()):
            return w, float(bias)
        scale = low / a + high / room
        weighed = z / scale[:, None]
        inside = np.eye(d) + z.T @ weighed
        of_sign = solved(sign)

        def step(to_low, to_high):
            moved = solved(dual + to_low / a - to_high / room)
            by = (sign @ moved + sign @ a) / (sign @ of_sign)
            da = moved - of_sign * by
            return da, by, (to_low - low * da) / a, (to_high + high * da) / room

        def longest(da, dl, dh):
            limits = [1.0]
            for value, change in ((a, da), (room, -da), (low, dl), (high, dh)):
                down = change < 0
                if down.any():
                    limits.append(float((-value[down] / change[down]).min()))
            return min(limits)

        da, _, dl, dh = step(-a * low, -room * high)
        far = longest(da, dl, dh)
        after = (a + far * da) @ (low + far * dl) + (room - far * da) @ (high + far * dh)
        aim = (after / gap) ** 3 * gap / (2 * n)
        da, db, dl, dh = step(aim - a * low - da * dl, aim - room * high + da * dh)
        far = min(1.0, 0.995 * longest(da, dl, dh))
        if far < 1e-10:
            break
        a, bias, low, high = a + far * da, bias + far * db, low + far * dl, high + far * dh
    return None


def _decompose(x: np.ndarray, sign: np.ndarray, C: float, gamma: float, name: str) -> tuple[np.ndarray, float]:
    """Signed multipliers and bias: the variables that violate the optimality conditions most are solved together,
    half of them kept for the next round, until none violates them by more than the tolerance."""
    n = len(sign)
    least, most = np.where(sign > 0, 0.0, -C), np.where(sign > 0, C, 0.0)
    beta, slack, work = np.zeros(n), sign.copy(), np.zeros(0, dtype=int)
    while True:
        up, down = np.where(beta < most, slack, -np.inf), np.where(beta > least, slack, np.inf)
        gap = up.max() - down.min()
        if gap < TOLERANCE:
            break
        if n <= WORKING_SET:
            work, aim = np.arange(n), TOLERANCE
        else:
            work, aim = _violating(up, down, work[len(work) // 2:]), max(TOLERANCE / 2, gap / 10)
        inside = kernel(x[work], x[work], name, gamma)
        now = _pairs(inside, beta[work], slack[work], least[work], most[work], aim)
        changed = now != beta[work]
        by, of = (now - beta[work])[changed], x[work[changed]]
        for at in range(0, n, BLOCK_ROWS):
            slack[at:at + BLOCK_ROWS] -= kernel(x[at:at + BLOCK_ROWS], of, name, gamma) @ by
        beta[work] = now
    free = (beta > least) & (beta < most)
    return beta, float(slack[free].mean() if free.any() else (up.max() + down.min()) / 2)


def _violating(up: np.ndarray, down: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``kept`` and the variables to raise and to lower that violate the conditions most."""
    work = kept
    side = (WORKING_SET - len(kept)) // 2
    for badness in (-up, down):
        badness = badness.copy()
        badness[work] = np.inf
        worst = np.argpartition(badness, side)[:side]
        work = np.concatenate([work, worst[np.isfinite(badness[worst])]])
    return work


def _pairs(inside: np.ndarray, beta: np.ndarray, slack: np.ndarray, least: np.ndarray, most: np.ndarray, aim: float) -> np.ndarray:
    """Sequential minimal optimisation: the pair with the largest second-order gain, until no pair violates by ``aim``."""
    beta, slack = beta.copy(), slack.copy()
    diagonal = np.diagonal(inside)
    curve = 1.0 / np.maximum(diagonal[:, None] + diagonal - 2.0 * inside, 1e-12)
    bar_up, bar_down = np.where(beta < most, 0.0, -np.inf), np.where(beta > least, 0.0, np.inf)
    differs, gain = np.empty_like(slack), np.empty_like(slack)
    while True:
        np.add(slack, bar_up, out=gain)
        i = int(gain.argmax())
        np.add(slack, bar_down, out=differs)
        np.subtract(gain[i], differs, out=differs)
        if not differs.max() >= aim:
            return beta
        np.maximum(differs, 0.0, out=differs)
        np.multiply(differs, differs, out=gain)
        gain *= curve[i]
        j = int(gain.argmax())
        room_i, room_j = most[i] - beta[i], beta[j] - least[j]
        by = min(differs[j] * curve[i, j], room_i, room_j)
        beta[i] = most[i] if by == room_i else beta[i] + by
        beta[j] = least[j] if by == room_j else beta[j] - by
        np.subtract(inside[i], inside[j], out=gain)
        gain *= by
        slack -= gain
        bar_up[i], bar_down[i] = 0.0 if beta[i] < most[i] else -np.inf, 0.0
        bar_up[j], bar_down[j] = 0.0, 0.0 if beta[j] > least[j] else np.inf


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of 1 / (1 + exp(slope * margin + offset)), by Newton's method with backtracking (Lin, Lin and Weng)."""
    positives = int(y.sum())
    negatives = len(y) - positives
    target = np.where(y, (positives + 1.0) / (positives + 2.0), 1.0 / (negatives + 2.0))
    slope, offset = 0.0, float(np.log((negatives + 1.0) / (positives + 1.0)))

    def loss(s, o):
        t = s * margins + o
        return float((np.logaddexp(0.0, t) - (1.0 - target) * t).sum())

    now = loss(slope, offset)
    for _ in range(100):
        p = _curve(slope * margins + offset)
        off, weight = target - p, p * (1.0 - p)
        g1, g2 = margins @ off, off.sum()
        if abs(g1) < 1e-5 and abs(g2) < 1e-5:
            break
        h11, h22, h21 = margins @ (margins * weight) + 1e-12, weight.sum() + 1e-12, margins @ weight
        det = h11 * h22 - h21 * h21
        d1, d2 = -(h22 * g1 - h21 * g2) / det, -(h11 * g2 - h21 * g1) / det
        slant, size = g1 * d1 + g2 * d2, 1.0
        while size >= 1e-10 and (new := loss(slope + size * d1, offset + size * d2)) >= now + 1e-4 * size * slant:
            size /= 2
        if size < 1e-10:
            break
        slope, offset, now = slope + size * d1, offset + size * d2, new
    return float(slope), float(offset)


def ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order drawn by the seed that depends on their values only, not on how they came."""
    place = np.lexsort([*x.T, y])
    place = place[np.random.RandomState(SEED).permutation(len(place))]
    return x[place], y[place]


def stratified(y: np.ndarray, folds: int) -> np.ndarray:
    """Fold of each row: runs of each class, as even as possible over folds and classes together."""
    sorted_y, fold = np.sort(y), np.empty(len(y), dtype=int)
    for c in (False, True):
        fold[y == c] = np.repeat(np.arange(folds), [int((sorted_y[i::folds] == c).sum()) for i in range(folds)])
    return fold


def f1(y: np.ndarray, said: np.ndarray) -> float:
    both = y.sum() + said.sum()
    return float(2.0 * (y & said).sum() / both) if both else 0.0


def candidates(grid: dict[str, list]) -> list[tuple]:
    """(C, gamma, kernel) in the order of the search. The linear kernel has no gamma: with each it gives the same
    classifier and score, and the first of equal scores wins, so it is fitted with the first gamma."""
    return [(c, g, k) for c, g, k in product(grid["C"], grid["gamma"], grid["kernel"]) if k != "linear" or g == grid["gamma"][0]]


def _each(spark: SparkSession, count: int, run) -> list:
    """``run`` of every number below ``count``, a task each; the last, which take longest, begin first."""
    return spark.sparkContext.parallelize(range(count)[::-1], max(count, 1)).map(run).collect()[::-1]


def search(sent: Broadcast, spark: SparkSession, grid: dict[str, list], folds: int) -> list[tuple[float, tuple]]:
    """(mean F1 over the folds, candidate) of every candidate; ``sent`` holds rows, labels and folds."""
    tried = candidates(grid)

    def run(number: int) -> float:
        x, y, fold = sent.value
        (c, gamma, name), held = tried[number // folds], fold == number % folds
        model = fit(x[~held], y[~held], c, width(x[~held], gamma), name)
        return f1(y[held], model.margin(x[held]) > 0)

    scores = _each(spark, len(tried) * folds, run)
    return [(float(np.mean(scores[i * folds:(i + 1) * folds])), of) for i, of in enumerate(tried)]


def calibrated(sent: Broadcast, spark: SparkSession, c: float, gamma: float, name: str) -> SvmModel:
    """One candidate fitted on all rows, its probability from margins of rows that their classifier has not seen."""
    place = np.random.RandomState(SEED).permutation(len(sent.value[1]))

    def run(number: int):
        x, y, _ = sent.value
        if number == FOLDS:
            return fit(x, y, c, gamma, name)
        held = np.random.RandomState(SEED).permutation(len(y)) * FOLDS // len(y) == number
        return fit(x[~held], y[~held], c, gamma, name).margin(x[held])

    *margins, model = _each(spark, FOLDS + 1, run)
    unseen = np.empty(len(place))
    for number, values in enumerate(margins):
        unseen[place * FOLDS // len(place) == number] = values
    model.slope, model.offset = platt(unseen, sent.value[1])
    return model


def train(rows: DataFrame, grid: dict[str, list] | None = None, folds: int = FOLDS) -> SvmModel:
    """The candidate with the best F1 in cross-validation on rows with ``features`` and ``label``, the first of equals."""
    spark = rows.sparkSession
    x, label = _matrix(rows.select(vector_to_array("features"), "label"))
    x, y = ordered(x, label == 1)
    sent = spark.sparkContext.broadcast((x, y, stratified(y, folds)))
    _, (c, gamma, name) = max(search(sent, spark, grid or GRID, folds), key=lambda s: s[0])
    model = calibrated(sent, spark, c, width(x, gamma), name)
    sent.destroy()
    return model
