"""Stepwise feature selection (X1-X3): all candidates and folds of a step fitted together.

A step of the greedy search compares one logistic model per candidate and
fold.  They share their rows, so they are fitted side by side: the driver
holds the coefficients of all of them, one scan returns their losses,
gradients and second derivatives (a few matrix products per block of rows for
all models, added up over the cluster), and a damped Newton step follows for each.  A step costs some six
scans however many candidates there are; the rows stay where they are.

The model is L2 logistic regression as in L2 (C = 1, intercept free), one
sigmoid for two classes and the soft-max beyond.  A candidate's score is its
mean accuracy over the folds, counted in one more scan; the first of equal
scores wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partials import added_up, matrix, partial_sums
from ..session import stored

TOLERANCE, ROUNDS = 1e-7, 100
#: Rows whose sums are taken at once, and products of two columns held for them (8 bytes each): what fits a core's cache.
ROWS, PRODUCTS = 512, 1 << 16


@dataclass
class Rows:
    """The rows of a selection: ``x`` (array of p doubles), ``y`` (class), ``fold``; stored once."""

    table: DataFrame
    p: int
    k: int
    folds: int
    finite: bool = False  # no cell is missing, nan or infinite


def _decoded(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x with a column of ones first, class, fold)."""
    x = matrix(batch.column(0), p)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def selection_rows(df: DataFrame, label: str, fold_col: str, features: str = "features") -> Rows:
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), F.col(fold_col).cast("int").alias("fold"))
    # dealt evenly once: the folds come in a few partitions of unlike size, and every scan waits for the largest
    table = stored(rows.repartition(3 * df.sparkSession.sparkContext.defaultParallelism), "selection")
    number = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # nan is above infinity
    stats = table.agg(F.max(F.size("x")).alias("p"), (F.max("y") + 1).alias("k"), (F.max("fold") + 1).alias("folds"),
                      F.min(number).alias("finite")).first()
    return Rows(table, stats["p"] or 0, max(stats["k"] or 0, 2), stats["folds"] or 0, bool(stats["finite"]))


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(rows, outputs) class probabilities; w: (outputs, columns), one output for two classes."""
    z = x @ w.T
    if len(w) == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _groups(columns: list[np.ndarray], finite: bool) -> list[tuple[np.ndarray, list[int]]]:
    """(columns, places of the models) of the models that one set of matrix products serves.

    All models share the products of their columns if that costs at most
    eight times what each needs by itself, else models of the same columns
    do.  Cells that are no finite numbers must not meet the zeros that stand
    for a model's missing columns.
    """
    together = np.unique(np.concatenate(columns))
    if finite and len(columns) * len(together) ** 2 <= 8 * sum(len(c) ** 2 for c in columns):
        return [(together, list(range(len(columns))))]
    same: dict[tuple[int, ...], list[int]] = {}
    for i, c in enumerate(columns):
        same.setdefault(tuple(c), []).append(i)
    return [(np.array(c), places) for c, places in same.items()]


def _sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, left_out: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(losses, gradients, second derivatives) of the models w (models, outputs, columns), without the penalty.

    x is (columns, rows).  The products of every two columns are written
    once; a matrix product with the weights of all models gives the second
    derivatives: of outputs a <= b, columns i <= j, as (models, pairs of
    outputs, pairs of columns).
    """
    models, outputs, columns = w.shape
    inside = (fold != left_out[:, None]).astype(float)[:, None, :]
    z = (w.reshape(models * outputs, columns) @ x).reshape(models, outputs, -1)
    if outputs == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        hit = y[None, :] == 1
        of_label = np.abs(p - ~hit)[:, 0]
    else:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        hit = y[None, :] == np.arange(outputs)[:, None]
        of_label = np.where(hit, p, 0.0).sum(axis=1) + ~hit.any(axis=0)
    loss = -(np.log(np.maximum(of_label, 1e-300)) * inside[:, 0]).sum(axis=1)
    gradient = (((p - hit) * inside).reshape(models * outputs, -1) @ x.T).reshape(models, outputs, columns)
    products = np.concatenate([x[i] * x[i:] for i in range(columns)])
    weights = np.stack([p[:, a] * ((a == b) - p[:, b]) * inside[:, 0] for a in range(outputs) for b in range(a, outputs)], axis=1)
    second = (weights.reshape(-1, x.shape[1]) @ products.T).reshape(models, weights.shape[1], -1)
    return loss, gradient, second


def _of_model(held: np.ndarray, cols: np.ndarray, gradient: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of a model with columns ``cols`` from those over the columns ``held``."""
    outputs, n = gradient.shape
    at = np.searchsorted(held, cols) if len(held) != len(cols) else np.arange(n)
    whole = np.empty((outputs, n, outputs, n))
    pairs = [(a, b) for a in range(outputs) for b in range(a, outputs)]
    for (a, b), values in zip(pairs, second):
        block = np.zeros((n, n))
        block[np.triu_indices(n)] = values
        block = block + np.triu(block, 1).T
        whole[a, :, b, :] = whole[b, :, a, :] = block
    size = outputs * len(cols)
    return gradient[:, at].ravel(), whole[:, at][:, :, :, at].reshape(size, size)


def fit_many(rows: Rows, models: list[tuple[tuple[int, ...], int]], c: float = 1.0, start: list | None = None) -> list[np.ndarray]:
    """Coefficients (outputs x (1 + features), intercept first) of one model per (features, left-out fold).

    Fold -1 leaves out nothing.  ``start``: coefficients to begin with.
    """
    outputs, p = 1 if rows.k == 2 else rows.k, rows.p
    columns = [np.array([0, *(f + 1 for f in features)]) for features, _ in models]
    w = [np.zeros((outputs, len(cols))) if start is None else start[i].copy() for i, cols in enumerate(columns)]
    best: list = [None] * len(models)  # (w, loss, gradient, second) accepted so far
    step = np.ones(len(models))
    open_ = list(range(len(models)))
    for _ in range(ROUNDS):
        if not open_:
            break
        sent = []
        for held, places in _groups([columns[i] for i in open_], rows.finite):
            padded = np.zeros((len(places), outputs, len(held)))
            for at, place in enumerate(places):
                i = open_[place]
                padded[at][:, np.searchsorted(held, columns[i]) if len(held) != len(columns[i]) else slice(None)] = w[i]
            sent.append((held, places, np.array([models[open_[place]][1] for place in places]), padded))

        def of_block(batch: pa.RecordBatch) -> tuple:
            x, y, fold = _decoded(batch, p)
            x = np.ascontiguousarray(x.T)
            return tuple(part for held, _, left_out, of_models in sent for part in _sums(x[held], y, fold, left_out, of_models))

        widest = max(len(held) for held, *_ in sent)
        found = added_up(partial_sums(rows.table, of_block, max(64, min(ROWS, PRODUCTS // (widest * (widest + 1) // 2)))))
        if found is None:
            break
        sums = {open_[place]: (found[3 * g][at], *_of_model(held, columns[open_[place]], found[3 * g + 1][at], found[3 * g + 2][at]))
                for g, (held, places, *_) in enumerate(sent) for at, place in enumerate(places)}
        still = []
        for i in open_:
            loss, gradient, second = sums[i]
            penalty = np.tile(np.r_[0.0, np.full(len(columns[i]) - 1, 1.0 / c)], outputs)
            flat = w[i].ravel()
            loss = loss + 0.5 * (penalty * flat * flat).sum()
            if best[i] is not None and not loss <= best[i][1] + 1e-9 * abs(best[i][1]):
                step[i] /= 2  # too far: back towards the last accepted coefficients
            else:
                gradient = gradient + penalty * flat
                best[i] = (flat.copy(), loss, gradient, second + np.diag(penalty + 1e-9))
                step[i] = 1.0
            flat, loss, gradient, second = best[i]
            move = np.linalg.solve(second, gradient)
            if abs(move @ gradient) <= TOLERANCE * max(abs(loss), 1.0) * 1e-3 or step[i] < 1e-6:
                w[i] = flat.reshape(w[i].shape)
                continue
            w[i] = (flat - step[i] * move).reshape(w[i].shape)
            still.append(i)
        open_ = still
    return w


def cv_scores(rows: Rows, sets: list[tuple[int, ...]], start: list | None = None) -> tuple[list[float], list]:
    """(mean accuracy over the folds per feature set, coefficients per set and fold)."""
    models = [(s, f) for s in sets for f in range(rows.folds)]
    w = fit_many(rows, models, start=start)
    sent = [(np.array([0, *(j + 1 for j in s)]), f, wi) for (s, f), wi in zip(models, w)]
    p, folds = rows.p, rows.folds

    def of_block(batch: pa.RecordBatch) -> tuple:
        x, y, fold = _decoded(batch, p)
        right = []
        for cols, f, wi in sent:
            inside = fold == f
            share = _probabilities(x[inside][:, cols], wi)
            said = (share[:, 0] > 0.5).astype(int) if len(wi) == 1 else share.argmax(axis=1)
            right.append((said == y[inside]).sum())
        return np.array(right, float), np.bincount(fold, minlength=folds).astype(float)

    right, sizes = added_up(partial_sums(rows.table, of_block))
    shares = right.reshape(len(sets), folds) / np.maximum(sizes, 1)
    return [float(s[sizes > 0].mean()) for s in shares], w


def _coefficients(w: list, folds: int, place: int) -> list:
    return w[place * folds:(place + 1) * folds]


def forward(rows: Rows, n: int, start: tuple[int, ...] = ()) -> list[int]:
    """Feature numbers in the order in which the greedy search takes them."""
    chosen, held = list(start), None
    while len(chosen) < min(n, rows.p):
        rest = [j for j in range(rows.p) if j not in chosen]
        warm = None if held is None else [np.concatenate([w, np.zeros((len(w), 1))], axis=1) for _ in rest for w in held]
        scores, w = cv_scores(rows, [(*chosen, j) for j in rest], warm)
        best = max(range(len(rest)), key=lambda i: (scores[i], -i))
        chosen.append(rest[best])
        held = _coefficients(w, rows.folds, best)
    return chosen


def backward(rows: Rows, start: list[int], n: int) -> list[int]:
    """What is left of ``start`` after the greedy search has removed all but n features."""
    chosen, held = list(start), None
    while len(chosen) > n:
        warm = None
        if held is not None:
            warm = [np.delete(w, at + 1, axis=1) for at in range(len(chosen)) for w in held]
        scores, w = cv_scores(rows, [tuple(chosen[:at] + chosen[at + 1:]) for at in range(len(chosen))], warm)
        best = max(range(len(chosen)), key=lambda i: (scores[i], -i))
        chosen.pop(best)
        held = _coefficients(w, rows.folds, best)
    return chosen


def forward_select(df: DataFrame, label: str, names: list[str], n: int | None = None, fold_col: str = "fold") -> list[str]:
    """Greedy forward selection by cross-validated accuracy to n features (by default min(15, p / 2))."""
    n = min(15, len(names) // 2) if n is None else n
    return [names[j] for j in forward(selection_rows(df, label, fold_col), n)]


def backward_select(df: DataFrame, label: str, names: list[str], start: list[str] | None = None, n: int | None = None,
                    fold_col: str = "fold") -> list[str]:
    """Greedy backward elimination from ``start`` (by default all) to n features (by default max(5, half))."""
    start = list(names if start is None else start)
    n = max(5, len(start) // 2) if n is None else n
    return [names[j] for j in backward(selection_rows(df, label, fold_col), [names.index(s) for s in start], n)]


def forward_backward(df: DataFrame, label: str, names: list[str], fold_col: str = "fold") -> list[str]:
    """Forward to min(20, p / 2), then backward from those to max(5, half of them)."""
    rows = selection_rows(df, label, fold_col)
    taken = forward(rows, min(20, len(names) // 2))
    return [names[j] for j in backward(rows, taken, max(5, len(taken) // 2))]
