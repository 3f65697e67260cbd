"""Batch scoring with a user's function, and a ridge baseline fitted in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

from strataframe.functions.text import aliased, array, project, quoted

PredictFn = Callable[[np.ndarray], np.ndarray]


def _vector(exprs: Sequence[str], name: str) -> str:
    return f"CAST({array(exprs)} AS ARRAY<DOUBLE>) AS {name}"


def score_many(df: DataFrame, models: Mapping[str, PredictFn], input_cols: Sequence[str],
               label_cols: Sequence[str], id_col: str = "sample_id",
               carry: Mapping[str, str] | None = None, max_model_bytes: int = 1 << 28) -> DataFrame:
    """(model, id, labels...) for every model, in one pass over the rows.

    `input_cols` are column names or expressions. `carry` adds columns of the input, name to
    expression, so that they need no join afterwards. Rows reach Python as Arrow batches: the id,
    one array of inputs and what is carried; no array is boxed row by row. Models travel as one
    broadcast variable; more than `max_model_bytes` of them are refused.
    """
    packed = cloudpickle.dumps(dict(models))
    if len(packed) > max_model_bytes:
        raise ValueError(f"models take {len(packed)} bytes, more than max_model_bytes = {max_model_bytes}")
    shared = df.sparkSession.sparkContext.broadcast(packed)
    width = len(label_cols)
    carry = dict(carry or {})
    rows = df.selectExpr(f"{quoted(id_col)} AS id", _vector(input_cols, "x"), *aliased(carry))
    kept = list(carry)

    def run(batches: Iterable):
        import pickle

        import numpy
        import pyarrow

        loaded = pickle.loads(shared.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for name, predict in loaded.items():
                y = numpy.asarray(predict(x), dtype="float64")
                if y.shape != (n, width):
                    raise ValueError(f"model {name} gave {y.shape}, not {(n, width)}")
                starts = pyarrow.array(numpy.arange(n + 1, dtype="int32") * width)
                lists = pyarrow.ListArray.from_arrays(starts, pyarrow.array(y.ravel()))
                yield pyarrow.RecordBatch.from_arrays(
                    [pyarrow.array([name] * n, pyarrow.string()), batch.column("id"), lists, *[batch.column(c) for c in kept]],
                    names=["model", "id", "y", *kept])

    out = T.StructType([
        T.StructField("model", T.StringType()), rows.schema["id"],
        T.StructField("y", T.ArrayType(T.DoubleType())), *[rows.schema[c] for c in kept]])
    labels = {c: f"y[{i}]" for i, c in enumerate(label_cols)}
    passed = {c: quoted(c) for c in kept}
    return project(rows.mapInArrow(run, out), {"model": "model", id_col: "id", **labels, **passed})


def score(df: DataFrame, predict: PredictFn, input_cols: Sequence[str], label_cols: Sequence[str],
          id_col: str = "sample_id", carry: Mapping[str, str] | None = None) -> DataFrame:
    """(id, labels...) of one model."""
    return score_many(df, {"model": predict}, input_cols, label_cols, id_col, carry).drop("model")


@dataclass(frozen=True)
class LinearModel:
    """y = x @ weights + bias, one column of weights per label."""

    weights: np.ndarray
    bias: np.ndarray

    def predictor(self) -> PredictFn:
        """A plain function of arrays, so that executors need nothing but numpy."""
        weights, bias = self.weights, self.bias
        return lambda x: x @ weights + bias


def _lists(matrix: np.ndarray):
    """Rows of a matrix as an Arrow list array."""
    import pyarrow

    n, width = matrix.shape
    return pyarrow.ListArray.from_arrays(
        pyarrow.array(np.arange(n + 1, dtype="int32") * width), pyarrow.array(np.ascontiguousarray(matrix).ravel()))


def _sum_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sum of `v` per row number, as a stream: a task keeps one array per number."""
    def add(batches: Iterable):
        import numpy
        import pyarrow

        totals: dict[int, numpy.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("i").to_numpy()
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
            for i, v in zip(numbers.tolist(), rows):
                if i in totals:
                    totals[i] += v
                else:
                    totals[i] = v.copy()
        if totals:
            yield pyarrow.RecordBatch.from_arrays(
                [pyarrow.array(list(totals), pyarrow.int64()), pyarrow.array([0] * len(totals), pyarrow.int64()),
                 _lists(numpy.stack(list(totals.values())))], names=["i", "part", "v"])

    return df.repartition(*keys).mapInArrow(add, df.schema)


def gram_blocks(df: DataFrame, input_cols: Sequence[str], label_cols: Sequence[str],
                fold: str = "0", folds: int = 1, fan_in: int = 64) -> np.ndarray:
    """Sums of products per fold, in one pass: an array of folds, inputs + 2 and 1 + inputs + labels.

    Row 0 belongs to the constant, the next to the inputs, and the last holds the sums of squared
    labels. `fold` is an expression from 0 to `folds` - 1. Every task adds up its rows with numpy and
    sends one small matrix a fold on; two rounds of streamed sums follow, the first by groups of
    tasks. What is shuffled is that matrix for each input split: with a thousand columns of doubles
    and splits of 128 MB, about 3 % of the input and fold. The driver gets `folds` matrices, whose
    size is that of the schema. A null or NaN in any row stops the fit.
    """
    n_in, n_out = len(input_cols), len(label_cols)
    height, width = n_in + 2, 1 + n_in + n_out

    def blocks(batches: Iterable):
        import numpy
        import pyarrow
        from pyspark import TaskContext

        totals: dict[int, numpy.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, n_in)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, n_out)
            where = batch.column("fold").to_numpy()
            for f in numpy.unique(where).tolist():
                if not 0 <= f < folds:
                    raise ValueError(f"fold {f} is not in 0 to {folds - 1}")
                here = slice(None) if folds == 1 else where == f
                left = numpy.hstack([numpy.ones((len(x[here]), 1)), x[here]])
                part = numpy.zeros((height, width))
                part[:-1] = left.T @ numpy.hstack([left, y[here]])
                part[-1, 1 + n_in:] = (y[here] * y[here]).sum(axis=0)
                totals[f] = part + totals[f] if f in totals else part
        part_id = TaskContext.get().partitionId() % fan_in
        for f, total in totals.items():
            yield pyarrow.RecordBatch.from_arrays(
                [pyarrow.array(range(f * height, (f + 1) * height), pyarrow.int64()),
                 pyarrow.array([part_id] * height, pyarrow.int64()), _lists(total)], names=["i", "part", "v"])

    rows = df.selectExpr(_vector(input_cols, "x"), _vector(label_cols, "y"), f"CAST({fold} AS BIGINT) AS fold")
    partial = rows.mapInArrow(blocks, "i long, part long, v array<double>")
    found = np.zeros((folds, height, width))
    for row in _sum_rows(_sum_rows(partial, ["i", "part"]), ["i"]).collect():
        found[row["i"] // height, row["i"] % height] = row["v"]
    if not found[:, 0, 0].any():
        raise ValueError("no rows to fit")
    if not np.isfinite(found).all():
        raise ValueError("an input or a label is null, NaN or infinite")
    return found


def fit_linear(df: DataFrame, input_cols: Sequence[str], label_cols: Sequence[str],
               ridge: float = 0.0, fan_in: int = 64) -> LinearModel:
    """Multi-target ridge regression with an unpenalised intercept, on columns or expressions.

    The sums come from `gram_blocks`; the driver solves a system whose size is the number of inputs.
    """
    n_in = len(input_cols)
    gram = gram_blocks(df, input_cols, label_cols, fan_in=fan_in)[0, :-1]
    penalty = ridge * np.eye(n_in + 1)
    penalty[0, 0] = 0.0
    solution = np.linalg.lstsq(gram[:, :n_in + 1] + penalty, gram[:, n_in + 1:], rcond=None)[0]
    return LinearModel(weights=solution[1:], bias=solution[0])


@dataclass(frozen=True)
class _Centred:
    """Sums of products around the means of the rows they were taken from."""

    n: float
    x_mean: np.ndarray
    y_mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> _Centred:
        n, n_in = block[0, 0], len(block) - 2
        x_mean, y_mean = block[0, 1:1 + n_in] / n, block[0, 1 + n_in:] / n
        return cls(n, x_mean, y_mean, block[1:-1, 1:1 + n_in] - n * np.outer(x_mean, x_mean),
                   block[1:-1, 1 + n_in:] - n * np.outer(x_mean, y_mean),
                   np.maximum(block[-1, 1 + n_in:] - n * y_mean * y_mean, 0.0))

    def models(self, ridges: Sequence[float]) -> list[LinearModel]:
        """A model per penalty, all from one eigendecomposition; directions without spread weigh nothing."""
        values, vectors = np.linalg.eigh(self.xx)
        values = np.maximum(values, 0.0)
        turned = vectors.T @ self.xy
        flat = max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps
        models = []
        for ridge in ridges:
            total = values + ridge
            inverse = np.divide(1.0, total, out=np.zeros_like(total), where=(values > flat) | (total > flat))
            weights = vectors @ (turned * inverse[:, None])
            models.append(LinearModel(weights, self.y_mean - self.x_mean @ weights))
        return models

    def squared_error(self, model: LinearModel) -> np.ndarray:
        """Sum of squared errors of each label on these rows, from the sums alone."""
        w = model.weights
        shift = self.y_mean - self.x_mean @ w - model.bias
        spread = self.yy - 2 * (w * self.xy).sum(axis=0) + (w * (self.xx @ w)).sum(axis=0)
        return np.maximum(spread, 0.0) + self.n * shift * shift


@dataclass(frozen=True)
class RidgeChoice:
    """What cross-validation found: the penalty, the model of all rows, and the table of errors."""

    ridge: float
    model: LinearModel
    scores: list[tuple[float, str, float, float]]

    SCHEMA = "ridge double, column string, mse double, r2 double"


def fit_linear_cv(df: DataFrame, input_cols: Sequence[str], label_cols: Sequence[str],
                  ridges: Sequence[float], id_col: str = "sample_id", folds: int = 5,
                  seed: int = 42, fan_in: int = 64) -> RidgeChoice:
    """Choose the penalty of `fit_linear` by cross-validation, in one pass over the rows.

    A row's fold is a hash of its id, so rows of one id stay together and a second run gives the same
    folds. Sums of products are kept by fold; a fold's training sums are those of the others. One
    eigendecomposition a fold gives the models of all penalties, and their errors on the fold left
    out follow from its sums, so no row is read twice and none is scored. R2 of a label compares the
    errors of all folds with the label's spread over all rows, and is 0 where there is none (1 without
    errors). The penalty with the best mean over the labels wins, the smaller one on a tie. Empty
    folds are passed over; at least two must hold rows. Sums of squares lose digits where
    means are much larger than spreads, so scaled inputs are expected.
    """
    if not ridges or min(ridges) < 0:
        raise ValueError("at least one penalty, none below zero")
    digest = f"md5(concat('{int(seed)}:', CAST({quoted(id_col)} AS STRING)))"
    fold = f"CAST(conv(substring({digest}, 1, 8), 16, 10) AS BIGINT) % {int(folds)}"
    blocks = gram_blocks(df, input_cols, label_cols, f"coalesce({fold}, 0)", folds, fan_in)
    used = [b for b in blocks if b[0, 0] > 0]
    if len(used) < 2:
        raise ValueError("cross-validation needs rows in two folds at least")
    total = _Centred.of(np.sum(used, axis=0))
    errors = np.zeros((len(ridges), len(label_cols)))
    for i, held in enumerate(used):
        rest = _Centred.of(np.sum(used[:i] + used[i + 1:], axis=0))
        here = _Centred.of(held)
        errors += [here.squared_error(model) for model in rest.models(ridges)]
    spread = np.where(total.yy > 0, total.yy, 1.0)
    r2 = np.where(total.yy > 0, 1.0 - errors / spread, np.where(errors == 0, 1.0, 0.0))
    best = min(range(len(ridges)), key=lambda k: (-r2[k].mean(), ridges[k]))
    scores = [(float(ridge), column, float(errors[k, j] / total.n), float(r2[k, j]))
              for k, ridge in enumerate(ridges) for j, column in enumerate(label_cols)]
    return RidgeChoice(float(ridges[best]), total.models([ridges[best]])[0], scores)
