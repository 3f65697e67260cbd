"""Fit, score, evaluate and combine runs, from tables to tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.scaling import collect_stats
from strataframe.functions.text import array, project, quoted
from strataframe.operators.ensemble import ensemble_top_k
from strataframe.operators.frame import sort_by_id
from strataframe.operators.metrics import (
    broken_columns, column_mask, huber_loss, long_pairs, r2_by_column, r2_summary)
from strataframe.operators.post import collect_constants, override_closed_form, post_process
from strataframe.operators.scoring import (
    LinearModel, PredictFn, RidgeChoice, fit_linear, fit_linear_cv, score, score_many)
from strataframe.schema import CLOSED_FORM, NON_NEGATIVE, ProfileSchema
from strataframe.sources.files import is_complete, write_csv
from strataframe.sources.runs import load_predictions, load_scores
from strataframe.sources.shards import methods_from_table, save_manifest

# Fixed value: the one output that is set from its input again after averaging, without a weight.
LAST_CLOSED_FORM = {"ptend_q0002_27": CLOSED_FORM["ptend_q0002_27"]}


def _flat_inputs(schema: ProfileSchema) -> list[str]:
    return _flat(schema.in_scalars, schema.in_families, schema.levels)


def _flat_labels(schema: ProfileSchema) -> list[str]:
    return _flat(schema.out_scalars, schema.out_families, schema.levels)


def _flat(scalars: Sequence[str], families: Sequence[str], levels: int) -> list[str]:
    return [quoted(s) for s in scalars] + [f"{quoted(f)}[{i}]" for f in families for i in range(levels)]


def fit_phase(packed: DataFrame, schema: ProfileSchema, ridge: float = 1.0) -> LinearModel:
    """Ridge baseline on a packed table."""
    return fit_linear(packed, _flat_inputs(schema), _flat_labels(schema), ridge)


def choose_phase(packed: DataFrame, schema: ProfileSchema, ridges: Sequence[float], out: str,
                 folds: int = 5, seed: int = 42) -> RidgeChoice:
    """Ridge baseline with the best of several penalties; their errors by label go to `ridge_scores` below `out`."""
    found = fit_linear_cv(packed, _flat_inputs(schema), _flat_labels(schema), ridges, schema.id_col, folds, seed)
    names = dict(zip(_flat_labels(schema), schema.label_columns))
    rows = [(ridge, names[label], mse, r2, ridge == found.ridge) for ridge, label, mse, r2 in found.scores]
    save_manifest(packed.sparkSession.createDataFrame(rows, f"{RidgeChoice.SCHEMA}, chosen boolean"), f"{out}/ridge_scores")
    return found


def predict_packed(packed: DataFrame, predict: PredictFn, schema: ProfileSchema) -> DataFrame:
    """(sample_id, every label) for a packed table."""
    return score(packed, predict, _flat_inputs(schema), schema.label_columns, schema.id_col)


def unpacked_labels(packed: DataFrame, schema: ProfileSchema) -> DataFrame:
    labels = zip(schema.label_columns, _flat_labels(schema))
    return project(packed, {schema.id_col: quoted(schema.id_col), **{n: f"CAST({e} AS DOUBLE)" for n, e in labels}})


def validate_phase(packed: DataFrame, predict: PredictFn, schema: ProfileSchema, out: str,
                   weights: DataFrame | None = None, unused: Iterable[str] = (),
                   monitor: str = "val_r2", mode: str = "max") -> DataFrame:
    """Evaluation table and score sidecars of one run; returns the one-row summary.

    Labels of weight zero and `unused` ones are masked: they score 1, are never broken and add nothing
    to the loss, so they decide nothing about which state of the run is kept.

    The sidecars that inference reads (`each_r2_score`, `broken_columns`) change only if `monitor`
    (val_r2, r2_broken or val_loss) is at least as good as the best so far, kept in `best_summary`.
    """
    if monitor not in ("val_r2", "r2_broken", "val_loss") or mode not in ("max", "min"):
        raise ValueError(f"monitor {monitor!r} or mode {mode!r} is unknown")
    spark = packed.sparkSession
    id_label = f"{schema.id_col}_label"
    labels = [f"CAST({e} AS DOUBLE)" for e in _flat_labels(schema)]
    # Labels ride along as one array: the evaluation table takes no join.
    scored = score(packed, predict, _flat_inputs(schema), schema.label_columns, schema.id_col,
                   carry={"_labels": array(labels)})
    table = project(scored, {
        id_label: quoted(schema.id_col),
        **{f"{c}_label": f"_labels[{i}]" for i, c in enumerate(schema.label_columns)},
        **{c: quoted(c) for c in schema.label_columns}})
    table.write.mode("overwrite").parquet(f"{out}/evaluation")
    table = spark.read.parquet(f"{out}/evaluation")
    unused = list(unused)
    if weights is None and unused:
        weights = spark.createDataFrame([(c, 1.0) for c in schema.label_columns], "column string, weight double")
    mask = column_mask(weights, unused) if weights is not None else None
    long = long_pairs(table, schema.label_columns, id_label)
    save_manifest(r2_by_column(long), f"{out}/last_r2_score")
    r2 = spark.read.parquet(f"{out}/last_r2_score")
    loss = huber_loss(long, mask=mask).select(F.col("loss").alias("val_loss"))
    save_manifest(r2_summary(r2, mask).withColumn("val_loss", loss.scalar()), f"{out}/last_summary")
    summary = spark.read.parquet(f"{out}/last_summary")
    if _at_least_as_good(summary, f"{out}/best_summary", monitor, mode):
        save_manifest(r2, f"{out}/each_r2_score")
        save_manifest(broken_columns(r2, mask), f"{out}/broken_columns")
        save_manifest(summary, f"{out}/best_summary")
    return summary


def _at_least_as_good(summary: DataFrame, best: str, monitor: str, mode: str) -> bool:
    """Both summaries have one row. A value that is null or NaN beats none."""
    if not is_complete(summary.sparkSession, best):
        return True
    now, before = [df.first()[monitor] for df in (summary, summary.sparkSession.read.parquet(best))]
    if now is None or now != now:
        return False
    return before is None or before != before or (now >= before if mode == "max" else now <= before)


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    """A ridge model as a small table, a row per input and one for the bias (position -1)."""
    rows = [(-1, model.bias.tolist()), *enumerate(model.weights.tolist())]
    save_manifest(spark.createDataFrame(rows, "position int, weights array<double>"), path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    rows = [row["weights"] for row in spark.read.parquet(path).orderBy("position").collect()]
    return LinearModel(weights=np.array(rows[1:]), bias=np.array(rows[0]))


def _clipped(schema: ProfileSchema) -> list[str]:
    """The labels of the schema that cannot be negative."""
    return [c for c in NON_NEGATIVE if c in set(schema.label_columns)]


def submit_run(spark: SparkSession, out: str, dataset: str, run: str, models: Mapping[str, PredictFn],
               schema: ProfileSchema, weights: Mapping[str, float],
               mapping: Mapping[str, str] = CLOSED_FORM) -> None:
    """A submission `submission_<model>` in `run` for each model, from one pass over the test rows.

    Scaler methods, statistics and broken columns come from the sidecars of the earlier phases, so
    they are the ones the tables were made with.
    """
    methods = methods_from_table(spark.read.parquet(f"{out}/{dataset}/scaler_methods"))
    stats = collect_stats(spark.read.parquet(f"{out}/stats"))
    means = {c: stats[c]["mean"] for c in schema.label_columns}
    broken = [row["column"] for row in spark.read.parquet(f"{run}/broken_columns").collect()]
    rows = spark.read.parquet(f"{out}/{dataset}/processed_test")
    scored = score_many(rows, models, _flat_inputs(schema), schema.label_columns, schema.id_col)
    scored.write.mode("overwrite").partitionBy("model").parquet(f"{run}/predictions")
    raw_test = spark.read.parquet(f"{out}/raw_test")
    for name in models:
        preds = spark.read.parquet(f"{run}/predictions").filter(F.col("model") == name).drop("model")
        final = post_process(preds, methods, stats, broken, means, weights, raw_test, _clipped(schema), mapping, id_col=schema.id_col)
        write_csv(sort_by_id(final, schema.id_col), f"{run}/submission_{name}", [schema.id_col, *weights])


def submit_phase(packed_test: DataFrame, raw_test: DataFrame, predict: PredictFn,
                 schema: ProfileSchema, methods: Mapping[str, Iterable[str] | None], stats,
                 label_means: Mapping[str, float], broken: Iterable[str],
                 weights: Mapping[str, float], out: str,
                 mapping: Mapping[str, str] = CLOSED_FORM) -> None:
    """Predictions of one run, post-processed, sorted by id, as the submission CSV."""
    preds = predict_packed(packed_test, predict, schema)
    final = post_process(preds, methods, stats, broken, label_means, weights, raw_test,
                         _clipped(schema), mapping, id_col=schema.id_col)
    write_csv(sort_by_id(final, schema.id_col), out, [schema.id_col, *weights])


def ensemble_phase(spark: SparkSession, runs: Mapping[str, str], schema: ProfileSchema,
                   weights: DataFrame, raw_test: DataFrame, out: str, k: int = 3,
                   mapping: Mapping[str, str] = LAST_CLOSED_FORM) -> None:
    """Best `k` runs per column, then the closed form for the columns that need no model.

    `runs` maps a run name to its folder, which holds `each_r2_score` and one `submission*`.
    """
    columns = list(collect_constants(weights))
    table_schema = schema.raw_struct()
    fields = [table_schema[c] for c in (schema.id_col, *columns)]
    preds = load_predictions(spark, runs, type(table_schema)(fields))
    scores = load_scores(spark, {run: f"{path}/each_r2_score" for run, path in runs.items()})
    mean = ensemble_top_k(scores, preds, columns, k, id_col=schema.id_col)
    final = override_closed_form(mean, raw_test, mapping, id_col=schema.id_col)
    write_csv(sort_by_id(final, schema.id_col), out, [schema.id_col, *columns])
