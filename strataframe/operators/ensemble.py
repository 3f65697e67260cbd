"""Mean of the best runs, chosen for each output column on its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.text import aliased, project, quoted
from strataframe.operators.frame import union_all
from strataframe.operators.metrics import top_k


def select_runs(scores: DataFrame, columns: Sequence[str], k: int, fallback: str) -> dict[str, list[str]]:
    """Runs to average for each column; a column with no positive score takes the fallback run.

    Collected: at most `k` names per column.
    """
    chosen: dict[str, list[str]] = {c: [] for c in columns}
    for row in top_k(scores, k).select("column", "run", "rank").orderBy("column", "rank").collect():
        if row["column"] in chosen:
            chosen[row["column"]].append(row["run"])
    return {c: runs or [fallback] for c, runs in chosen.items()}


def ensemble_top_k(scores: DataFrame, preds: Mapping[str, DataFrame], columns: Sequence[str],
                   k: int = 3, fallback: str | None = None, id_col: str = "sample_id") -> DataFrame:
    """Per column, the mean prediction of its best `k` runs, as one wide row per sample.

    Each run is read once and only for the columns it was chosen for. Rows stay wide: one shuffle
    on the id, no row per column and no pivot.
    """
    chosen = select_runs(scores, columns, k, fallback or list(preds)[-1])
    unknown = {run for runs in chosen.values() for run in runs} - set(preds)
    if unknown:
        raise ValueError(f"no predictions for runs {sorted(unknown)}")
    parts = []
    for run, df in preds.items():
        used = {c for c in columns if run in chosen[c]}
        if used:
            read = {c: f"CAST({quoted(c) if c in used else 'NULL'} AS DOUBLE)" for c in columns}
            parts.append(project(df, {id_col: quoted(id_col), **read}))
    means = [F.expr(text) for text in aliased({c: f"avg({quoted(c)})" for c in columns})]
    return union_all(parts).groupBy(id_col).agg(*means)
