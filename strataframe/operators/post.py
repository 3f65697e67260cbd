"""From scaled predictions to the final table, and the evaluation table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from strataframe.functions.scaling import scale_expressions
from strataframe.functions.text import columns as plain_columns
from strataframe.functions.text import number, project, quoted
from strataframe.operators.frame import suffix_all
from strataframe.operators.joins import attach_by_key
from strataframe.schema import CLOSED_FORM, CLOSED_FORM_DIVISOR, NON_NEGATIVE

# Column name to expression text. Each step rewrites some of them; one projection applies them all.
Exprs = dict[str, str]


def _columns(df: DataFrame) -> Exprs:
    return plain_columns(df.columns)


def collect_constants(df: DataFrame, key: str = "column", value: str = "weight") -> dict[str, float]:
    """A one-value-per-column table as a dict. Its size is the number of columns."""
    return {row[key]: row[value] for row in df.select(key, value).collect()}


def _fill(exprs: Exprs, broken: Iterable[str], means: Mapping[str, float]) -> Exprs:
    return {**exprs, **{c: number(means[c]) for c in broken}}


def _clip(exprs: Exprs, columns: Iterable[str], lower: float, on_absent: str = "error") -> Exprs:
    columns = list(columns)
    absent = [c for c in columns if c not in exprs]
    if absent and on_absent == "error":
        raise ValueError(f"no predictions for clipped columns {absent}")
    return {**exprs, **{
        c: f"CASE WHEN {exprs[c]} IS NOT NULL THEN greatest({exprs[c]}, {number(lower)}) END"
        for c in columns if c in exprs}}


def _closed_form(exprs: Exprs, mapping: Mapping[str, str], divisor: float, below: float | None,
                 weights: Mapping[str, float] | None = None) -> Exprs:
    def value(target: str, source: str) -> str:
        computed = f"(-{quoted(source)} / {number(divisor)})"
        if weights:
            computed = f"({computed} * {number(weights[target])})"
        if below is None:
            return computed
        return f"CASE WHEN {quoted(source)} < {number(below)} THEN {computed} ELSE {exprs[target]} END"

    return {**exprs, **{t: value(t, s) for t, s in mapping.items()}}


def _weigh(exprs: Exprs, weights: Mapping[str, float]) -> Exprs:
    absent = [c for c in weights if c not in exprs]
    if absent:
        raise ValueError(f"no predictions for weighted columns {absent}")
    return {**exprs, **{c: f"({exprs[c]} * {number(w)})" for c, w in weights.items()}}


def fill_broken(df: DataFrame, broken: Iterable[str], means: Mapping[str, float]) -> DataFrame:
    """Whole columns replaced by the training mean of the label."""
    return project(df, _fill(_columns(df), broken, means))


def clip_columns(df: DataFrame, columns: Iterable[str] = NON_NEGATIVE, lower: float = 0.0,
                 on_absent: str = "skip") -> DataFrame:
    """No value of `columns` below `lower`; nulls stay. Absent columns are passed over, or stop the job (`error`)."""
    if on_absent not in ("skip", "error"):
        raise ValueError(f"on_absent is 'skip' or 'error', not {on_absent!r}")
    return project(df, _clip(_columns(df), columns, lower, on_absent))


def apply_weights(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Each label times its weight; every weighted column must exist."""
    return project(df, _weigh(_columns(df), weights))


def override_closed_form(df: DataFrame, inputs: DataFrame, mapping: Mapping[str, str] = CLOSED_FORM,
                         divisor: float = CLOSED_FORM_DIVISOR, below: float | None = None,
                         weights: Mapping[str, float] | None = None,
                         id_col: str = "sample_id") -> DataFrame:
    """Outputs that follow from a raw input: `-input / divisor`, joined by id.

    With `below`, only where the input lies under it. With `weights`, the computed value is
    weighted, for tables whose other columns already are.
    """
    joined = attach_by_key(df, inputs.select(id_col, *sorted(set(mapping.values()))), id_col)
    return project(joined, _closed_form(_columns(df), mapping, divisor, below, weights))


def post_process(df: DataFrame, methods: Mapping[str, Iterable[str] | None], stats,
                 broken: Iterable[str], means: Mapping[str, float], weights: Mapping[str, float],
                 inputs: DataFrame | None = None, clipped: Iterable[str] = NON_NEGATIVE,
                 mapping: Mapping[str, str] = CLOSED_FORM, divisor: float = CLOSED_FORM_DIVISOR,
                 id_col: str = "sample_id") -> DataFrame:
    """Reverse scaling, fill, clip, closed form, weights and column order, in that sequence.

    Columns to clip, like weighted ones, must exist. One projection, after one join if `inputs` is given. The order of `weights` is the order of
    the result's columns.
    """
    exprs = scale_expressions(_columns(df), methods, stats, reverse=True)
    exprs = _fill(exprs, broken, means)
    exprs = _clip(exprs, clipped, 0.0)
    if inputs is not None:
        df = attach_by_key(df, inputs.select(id_col, *sorted(set(mapping.values()))), id_col)
        exprs = _closed_form(exprs, mapping, divisor, None)
    exprs = _weigh(exprs, weights)
    return project(df, {c: exprs[c] for c in (id_col, *weights)})


def evaluation_table(labels: DataFrame, preds: DataFrame, columns: Sequence[str],
                     id_col: str = "sample_id") -> DataFrame:
    """Labels suffixed `_label` beside predictions of the same names, all in scaled units."""
    suffixed = suffix_all(labels.select(id_col, *columns), "_label")
    keyed = preds.select(id_col, *columns).withColumnRenamed(id_col, f"{id_col}_label")
    return attach_by_key(suffixed, keyed, f"{id_col}_label")
