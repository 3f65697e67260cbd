"""Reversible scalers as expressions over collected per-column statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.text import array, columns, number, project
from strataframe.schema import resolve_targets

EPS = 1e-52
STAT_NAMES = ("mean", "std", "q1", "q2", "q3", "min", "max", "lambda", "std_y")


@dataclass(frozen=True)
class Affine:
    """(x - center) / max(spread, eps) forward, x * spread + center back."""

    center: float
    spread: float

    def forward(self, x: str, eps: float = EPS) -> str:
        return f"(({x} - {number(self.center)}) / {number(max(self.spread, eps))})"

    def reverse(self, x: str) -> str:
        return f"({x} * {number(self.spread)} + {number(self.center)})"


@dataclass(frozen=True)
class Exponential:
    """1 - exp(-rate * x) forward, -ln(1 - x) / rate back."""

    rate: float

    def forward(self, x: str, eps: float = EPS) -> str:
        return f"(1D - exp({number(-self.rate)} * {x}))"

    def reverse(self, x: str) -> str:
        # Spark's ln is null outside its domain; keep the IEEE results there.
        return (f"(CASE WHEN {x} < 1 THEN -ln(1D - {x}) WHEN {x} = 1 THEN {number(math.inf)} "
                f"WHEN {x} > 1 THEN {number(math.nan)} END / {number(self.rate)})")


def _num(value) -> float:
    return math.nan if value is None else float(value)


def make_scaler(method: str, stats: Mapping[str, float]) -> Affine | Exponential:
    """The scaler of one column. `stats` holds the names of STAT_NAMES."""
    s = {name: _num(stats[name]) for name in STAT_NAMES}
    spans = s["max"] - s["min"]
    table = {
        "standard": (s["mean"], s["std"]),
        "robust": (s["q2"], s["q3"] - s["q1"]),
        "minmax": (s["min"], spans),
        "minmaxmean": (s["mean"], spans),
        "minmaxzero": (0.0, spans),
        "std": (0.0, s["std"]),
        "standard_y": (s["mean"], s["std_y"]),
    }
    if method == "exp":
        return Exponential(s["lambda"])
    if method not in table:
        raise NotImplementedError(f"unknown scaling method {method!r}")
    return Affine(*table[method])


def collect_stats(stats: DataFrame) -> dict[str, dict[str, float]]:
    """Long statistics to a dict. The size is the number of columns, never of rows."""
    rows = stats.select("column", *STAT_NAMES).collect()
    return {row["column"]: {name: row[name] for name in STAT_NAMES} for row in rows}


def _as_dict(stats) -> Mapping[str, Mapping[str, float]]:
    return collect_stats(stats) if isinstance(stats, DataFrame) else stats


def scale_expressions(exprs: Mapping[str, str], methods: Mapping[str, Iterable[str] | None], stats,
                      reverse: bool = False, eps: float = EPS) -> dict[str, str]:
    """`exprs` (name to expression text) with the listed columns or families scaled."""
    stats = _as_dict(stats)
    scaled = dict(exprs)
    for method, names in methods.items():
        for name in resolve_targets(list(exprs), names or ()):
            scaler = make_scaler(method, stats[name])
            x = scaled[name]
            scaled[name] = scaler.reverse(x) if reverse else scaler.forward(x, eps)
    return scaled


def scale(df: DataFrame, methods: Mapping[str, Iterable[str] | None], stats,
          reverse: bool = False, eps: float = EPS) -> DataFrame:
    """Scale the listed columns or families in one projection; all other columns pass through."""
    return project(df, scale_expressions(columns(df.columns), methods, stats, reverse, eps))


def scale_vector(profile: str, method: str, level_stats: Iterable[Mapping[str, float]],
                 reverse: bool = False, eps: float = EPS) -> Column:
    """Scale the packed profile `profile` (expression text), one set of statistics per level."""
    scalers = [make_scaler(method, stats) for stats in level_stats]
    if method == "exp":
        rates = array(number(s.rate) for s in scalers)
        if reverse:
            body = Exponential(1.0).reverse("x") + " / r"
        else:
            body = "1D - exp(-r * x)"
        return F.expr(f"zip_with({profile}, {rates}, (x, r) -> {body})")
    pairs = array(
        f"struct({number(s.center)} AS c, {number(s.spread if reverse else max(s.spread, eps))} AS s)"
        for s in scalers)
    body = "x * p.s + p.c" if reverse else "(x - p.c) / p.s"
    return F.expr(f"zip_with({profile}, {pairs}, (x, p) -> {body})")
