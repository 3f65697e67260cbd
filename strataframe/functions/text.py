"""Expression text for wide projections.

A projection of a thousand columns is sent to Spark as a thousand strings. Building it from Column
objects costs several round trips to the JVM for each operator of each column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: float | None) -> str:
    """A double literal."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    value = float(value)
    if math.isnan(value):
        return "double('NaN')"
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"({value!r}D)"


def string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def aliased(exprs: Mapping[str, str]) -> list[str]:
    return [f"{expr} AS {quoted(name)}" for name, expr in exprs.items()]


def project(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*aliased(exprs))


def columns(names: Sequence[str]) -> dict[str, str]:
    return {name: quoted(name) for name in names}
