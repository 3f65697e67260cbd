"""Per-column regression metrics, masks, and error analysis."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.text import array, quoted, string
from strataframe.schema import natural_key

# Fixed value: an R2 below this counts as broken.
BROKEN_BELOW = 1e-6


def column_mask(weights: DataFrame, unused: Iterable[str] = ()) -> DataFrame:
    """(column, keep): kept unless the weight is zero or the column is listed as unused."""
    keep = (F.col("weight") != 0) & ~F.col("column").isin(list(unused))
    return weights.select("column", keep.alias("keep"))


def long_pairs(df: DataFrame, labels: Sequence[str], id_col: str, suffix: str = "_label") -> DataFrame:
    """Wide predictions with suffixed labels -> (id, column, y, pred)."""
    pairs = array(
        f"struct({string(c)} AS column, CAST({quoted(c + suffix)} AS DOUBLE) AS y, "
        f"CAST({quoted(c)} AS DOUBLE) AS pred)" for c in labels)
    return df.selectExpr(quoted(id_col), f"inline({pairs})")


def r2_by_column(long: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """R2 of raw values. A constant target scores 1 if every prediction is exact and 0 if not.

    Pairs with a null count in neither sum; `incomplete_pairs` tells how many there are. Without
    any complete pair R2 is null.
    """
    error = F.col("y") - F.col("pred")
    target = F.when(F.col("pred").isNotNull(), F.col("y"))
    sums = long.groupBy(*by).agg(
        F.sum(error * error).alias("_res"),
        (F.var_pop(target) * F.count(target)).alias("_tot"))
    r2 = (F.when(F.col("_tot") != 0, F.lit(1.0) - F.col("_res") / F.nullif(F.col("_tot"), F.lit(0.0)))
          .when(F.col("_res") == 0, F.lit(1.0)).when(F.col("_res").isNotNull(), F.lit(0.0)))
    return sums.select(*by, r2.alias("r2"))


def incomplete_pairs(long: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """How many pairs lack the label or the prediction."""
    return long.groupBy(*by).agg(F.count_if(F.col("y").isNull() | F.col("pred").isNull()).alias("incomplete"))


def _masked(r2: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Masked columns score 1, and only then are broken columns set to 0."""
    score = F.col("r2")
    if mask is not None:
        r2 = r2.join(mask, "column", "left")
        score = F.when(~F.coalesce("keep", F.lit(True)), F.lit(1.0)).otherwise(score)
    broken = score < BROKEN_BELOW
    return r2.withColumns({"broken": broken, "score": F.when(broken, 0.0).otherwise(score)})


def r2_summary(r2: DataFrame, mask: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean R2 over all columns, masked ones included, and how many are broken."""
    return _masked(r2, mask).groupBy(*by).agg(
        F.avg("score").alias("val_r2"), F.count_if("broken").alias("r2_broken"))


def broken_columns(r2: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    return _masked(r2, mask).filter("broken").select(*[c for c in r2.columns if c != "r2"])


def best_epoch(r2: DataFrame, epoch: str, mask: DataFrame | None = None, mode: str = "max",
               monitor: str = "val_r2") -> DataFrame:
    """Scores of the epoch with the best `monitor` (val_r2 or r2_broken); the later epoch wins a tie."""
    summary = r2_summary(r2, mask, by=(epoch,))
    score = F.col(monitor).desc() if mode == "max" else F.col(monitor).asc()
    best = summary.orderBy(score, F.col(epoch).desc()).limit(1)
    return r2.join(F.broadcast(best.select(epoch)), epoch, "left_semi")


def huber(error: Column, delta: float = 1.0) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))


def huber_loss(long: DataFrame, delta: float = 1.0, mask: DataFrame | None = None) -> DataFrame:
    """Mean Huber loss over all rows and kept columns."""
    if mask is not None:
        # One row per column, so the mask is bounded by the schema.
        kept = mask.filter("keep").select("column")
        long = long.join(F.broadcast(kept), "column", "left_semi")
    return long.agg(F.avg(huber(F.col("pred") - F.col("y"), delta)).alias("loss"))


def error_share(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Squared error of each row and its share of the total, by way of a one-value subquery."""
    error = F.col(pred) - F.col(label)
    rows = df.withColumn("diff", error * error)
    total = rows.agg(F.sum("diff")).scalar()
    return rows.withColumn("diff_ratio", F.try_divide(F.col("diff"), total))


def worst_samples(shares: DataFrame, n: int, id_col: str) -> DataFrame:
    """The `n` rows with the largest share of the error, as a report."""
    return shares.orderBy(F.col("diff_ratio").desc(), id_col).limit(n)


def series_head(df: DataFrame, columns: Sequence[str], order: str, n: int = 1000) -> DataFrame:
    """First `n` rows of a few columns, for a line plot."""
    return df.select(order, *columns).orderBy(order).limit(n)


def compare_runs(first: DataFrame, second: DataFrame, floor: float = -1.0) -> DataFrame:
    """Two runs' R2 per column side by side, floored, in natural column order."""
    def floored(scores: DataFrame, name: str) -> DataFrame:
        bounded = F.when(F.col("r2").isNotNull(), F.greatest("r2", F.lit(floor)))
        return scores.select("column", bounded.alias(name))

    both = floored(first, "r2_first").join(floored(second, "r2_second"), "column", "full")
    return both.orderBy(*natural_key(F.col("column")))


def top_k(scores: DataFrame, k: int, by: str = "column", order: str = "r2",
          tie: str = "run") -> DataFrame:
    """Best `k` positive scores per column. Spark cuts each group to `k` before the shuffle."""
    positive = scores.filter((F.col(order) > 0) & ~F.isnan(order))
    window = Window.partitionBy(by).orderBy(F.col(order).desc(), tie)
    return positive.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
