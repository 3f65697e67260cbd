"""Lookup joins: exact, tiered on rounded keys, and attachment by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.operators.frame import filter_time_slots, union_all

# Keys with more rows than this are split over several tasks.
MIN_HOT_ROWS = 1_000_000
# A hot key also holds more than one part in MAX_HOT of all rows, so there are never more than
# MAX_HOT of them, and none is left out.
MAX_HOT = 10_000

HotKeys = list[tuple[object, int]]


def hot_keys(df: DataFrame, on: str, min_hot_rows: int = MIN_HOT_ROWS) -> HotKeys:
    """(key, number of parts) of the largest keys. Reads the key column, combined map-side.

    A table with no more rows than a hot key must have holds none, which its row count tells.
    """
    if df.count() <= min_hot_rows:
        return []
    found = _largest(df.groupBy(on).agg(F.count("*").alias("_n")), min_hot_rows)
    return [(row[on], row["_parts"]) for row in found.collect()]


def _largest(counts: DataFrame, min_hot_rows: int) -> DataFrame:
    """All rows of `counts` above both limits, with their number of parts."""
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    least = F.greatest(F.lit(min_hot_rows).cast("double"), total / F.lit(MAX_HOT))
    parts = F.ceil(F.col("_n") / least).alias("_parts")
    return counts.filter(F.col("_n") > least).select("*", parts)


def _hot_keys_and_asked(df: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], asked: str,
                        min_hot_rows: int) -> tuple[HotKeys, HotKeys]:
    """Hot keys of the rows, and hot `asked` values of their distinct keys, from one count of the keys."""
    if df.count() <= min_hot_rows:
        return [], []
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    of_keys = ask(counts.filter(F.col(key).isNotNull())).groupBy(asked).agg(F.count("*").alias("_n"))
    both = (_largest(counts, min_hot_rows).select(F.lit(True).alias("_of_rows"), key, "_parts")
            .unionByName(_largest(of_keys, min_hot_rows).select(F.lit(False).alias("_of_rows"), asked, "_parts"), allowMissingColumns=True))
    found = both.collect()
    return ([(row[key], row["_parts"]) for row in found if row["_of_rows"]],
            [(row[asked], row["_parts"]) for row in found if not row["_of_rows"]])


def left_join_unique(df: DataFrame, right: DataFrame, on: str, spread_by: Sequence[str],
                     hot: HotKeys) -> DataFrame:
    """Left join with a side that has one row per key, safe against hot and null keys.

    Without hot keys this is a plain left join. Otherwise rows of a hot key are spread by a hash of
    `spread_by`, with the one matching row repeated for each part, and rows without a key are
    spread over all tasks.
    """
    if not hot:
        return df.join(right, on, "left")
    spark = df.sparkSession
    key_type = df.schema[on].dataType.simpleString()
    # At most MAX_HOT rows.
    parts = F.broadcast(spark.createDataFrame(
        [(key, n) for key, n in hot if key is not None], f"`{on}` {key_type}, _parts long"))
    spread = F.xxhash64(*[F.col(c) for c in spread_by])
    salt = (F.when(F.col(on).isNull(), spread)
            .when(F.col("_parts").isNotNull(), F.pmod(spread, F.col("_parts")))
            .otherwise(F.lit(0).cast("long")))
    left = df.join(parts, on, "left").withColumn("_salt", salt).drop("_parts")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    copies = F.explode(F.sequence(zero, F.coalesce(F.col("_parts"), one) - 1))
    repeated = right.join(parts, on, "left").withColumn("_salt", copies).drop("_parts")
    return left.join(repeated, [on, "_salt"], "left").drop("_salt")


def unique_lookup(lookup: DataFrame, key: Column, key_name: str, values: Sequence[str],
                  on_duplicate: str, order: Sequence[str]) -> DataFrame:
    """One row per key, with the number of rows that share it under `_rows`.

    `error` only needs the values of keys that are unique, so plain minima do and Spark can
    hash-aggregate. `first` keeps the whole first row by `order`, ties by the values themselves.
    """
    keyed = lookup.withColumn(key_name, key).filter(F.col(key_name).isNotNull()).groupBy(key_name)
    rows = F.count("*").alias("_rows")
    if on_duplicate == "error":
        return keyed.agg(rows, *[F.min(c).alias(c) for c in values])
    if on_duplicate != "first":
        raise ValueError(f"on_duplicate is 'error' or 'first', not {on_duplicate!r}")
    ordered = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in values])
    return keyed.agg(rows, F.min(ordered).alias("_first")).select(
        key_name, "_rows", *[F.col("_first")[f"_v_{c}"].alias(c) for c in values])


def _guard(df: DataFrame, bad: Column, message: str, key: str) -> DataFrame:
    """Fail on rows where `bad` holds.

    A filter cannot be pruned away, whatever columns are read later. Its message names the probe
    side's key, so the optimiser takes it for a condition on both sides of the join.
    """
    text = F.concat(F.lit(message), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    return df.filter(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def _guarded(joined: DataFrame, marker: str, key: str, on_miss: str, on_duplicate: str,
             side: str = "lookup") -> DataFrame:
    """Fail on rows that found several lookup rows, or none, unless that is wanted."""
    if on_duplicate == "error":
        joined = _guard(joined, F.col("_rows") > 1, f"{side} has more than one row for key ", key)
    if on_miss == "error":
        joined = _guard(joined, F.col(marker).isNull(), f"no {side} row for key ", key)
    return joined


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, id_col: str = "sample_id",
                on_miss: str = "error", on_duplicate: str = "error",
                order: Sequence[str] = ("timestamp",),
                min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Left equi-join on a float key. A missing or ambiguous match stops the job by default."""
    values = [c for c in lookup.columns if c != key]
    unique = unique_lookup(lookup, F.col(key), key, values, on_duplicate, order)
    joined = left_join_unique(df, unique, key, [id_col], hot_keys(df, key, min_hot_rows))
    joined = joined.select(*df.columns, *values, "_rows")
    return _guarded(joined, "_rows", key, on_miss, on_duplicate).drop("_rows")


Tier = tuple[int | None, Callable[[DataFrame], DataFrame] | None]


def tiered_lookup_join(df: DataFrame, lookup: DataFrame, key: str, tiers: Sequence[Tier],
                       id_col: str = "sample_id", on_miss: str = "error",
                       on_duplicate: str = "error", order: Sequence[str] = ("timestamp",),
                       min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Lookup in tiers: each row takes the first tier whose (rounded) key has a match.

    A tier is (digits or None for the exact key, filter of the lookup or None). Adds `match_tier`,
    counted from 1, null without a match; the key column keeps its own value.

    Tiers are resolved for the distinct keys, not for the rows, and all tiers together: a key meets
    the lookup once per tier, as (tier, rounded key), and keeps its first match. The wide rows then
    move once, in the join with the resolved keys. Hot keys, exact and rounded, come from one count of
    the key column, which tables below `min_hot_rows` rows do without.
    """
    values = [c for c in lookup.columns if c != key]

    kind = df.schema[key].dataType
    if lookup.schema[key].dataType != kind:
        kind = T.DoubleType()

    def tier_key(number: int) -> Column:
        """As text: Spark shuffles floating keys again after grouping by them, to make zeros alike."""
        digits = tiers[number - 1][0]
        rounded = (F.col(key) if digits is None else F.round(F.col(key), digits)).cast(kind)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            rounded = (rounded + F.lit(0.0)).cast(kind)
        return F.concat(F.lit(f"{number}:"), rounded.cast("string"))

    numbers = range(1, len(tiers) + 1)

    def ask(keys: DataFrame) -> DataFrame:
        return keys.select(key, F.inline(F.array(*[
            F.struct(F.lit(n).alias("_tier"), tier_key(n).alias("_tier_key")) for n in numbers])))

    hot, hot_asked = _hot_keys_and_asked(df, key, ask, "_tier_key", min_hot_rows)
    asked = ask(df.filter(F.col(key).isNotNull()).select(key).distinct())
    sources = [(restrict(lookup) if restrict else lookup).withColumn("_tier_key", tier_key(n)).drop(key)
               for n, (_, restrict) in zip(numbers, tiers)]
    unique = unique_lookup(union_all(sources), F.col("_tier_key"), "_tier_key", values, on_duplicate, order)
    met = left_join_unique(asked, unique, "_tier_key", [key], hot_asked)
    resolved = (met.filter(F.col("_rows").isNotNull()).groupBy(key)
                .agg(F.min("_tier").alias("match_tier"), F.min_by(F.struct("_rows", *values), "_tier").alias("_hit"))
                .select(key, "match_tier", "_hit.*"))
    joined = left_join_unique(df, resolved, key, [id_col], hot)
    joined = joined.select(*df.columns, *values, "match_tier", "_rows")
    return _guarded(joined, "match_tier", key, on_miss, on_duplicate).drop("_rows")


def prefiltered_build(lookup: DataFrame, ts_col: str, hours: Sequence[int], minute: int = 0) -> DataFrame:
    """The part of the lookup that lies in the given time slots."""
    return filter_time_slots(lookup, ts_col, hours, minute)


def attach_by_key(left: DataFrame, right: DataFrame, key: str = "sample_id", on_miss: str = "error",
                  on_duplicate: str = "error") -> DataFrame:
    """Put the columns of `right` beside `left` by their common key.

    A row of `left` without a partner stops the job, or is kept with nulls (`keep`) or left out
    (`drop`). A key that several rows of `right` share stops the job when met, or gives a row for
    each (`keep`). Counting them needs no shuffle or sort beyond the join's own.
    """
    if on_miss not in ("error", "keep", "drop") or on_duplicate not in ("error", "keep"):
        raise ValueError(f"on_miss {on_miss!r} or on_duplicate {on_duplicate!r} is unknown")
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")
    if on_duplicate == "error":
        counted = right.filter(F.col(key).isNotNull()).withColumn("_rows", F.count("*").over(Window.partitionBy(key)))
    else:
        counted = right.withColumn("_rows", F.lit(1).cast("long"))
    joined = left.join(counted, key, "inner" if on_miss == "drop" else "left")
    return _guarded(joined, "_rows", key, on_miss, on_duplicate, "right side").drop("_rows")
