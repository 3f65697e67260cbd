"""Profile (array) functions: packing, layouts, differences and summaries along levels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.schema import ProfileSchema, family_columns
from strataframe.functions.scalar import cyclic_features
from strataframe.functions.text import array, columns, project, quoted


def pack_families(df: DataFrame, families: Iterable[str]) -> DataFrame:
    """`f_0 .. f_n` become one array column `f`, in level order, in a single projection."""
    members = {f: family_columns(df.columns, f) for f in families}
    absent = [f for f, cols in members.items() if not cols]
    if absent:
        raise ValueError(f"no columns for families {absent}")
    packed = {c for cols in members.values() for c in cols}
    exprs = columns([c for c in df.columns if c not in packed])
    exprs.update({f: array(map(quoted, cols)) for f, cols in members.items()})
    return project(df, exprs)


def unpack_families(df: DataFrame, families: Iterable[str], levels: int) -> DataFrame:
    """One array column `f` becomes `f_0 .. f_<levels-1>`; short arrays give null."""
    families = list(families)
    exprs = columns([c for c in df.columns if c not in families])
    exprs.update({f"{f}_{i}": f"get({quoted(f)}, {i})" for f in families for i in range(levels)})
    return project(df, exprs)


def _vector(names: Sequence[str], families: Iterable[str], element: str) -> Column:
    """Scalars and profiles of `names` as one flat array, in the order given."""
    families = set(families)
    parts: list[Column] = []
    run: list[Column] = []
    for name in names:
        if name in families:
            if run:
                parts.append(F.array(*run))
                run = []
            parts.append(F.col(name).cast(f"array<{element}>"))
        else:
            run.append(F.col(name).cast(element))
    if run:
        parts.append(F.array(*run))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def aux_vector(schema: ProfileSchema) -> Column:
    """Seven position and time encodings from the columns lat, lon, hour and day."""
    features = cyclic_features(F.col("lat"), F.col("lon"), F.col("hour"), F.col("day"))
    return F.array(*[f.cast("float") for f in features.values()])


def label_vector(schema: ProfileSchema, element: str = "float") -> Column:
    return _vector(schema.out_scalars + schema.out_families, schema.out_families, element)


def assemble_named(df: DataFrame, schema: ProfileSchema) -> DataFrame:
    """Columns stay apart; `labels` is added."""
    return df.withColumn("labels", label_vector(schema))


def assemble_flat(df: DataFrame, schema: ProfileSchema, labels: bool = True, aux: bool = True,
                  element: str = "float") -> DataFrame:
    """`input` holds all scalars and then all profiles, `labels` likewise."""
    names = schema.in_scalars + schema.in_families
    columns = [F.col(schema.id_col), _vector(names, schema.in_families, element).alias("input")]
    return df.select(*columns, *_extras(schema, labels, aux, element))


def assemble_sequential(df: DataFrame, schema: ProfileSchema, labels: bool = True, aux: bool = True,
                        element: str = "float") -> DataFrame:
    """`x_scalar[scalars]` and `x_vector[families][levels]` side by side."""
    scalars = F.array(*[F.col(c).cast(element) for c in schema.in_scalars])
    vectors = F.array(*[F.col(c).cast(f"array<{element}>") for c in schema.in_families])
    return df.select(F.col(schema.id_col), scalars.alias("x_scalar"), vectors.alias("x_vector"),
                     *_extras(schema, labels, aux, element))


def _extras(schema: ProfileSchema, labels: bool, aux: bool, element: str) -> list[Column]:
    extras = [aux_vector(schema).alias("aux")] if aux else []
    if labels:
        extras.append(label_vector(schema, element).alias("labels"))
    return extras


def level_rows(df: DataFrame, id_col: str, scalars: Sequence[str], families: Sequence[str]) -> DataFrame:
    """One row per sample and level: the scalars repeated, the profiles' values of that level."""
    zipped = F.arrays_zip(*[F.col(f) for f in families])
    exploded = df.select(id_col, *scalars, F.posexplode(zipped).alias("level", "_profile"))
    return exploded.select(id_col, *scalars, "level",
                           *[F.col("_profile")[f].alias(f) for f in families])


def profile_diffs(profile: Column) -> Column:
    """First differences along the levels."""
    head = F.slice(profile, F.lit(1), F.greatest(F.size(profile) - 1, F.lit(0)))
    tail = F.slice(profile, F.lit(2), F.greatest(F.size(profile) - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda below, above: below - above)


def flipped_diffs(profile: Column) -> Column:
    """First differences of the profile read from its last level to its first."""
    return F.transform(F.reverse(profile_diffs(profile)), lambda d: -d)


def level_mean(profile: Column) -> Column:
    """Mean along the levels, summed in double; null for an empty profile."""
    total = F.aggregate(profile, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(profile) > 0, total / F.size(profile))


def profile_stats(profile: Column) -> dict[str, Column]:
    return {"min": F.array_min(profile), "mean": level_mean(profile), "max": F.array_max(profile)}


def profile_features(scalars: Sequence[Column], profiles: Sequence[Column]) -> Column:
    """Scalars, differences, flipped differences, minima, means and maxima in one array."""
    stats = [profile_stats(p) for p in profiles]
    return F.concat(
        F.array(*[s.cast("double") for s in scalars]),
        *[profile_diffs(p).cast("array<double>") for p in profiles],
        *[flipped_diffs(p).cast("array<double>") for p in profiles],
        *[F.array(*[s[name].cast("double") for s in stats]) for name in ("min", "mean", "max")])


def output_layout(levels: DataFrame, id_col: str, scalars: Sequence[str], profiles: Sequence[str]) -> DataFrame:
    """Outputs per level to one vector per sample: scalar outputs averaged, profiles in level order.

    A group is one sample, so it never holds more rows than there are levels.
    """
    grouped = levels.groupBy(id_col).agg(
        *[F.avg(c).alias(c) for c in scalars],
        F.array_sort(F.collect_list(F.struct("level", *profiles))).alias("_levels"))
    return grouped.select(
        id_col,
        F.concat(F.array(*[F.col(c) for c in scalars]),
                 *[F.col("_levels")[p] for p in profiles]).alias("outputs"))


def stack_outputs(profile_outputs: Sequence[Column], scalar_outputs: Sequence[Column]) -> Column:
    """The same layout when each output is already an array over the levels: no shuffle."""
    return F.concat(F.array(*[level_mean(p) for p in scalar_outputs]), *profile_outputs)
