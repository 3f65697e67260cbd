"""Preparation phases: split, statistics, generate, export."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text
from strataframe.functions.scalar import calendar, sample_number, year_index
from strataframe.functions.scaling import collect_stats, scale_expressions
from strataframe.operators.frame import cast_floats, row_batches, sort_by_id
from strataframe.operators.joins import (
    MIN_HOT_ROWS, Tier, lookup_join, prefiltered_build, tiered_lookup_join)
from strataframe.operators.splits import holdout_split
from strataframe.operators.states import add_states, merge_states, read_states
from strataframe.operators.stats import CHUNK, column_stats, is_bad, quality_check, stats_matrix
from strataframe.schema import (
    FALLBACK_DIGITS, FALLBACK_HOURS, LOOKUP_KEY, SAMPLES_PER_YEAR, TEST_YEAR, ProfileSchema,
    family_columns)
from strataframe.sources.files import csv_to_parquet, ingest_csv, is_complete, remove, scan_parquet, write_parquet
from strataframe.sources.shards import SHARDS, export_shards, methods_table, save_manifest

#: The columns of a training row's batch, which name its folder in the processed table.
BATCH = ("batch_id", "start", "end")
MANIFEST = "part string, batch_id long, rows long, scaling string"


def fallback_tiers(ts_col: str = "timestamp") -> list[Tier]:
    """Exact key first, then the rounded keys among the lookup rows of the fallback time slots."""
    def slots(lookup: DataFrame) -> DataFrame:
        return prefiltered_build(lookup, ts_col, FALLBACK_HOURS)

    return [(None, None), *[(digits, slots) for digits in FALLBACK_DIGITS]]


def feature_table(df: DataFrame, lookup: DataFrame, is_test: bool = False, key: str = LOOKUP_KEY,
                  id_col: str = "sample_id", tiers: Sequence[Tier] | None = None,
                  samples_per_year: int = SAMPLES_PER_YEAR, test_year: int = TEST_YEAR,
                  on_miss: str = "error", on_duplicate: str = "error",
                  min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add location, lat, lon from the lookup and year, month, hour, day from id and timestamp."""
    options = dict(id_col=id_col, on_miss=on_miss, on_duplicate=on_duplicate,
                   min_hot_rows=min_hot_rows)
    if is_test:
        joined = tiered_lookup_join(df, lookup, key, tiers or fallback_tiers(), **options)
        year = F.lit(test_year).cast("bigint")
    else:
        joined = lookup_join(df, lookup, key, **options)
        year = year_index(F.col(id_col), samples_per_year)
    return joined.select(
        *df.columns, "location", "lat", "lon", year.alias("year"),
        *[expr.alias(name) for name, expr in calendar(F.col("timestamp")).items()])


def pack_scaled(raw: DataFrame, schema: ProfileSchema, methods: Mapping[str, Iterable[str] | None],
                stats, labels: bool = True, carry: Mapping[str, str] | None = None) -> DataFrame:
    """Scale, cast doubles to float and pack families, as one projection.

    `carry` adds columns, name to expression, that are neither scaled nor cast.
    """
    types = dict(raw.dtypes)
    plain = text.columns(list(types))
    # A scaled column is a double, whatever it was before.
    flat = {c: f"CAST({expr} AS FLOAT)" if types[c] == "double" or expr != plain[c] else expr
            for c, expr in scale_expressions(plain, methods, stats).items()}
    families = set(schema.families)
    names = [c for c in schema.packed_columns(labels) if c not in schema.aux]
    packed = {name: text.array(flat[c] for c in family_columns(flat, name)) if name in families else flat[name]
              for name in names}
    return text.project(raw, {**packed, **(carry or {})})


def build_dataset(raw: DataFrame, lookup: DataFrame, stats, schema: ProfileSchema,
                  methods: Mapping[str, Iterable[str] | None] | None = None, is_test: bool = False,
                  key: str = LOOKUP_KEY, carry: Sequence[str] = (), **feature_options) -> DataFrame:
    """Raw wide samples to the packed, scaled table. Every column is `standard` by default.

    Scaling and packing need no other row, so they run before the join: what the join moves is a
    few float arrays per sample instead of a thousand doubles. The raw key goes along beside them.
    """
    methods = methods or {"standard": [*schema.in_scalars, *schema.in_families,
                                       *schema.out_scalars, *schema.out_families]}
    carried = {"_key": text.quoted(key), **text.columns(carry)}
    packed = pack_scaled(raw, schema, methods, stats, labels=not is_test, carry=carried)
    features = feature_table(packed, lookup.withColumnRenamed(key, "_key"), is_test, key="_key",
                             id_col=schema.id_col, **feature_options)
    ordered = features.select(*schema.packed_columns(labels=not is_test), *carry)
    return cast_floats(ordered)


def split_phase(spark: SparkSession, train_csv, test_csv, out: str, schema: ProfileSchema,
                batch_size: int = 100_000, n_rows: int | None = None) -> None:
    """CSV to Parquet: the training rows with their batch, the test rows beside them.

    The batch is a column, not a folder: rows come in id order, so a filter on it skips row groups.
    With `n_rows`, the number of training rows, the CSV is read once; without, its ids are read
    twice.
    """
    train = ingest_csv(spark, train_csv, schema.raw_struct())
    train = row_batches(train.withColumn("_n", sample_number(F.col(schema.id_col))), "_n", batch_size, n_rows)
    write_parquet(train.drop("_n"), f"{out}/raw_train", dictionary=False)
    csv_to_parquet(spark, test_csv, f"{out}/raw_test", schema.raw_struct(labels=False))


def statistics_phase(spark: SparkSession, out: str, schema: ProfileSchema, num_val: int = 0,
                     quantile: str = "approx", chunk: int = CHUNK, order: str = "numeric") -> DataFrame:
    """Statistics of inputs and labels in long form, and the nine-row matrix beside them.

    With `num_val`, the last batches by `order` are held back, so that validation rows do not leak
    in; export takes the same two. `quantile="states"` keeps a state per batch below `stats_states`: a
    further call reads only batches that it has not seen, and another holdout reads none.
    """
    raw = scan_parquet(spark, f"{out}/raw_train")
    columns = schema.input_columns + schema.label_columns
    if quantile == "states":
        add_states(raw, f"{out}/stats_states", columns, chunk=chunk)
        states = read_states(spark, f"{out}/stats_states")
        if num_val:
            spans = raw.select(*BATCH).distinct()
            train = holdout_split(spans, num_val, order).filter(F.col("split") == "train").select("batch_id")
            states = states.join(train, "batch_id", "left_semi")
        stats = merge_states(states)
    else:
        if num_val:
            raw = holdout_split(raw, num_val, order).filter(F.col("split") == "train")
        stats = column_stats(raw, columns, quantile, chunk)
    write_parquet(stats, f"{out}/stats", if_exists="overwrite")
    stats = scan_parquet(spark, f"{out}/stats")
    write_parquet(stats_matrix(stats, columns).repartition(1), f"{out}/stats_matrix", if_exists="overwrite")
    return stats


def generate_phase(spark: SparkSession, out: str, lookup: DataFrame, schema: ProfileSchema,
                   methods: Mapping[str, Iterable[str] | None], dataset: str, overwrite: bool = False,
                   rows_per_commit: int = 1_000_000, most_commits: int = 16) -> None:
    """Processed train and test tables, checked, with the scaler methods beside them.

    Finished output is left alone, sidecar included. Else the sidecar goes before the first write and
    comes back after the last, so it always tells how the tables beside it were scaled.

    The training batches are written in a few commits, each a job that replaces the folders of its
    batches, and each noted in a manifest under a hash of the methods and statistics. A run that was
    stopped goes on with the batches that are missing; a run with another scaling begins anew. Null,
    NaN and infinite values, also inside profiles, fail, and so do lost rows: both are counted while
    writing, so the output is not read again unless something is wrong.
    """
    base = f"{out}/{dataset}"
    manifest, sidecar = f"{base}/manifest", f"{base}/scaler_methods"
    if not overwrite and is_complete(spark, sidecar):
        return
    remove(spark, sidecar)
    stats = collect_stats(scan_parquet(spark, f"{out}/stats"))
    scaling = scaling_hash(methods, stats, schema)
    done = None if overwrite else committed(spark, manifest, scaling)
    if done is None:
        # Before any table changes, so that no later run takes its batches for finished.
        save_manifest(spark.createDataFrame([], MANIFEST), manifest)
        done = []
    raw = scan_parquet(spark, f"{out}/raw_train")
    # One row a batch.
    rows = {r["batch_id"]: r["count"] for r in raw.groupBy("batch_id").count().collect()}
    finished = {r["batch_id"] for r in done if r["part"] == "train"}
    missing = sorted(set(rows) - finished)
    size = max(ceil(len(rows) / most_commits), ceil(rows_per_commit / max([1, *rows.values()])))
    for first in range(0, len(missing), size):
        batches = missing[first:first + size]
        train = build_dataset(raw.filter(between(F.col("batch_id"), batches)), lookup, stats, schema, methods, carry=BATCH)
        fresh = first == 0 and not finished
        write_checked(clustered(train, "batch_id"), f"{base}/processed_train", sum(rows[b] for b in batches), BATCH, "static" if fresh else "dynamic")
        note(spark, manifest, [("train", b, rows[b], scaling) for b in batches])
    if not any(r["part"] == "test" for r in done):
        raw_test = scan_parquet(spark, f"{out}/raw_test")
        test = sort_by_id(build_dataset(raw_test, lookup, stats, schema, methods, is_test=True), schema.id_col)
        n = raw_test.count()
        write_checked(test, f"{base}/processed_test", n)
        note(spark, manifest, [("test", None, n, scaling)])
    save_manifest(methods_table(spark, methods), sidecar)


def scaling_hash(methods: Mapping[str, Iterable[str] | None], stats, schema: ProfileSchema) -> str:
    """A hash of everything that decides how values are scaled and laid out."""
    said = [{m: list(c or ()) for m, c in methods.items()}, {c: dict(sorted(s.items())) for c, s in sorted(stats.items())},
            schema.packed_columns()]
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=repr).encode()).hexdigest()


def committed(spark: SparkSession, manifest: str, scaling: str) -> list | None:
    """What earlier runs with this scaling finished; None if there is nothing to go on with."""
    if not is_complete(spark, manifest):
        return None
    rows = spark.read.schema(MANIFEST).parquet(manifest).collect()
    return rows if rows and all(r["scaling"] == scaling for r in rows) else None


def note(spark: SparkSession, manifest: str, rows: Sequence[tuple]) -> None:
    """Adds finished batches to the manifest; a batch that is noted is whole."""
    spark.createDataFrame(list(rows), MANIFEST).coalesce(1).write.mode("append").parquet(manifest)


def between(column, numbers: Sequence[int]):
    """Whether a column holds one of the sorted numbers, as ranges, which scans can skip by."""
    cuts = [i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1] + 1]
    spans = [(numbers[a], numbers[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(numbers)])]
    return reduce(lambda x, y: x | y, [column.between(a, b) for a, b in spans])


def clustered(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key together, if a join has scattered them; a plan without a shuffle keeps their order as it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan:
        return df
    return df.hint("rebalance", key)


def write_checked(df: DataFrame, path: str, rows: int, partition_by: Sequence[str] = (), mode: str = "static") -> None:
    """Writes `df` and counts on the way; fails unless it has `rows` rows without null, NaN or infinite values.

    `dynamic` replaces only the partition folders that `df` has rows for.
    """
    seen = Observation()
    bad = reduce(lambda x, y: x | y, [is_bad(f) for f in df.schema.fields])
    watched = df.withColumn("_bad", bad).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad")).drop("_bad")
    (watched.write.mode("overwrite").option("partitionOverwriteMode", mode).option("parquet.enable.dictionary", "false")
     .partitionBy(*partition_by).parquet(path))
    found = seen.get
    if found["bad"]:
        # Only now is the output read, to tell which columns are at fault.
        quality_check(scan_parquet(df.sparkSession, path))
    if found["rows"] != rows or found["bad"]:
        raise ValueError(f"{path}: expected {rows} rows, found {found['rows']}, {found['bad']} of them with bad values")


def export_phase(spark: SparkSession, out: str, dataset: str, schema: ProfileSchema,
                 num_val: int = 5, order: str = "numeric", shards: Mapping[str, int] = SHARDS,
                 seed: int = 42, overwrite: bool = False) -> dict[str, int]:
    """Shuffled shards of train, val and test, and the rows per split."""
    columns = schema.packed_columns()
    train = holdout_split(scan_parquet(spark, f"{out}/{dataset}/processed_train"), num_val, order)
    test = scan_parquet(spark, f"{out}/{dataset}/processed_test").withColumn("split", F.lit("test"))
    rows = train.select(*columns, "split").unionByName(test, allowMissingColumns=True)
    sizes = export_shards(rows, f"{out}/{dataset}/shards", schema.id_col, shards, seed,
                          if_exists="overwrite" if overwrite else "skip", balance="exact")
    save_manifest(spark.createDataFrame(list(sizes.items()), "split string, n long"),
                  f"{out}/{dataset}/data_size")
    return sizes
