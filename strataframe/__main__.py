"""All phases from the command line: python -m strataframe <phase> --out DIR ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strataframe.operators.post import collect_constants
from strataframe.plans.infer import (
    choose_phase, ensemble_phase, fit_phase, load_model, save_model, submit_run, validate_phase)
from strataframe.plans.prepare import export_phase, generate_phase, split_phase, statistics_phase
from strataframe.schema import ATMOSPHERE, UNUSED_LABELS
from strataframe.session import build_session
from strataframe.sources.files import first_row_long, header, ingest_csv
from strataframe.sources.lookups import load_lookup
from strataframe.sources.shards import read_shards

#: Batches held back from statistics and training alike.
NUM_VAL = 5


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strataframe")
    phases = parser.add_subparsers(dest="phase", required=True)

    def phase(name: str, text: str) -> argparse.ArgumentParser:
        sub = phases.add_parser(name, help=text)
        sub.add_argument("--out", required=True, help="folder of all tables")
        return sub

    split = phase("split", "CSV to Parquet")
    split.add_argument("--train", required=True)
    split.add_argument("--test", required=True)
    split.add_argument("--batch-size", type=int, default=100_000)
    split.add_argument("--rows", type=int, help="number of training rows, if known")
    stats = phase("statistics", "statistics of every column")
    stats.add_argument("--num-val", type=int, default=NUM_VAL, help="batches to hold back, the same as in export")
    stats.add_argument("--order", choices=("numeric", "lexicographic"), default="numeric")
    stats.add_argument("--quantile", choices=("radix", "approx", "exact", "states"), default="approx",
                       help="states: kept by batch, so that later calls read new batches only")
    generate = phase("generate", "lookup, features, scaling, packing")
    generate.add_argument("--lookup", required=True)
    generate.add_argument("--location-col", required=True, help="location id column of the lookup file")
    generate.add_argument("--methods", help="JSON file: scaler method to list of columns")
    export = phase("export", "shuffled shards")
    export.add_argument("--num-val", type=int, default=NUM_VAL)
    export.add_argument("--order", choices=("numeric", "lexicographic"), default="numeric")
    export.add_argument("--seed", type=int, default=42)
    fit = phase("fit", "ridge baseline on the training shards")
    fit.add_argument("--ridge", type=float, nargs="+", default=[1.0], help="several: the best is chosen by cross-validation")
    fit.add_argument("--folds", type=int, default=5)
    validate = phase("validate", "evaluation table and scores of a run; keeps the best")
    validate.add_argument("--monitor", choices=("val_r2", "r2_broken", "val_loss"), default="val_r2")
    validate.add_argument("--mode", choices=("max", "min"), default="max")
    validate.add_argument("--weights", help="CSV whose first row holds a weight per label; labels of weight zero are masked")
    validate.add_argument("--all-labels", action="store_true", help="also count the labels that are never predicted")
    submit = phase("submit", "submission of a run")
    ensemble = phase("ensemble", "best runs per column")
    ensemble.add_argument("--runs", required=True, nargs="+", metavar="NAME=DIR")
    ensemble.add_argument("--to", required=True, help="folder of the result")
    ensemble.add_argument("--best", type=int, default=3, help="runs per column")
    for sub in (fit, validate, submit):
        sub.add_argument("--run", required=True, help="folder of the run")
    for sub in (submit, ensemble):
        sub.add_argument("--weights", required=True, help="CSV whose first row holds a weight per label")
    for sub in (generate, export, fit, validate, submit):
        sub.add_argument("--dataset", default="dataset_v1")
    for sub in (generate, export):
        sub.add_argument("--overwrite", action="store_true")
    return parser.parse_args(argv)


def read_weights(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """(column, weight), columns in the order of the file."""
    fields = [T.StructField(c, T.StringType() if c == id_col else T.DoubleType()) for c in header(spark, path)]
    return first_row_long(ingest_csv(spark, path, T.StructType(fields)), id_col)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark, schema = build_session(f"strataframe {args.phase}"), ATMOSPHERE
    if args.phase == "split":
        split_phase(spark, args.train, args.test, args.out, schema, args.batch_size, args.rows)
    elif args.phase == "statistics":
        statistics_phase(spark, args.out, schema, args.num_val, args.quantile, order=args.order)
    elif args.phase == "generate":
        methods = {"standard": [*schema.in_scalars, *schema.in_families, *schema.out_scalars, *schema.out_families]}
        if args.methods:
            with open(args.methods) as f:
                methods = json.load(f)
        lookup = load_lookup(spark, args.lookup, args.location_col)
        generate_phase(spark, args.out, lookup, schema, methods, args.dataset, args.overwrite)
    elif args.phase == "export":
        export_phase(spark, args.out, args.dataset, schema, args.num_val, args.order, seed=args.seed, overwrite=args.overwrite)
    elif args.phase == "fit":
        train = read_shards(spark, f"{args.out}/{args.dataset}/shards", "train")
        if len(args.ridge) > 1:
            model = choose_phase(train, schema, args.ridge, args.run, args.folds).model
        else:
            model = fit_phase(train, schema, args.ridge[0])
        save_model(spark, model, f"{args.run}/model")
    elif args.phase == "validate":
        rows = read_shards(spark, f"{args.out}/{args.dataset}/shards", "val")
        model = load_model(spark, f"{args.run}/model")
        weights = read_weights(spark, args.weights, schema.id_col) if args.weights else None
        validate_phase(rows, model.predictor(), schema, args.run, weights, () if args.all_labels else UNUSED_LABELS,
                       args.monitor, args.mode).show()
    elif args.phase == "submit":
        weights = collect_constants(read_weights(spark, args.weights, schema.id_col))
        model = load_model(spark, f"{args.run}/model")
        submit_run(spark, args.out, args.dataset, args.run, {"ridge": model.predictor()}, schema, weights)
    else:
        runs = dict(run.split("=", 1) for run in args.runs)
        weights = read_weights(spark, args.weights, schema.id_col)
        ensemble_phase(spark, runs, schema, weights, spark.read.parquet(f"{args.out}/raw_test"), args.to, args.best)


if __name__ == "__main__":
    main()
