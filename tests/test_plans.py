"""All phases in a row on a small schema, checked against numpy on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataframe.__main__ import parse, read_weights
from strataframe.functions.scaling import collect_stats
from strataframe.operators.stats import column_stats, quality_check
from strataframe.plans.infer import (
    choose_phase, ensemble_phase, fit_phase, load_model, predict_packed, save_model, submit_phase, submit_run, unpacked_labels, validate_phase)
from strataframe.plans.prepare import build_dataset, export_phase, generate_phase, pack_scaled, split_phase, statistics_phase
from strataframe.schema import ProfileSchema
from strataframe.sources.files import write_csv
from strataframe.sources.lookups import load_lookup
from strataframe.sources.shards import methods_from_table, read_shards

SMALL = ProfileSchema(
    in_scalars=("state_ps",), in_families=("pbuf_ozone", "state_q0002"), out_scalars=("cam_out_NETSW",),
    out_families=("ptend_q0002",), levels=3)
N, N_TEST = 200, 40
METHODS = {"standard": ["state_ps", "pbuf_ozone", "cam_out_NETSW", "ptend_q0002"], "minmax": ["state_q0002"],
           "robust": []}
MAPPING = {"ptend_q0002_0": "state_q0002_0"}


def make_samples(n, prefix, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(SMALL.input_columns)))
    df = pd.DataFrame(x, columns=SMALL.input_columns)
    df.insert(0, "sample_id", [f"{prefix}_{i}" for i in range(n)])
    df["cam_out_NETSW"] = df["state_ps"] * 2 + df["pbuf_ozone_1"]
    for i in range(3):
        df[f"ptend_q0002_{i}"] = df[f"state_q0002_{i}"] * (i + 1) - 0.5
    return df


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("world"))
    train, test = make_samples(N, "train", 1), make_samples(N_TEST, "test", 2).drop(columns=SMALL.label_columns)
    # Keys of twelve digits, so that a shift in the sixteenth rounds away.
    test["pbuf_ozone_2"] = test["pbuf_ozone_2"].round(12)
    write_csv(spark.createDataFrame(train), f"{base}/train_csv", SMALL.raw_struct().names)
    write_csv(spark.createDataFrame(test), f"{base}/test_csv", SMALL.raw_struct(labels=False).names)
    # Half of the test keys are off in the 16th digit and meet their lookup row only when rounded.
    keys = list(train["pbuf_ozone_2"]) + list(test["pbuf_ozone_2"] + np.where(np.arange(N_TEST) % 2, 2e-16, 0))
    times = pd.date_range("2001-01-01", periods=N, freq="20min").tolist() + [pd.Timestamp("2001-02-03 16:00")] * N_TEST
    lookup = spark.createDataFrame(pd.DataFrame({
        "pbuf_ozone_2": keys, "site": np.arange(N + N_TEST) % 384, "timestamp": [str(t) for t in times],
        "lat": np.linspace(-90, 90, N + N_TEST), "lon": np.linspace(0, 359, N + N_TEST)}))
    write_csv(lookup, f"{base}/lookup_csv", ["pbuf_ozone_2", "site", "timestamp", "lat", "lon"])
    split_phase(spark, f"{base}/train_csv", f"{base}/test_csv", base, SMALL, batch_size=20)
    statistics_phase(spark, base, SMALL, quantile="exact")
    generate_phase(spark, base, load_lookup(spark, f"{base}/lookup_csv", "site"), SMALL, METHODS, "v1")
    sizes = export_phase(spark, base, "v1", SMALL, num_val=3, shards={"train": 4, "val": 2, "test": 1})
    return base, train, test, sizes


def test_sizes(spark, world):
    base, _, _, sizes = world
    assert sizes == {"train": N - 60, "val": 60, "test": N_TEST}
    assert {r["split"]: r["n"] for r in spark.read.parquet(f"{base}/v1/data_size").collect()} == sizes
    assert methods_from_table(spark.read.parquet(f"{base}/v1/scaler_methods")) == {
        k: v for k, v in METHODS.items() if v}
    val = {r["sample_id"] for r in read_shards(spark, f"{base}/v1/shards", "val").collect()}
    assert val == {f"train_{i}" for i in range(N - 60, N)}


def test_processed(spark, world):
    base, train, test, _ = world
    rows = spark.read.parquet(f"{base}/v1/processed_train")
    assert rows.columns == [*SMALL.packed_columns(), "batch_id", "start", "end"]
    types = dict(rows.dtypes)
    assert types["state_ps"] == types["lat"] == "float" and types["ptend_q0002"] == "array<float>"
    assert types["location"] == types["year"] == "bigint"
    quality_check(rows, N)
    got = rows.orderBy(F.expr("CAST(substring(sample_id, 7) AS INT)")).toPandas()
    ps = train["state_ps"]
    assert np.allclose(got["state_ps"], (ps - ps.mean()) / ps.std(), atol=1e-5)
    q = train[["state_q0002_0", "state_q0002_1", "state_q0002_2"]]
    assert np.allclose(np.stack(got["state_q0002"]), (q - q.min()) / (q.max() - q.min()), atol=1e-5)
    assert list(got["hour"][:4]) == [0, 0, 0, 1] and list(got["day"][-1:]) == [3]
    processed_test = spark.read.parquet(f"{base}/v1/processed_test").toPandas()
    assert list(processed_test["sample_id"]) == sorted(test["sample_id"])
    assert set(processed_test["year"]) == {7} and set(processed_test["month"]) == {2}
    assert "ptend_q0002" not in processed_test


def test_generate_skips_existing(spark, world):
    base, *_ = world
    before = spark.read.parquet(f"{base}/v1/processed_train").count()
    generate_phase(spark, base, load_lookup(spark, f"{base}/lookup_csv", "site").limit(0), SMALL, METHODS, "v1")
    assert spark.read.parquet(f"{base}/v1/processed_train").count() == before
    # Other methods change neither the tables nor the sidecar that tells how they were scaled.
    other = {"minmax": [c for cs in METHODS.values() for c in cs or ()]}
    generate_phase(spark, base, load_lookup(spark, f"{base}/lookup_csv", "site").limit(0), SMALL, other, "v1")
    assert methods_from_table(spark.read.parquet(f"{base}/v1/scaler_methods")) == {k: v for k, v in METHODS.items() if v}


def test_fit_validate_submit_combine(spark, world, tmp_path):
    base, train, test, _ = world
    shards = f"{base}/v1/shards"
    fit, val = read_shards(spark, shards, "train"), read_shards(spark, shards, "val")
    stats = collect_stats(spark.read.parquet(f"{base}/stats"))
    means = {c: stats[c]["mean"] for c in SMALL.label_columns}
    weights = {c: float(i) for i, c in enumerate(SMALL.label_columns, start=1)}
    weight_df = spark.createDataFrame(list(weights.items()), "column string, weight double")
    runs, summaries = {}, []
    raw_test = spark.read.parquet(f"{base}/raw_test")
    packed_test = read_shards(spark, shards, "test")
    for name, ridge in (("exp001a", 0.001), ("exp002a", 50.0)):
        model = fit_phase(fit, SMALL, ridge)
        out = runs[name] = str(tmp_path / name)
        summaries.append(validate_phase(val, model.predictor(), SMALL, out, weight_df).first())
        submit_phase(packed_test, raw_test, model.predictor(), SMALL, METHODS, stats, means, [], weights,
                     f"{out}/submission_1", mapping=MAPPING)
        scores = {r["column"]: r["r2"] for r in spark.read.parquet(f"{out}/each_r2_score").collect()}
        assert set(scores) == set(SMALL.label_columns)
    # The labels are linear in the inputs: little shrinkage fits them, much of it does not.
    assert summaries[0]["r2_broken"] == 0 and summaries[0]["val_r2"] > 0.999 and summaries[0]["val_loss"] < 0.001
    assert summaries[1]["val_r2"] < summaries[0]["val_r2"] and summaries[1]["val_loss"] > summaries[0]["val_loss"]
    assert spark.read.parquet(f"{runs['exp001a']}/evaluation").columns[:2] == ["sample_id_label", "cam_out_NETSW_label"]

    first = spark.read.option("header", True).csv(f"{runs['exp001a']}/submission_1").toPandas().set_index("sample_id")
    truth = test.set_index("sample_id").loc[first.index]
    assert np.allclose(first["ptend_q0002_0"].astype(float), -truth["state_q0002_0"] / 1200 * weights["ptend_q0002_0"])
    want = np.maximum(truth["state_ps"] * 2 + truth["pbuf_ozone_1"], 0)
    assert np.allclose(first["cam_out_NETSW"].astype(float), want, atol=1e-2)

    ensemble_phase(spark, runs, SMALL, weight_df, raw_test, str(tmp_path / "mean"), k=2, mapping=MAPPING)
    mean = spark.read.option("header", True).csv(str(tmp_path / "mean")).toPandas().set_index("sample_id")
    assert list(mean.columns) == list(weights)
    second = spark.read.option("header", True).csv(f"{runs['exp002a']}/submission_1").toPandas().set_index("sample_id")
    both = (first["ptend_q0002_2"].astype(float) + second["ptend_q0002_2"].astype(float)) / 2
    assert np.allclose(mean["ptend_q0002_2"].astype(float), both.loc[mean.index])
    assert np.allclose(mean["ptend_q0002_0"].astype(float), -truth["state_q0002_0"].loc[mean.index] / 1200)


def test_phases_read_their_sidecars(spark, world, tmp_path):
    """Two models in one pass give what each gives alone; a worse validation changes no sidecar."""
    base, *_ = world
    run, shards = str(tmp_path / "exp003a"), f"{base}/v1/shards"
    good = fit_phase(read_shards(spark, shards, "train"), SMALL, 0.001)
    save_model(spark, good, f"{run}/model")
    loaded = load_model(spark, f"{run}/model")
    assert np.allclose(loaded.weights, good.weights) and np.allclose(loaded.bias, good.bias)
    val = read_shards(spark, shards, "val")
    validate_phase(val, loaded.predictor(), SMALL, run)
    validate_phase(val, lambda x: np.zeros((len(x), 4)), SMALL, run)
    best = spark.read.parquet(f"{run}/best_summary").first()
    assert best["val_r2"] > 0.999 and spark.read.parquet(f"{run}/broken_columns").count() == 0
    assert spark.read.parquet(f"{run}/last_summary").first()["val_r2"] < 0.1
    validate_phase(val, lambda x: np.zeros((len(x), 4)), SMALL, run, monitor="r2_broken", mode="max")
    assert spark.read.parquet(f"{run}/broken_columns").count() > 0
    validate_phase(val, loaded.predictor(), SMALL, run, monitor="r2_broken", mode="min")
    assert spark.read.parquet(f"{run}/broken_columns").count() == 0
    with pytest.raises(ValueError):
        validate_phase(val, loaded.predictor(), SMALL, run, monitor="accuracy")

    weights = {c: 1.0 for c in SMALL.label_columns}
    submit_run(spark, base, "v1", run, {"a": loaded.predictor(), "b": lambda x: np.zeros((len(x), 4))}, SMALL, weights, MAPPING)
    both = [spark.read.option("header", True).csv(f"{run}/submission_{m}").toPandas() for m in "ab"]
    stats = collect_stats(spark.read.parquet(f"{base}/stats"))
    alone = str(tmp_path / "alone")
    submit_phase(spark.read.parquet(f"{base}/v1/processed_test"), spark.read.parquet(f"{base}/raw_test"), loaded.predictor(), SMALL,
                 METHODS, stats, {}, [], weights, alone, mapping=MAPPING)
    pd.testing.assert_frame_equal(both[0], spark.read.option("header", True).csv(alone).toPandas())
    mean = stats["ptend_q0002_2"]["mean"]
    assert np.allclose(both[1]["ptend_q0002_2"].astype(float), mean)


def test_command_line(spark, tmp_path):
    args = parse(["ensemble", "--out", "o", "--runs", "a=x", "b=y=z", "--weights", "w", "--to", "t"])
    assert args.runs == ["a=x", "b=y=z"] and args.best == 3
    assert parse(["validate", "--out", "o", "--run", "r", "--monitor", "r2_broken", "--mode", "min"]).monitor == "r2_broken"
    with pytest.raises(SystemExit):
        parse(["submit", "--out", "o"])
    path = str(tmp_path / "weights")
    write_csv(spark.createDataFrame([("t_0", 2.0, 0.5)], "sample_id string, z double, a double"), path, ["sample_id", "z", "a"])
    assert [tuple(r) for r in read_weights(spark, path, "sample_id").collect()] == [("z", 2.0), ("a", 0.5)]


def test_scaled_integers_become_floats(spark):
    schema = ProfileSchema(("i",), ("v",), (), (), levels=1)
    raw = spark.createDataFrame([("a", 1, 2.0, 7)], "sample_id string, i int, v_0 double, n int")
    stats = {"i": dict(mean=0.5, std=0.25, q1=0, q2=0, q3=0, min=0, max=0, std_y=0, **{"lambda": 1})}
    packed = pack_scaled(raw, schema, {"standard": ["i"]}, stats, carry={"n": "n"})
    assert packed.dtypes == [("sample_id", "string"), ("i", "float"), ("v", "array<float>"), ("n", "int")]
    assert packed.first()["i"] == 2


def test_build_equals_wide_features(spark, world):
    """Packing before the join gives what scaling after it would."""
    base, train, *_ = world
    raw = spark.read.parquet(f"{base}/raw_train").drop("batch_id", "start", "end")
    lookup = load_lookup(spark, f"{base}/lookup_csv", "site")
    built = build_dataset(raw, lookup, column_stats(raw, SMALL.input_columns + SMALL.label_columns), SMALL)
    assert unpacked_labels(built, SMALL).columns == ["sample_id", *SMALL.label_columns]
    assert predict_packed(built, lambda x: np.zeros((len(x), 4)), SMALL).count() == N


def test_penalty_chosen_by_folds(spark, world, tmp_path):
    base, *_ = world
    fit = read_shards(spark, f"{base}/v1/shards", "train")
    found = choose_phase(fit, SMALL, [0.001, 1e5], str(tmp_path), folds=3)
    assert found.ridge == 0.001
    rows = spark.read.parquet(f"{tmp_path}/ridge_scores").collect()
    assert {(r["ridge"], r["column"]) for r in rows} == {(p, c) for p in (0.001, 1e5) for c in SMALL.label_columns}
    assert all(r["chosen"] == (r["ridge"] == 0.001) for r in rows)
    assert all(r["r2"] > 0.99 for r in rows if r["chosen"])
    args = parse(["fit", "--out", "o", "--run", "r", "--ridge", "0.1", "10"])
    assert args.ridge == [0.1, 10.0] and parse(["fit", "--out", "o", "--run", "r"]).ridge == [1.0]
