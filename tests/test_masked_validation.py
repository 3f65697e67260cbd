"""What a masked label may decide, and what a lookup file must hold."""

import numpy as np
import pytest

from strataframe.__main__ import parse
from strataframe.plans.infer import validate_phase
from strataframe.schema import ProfileSchema
from strataframe.sources.lookups import load_lookup

SCHEMA = ProfileSchema(in_scalars=("a",), in_families=("v",), out_scalars=("y", "z"), out_families=("w",), levels=2)


def test_masked_labels_decide_nothing(spark, tmp_path):
    rows = [(f"train_{i}", float(i), [i / 2, 1.0], float(i), float(-i), [i / 3, float(i % 2)]) for i in range(12)]
    packed = spark.createDataFrame(rows, "sample_id string, a double, v array<double>, y double, z double, w array<double>")
    # z and w_1 are predicted badly, y and w_0 exactly.
    def predict(x):
        return np.stack([x[:, 0], x[:, 0] + 100, x[:, 0] / 3, x[:, 0] + 50], axis=1)

    weights = spark.createDataFrame([("y", 1.0), ("z", 0.0), ("w_0", 2.0), ("w_1", 1.0)], "column string, weight double")
    plain = validate_phase(packed, predict, SCHEMA, str(tmp_path / "plain")).first()
    assert plain["r2_broken"] == 2 and plain["val_r2"] == pytest.approx(0.5) and plain["val_loss"] > 10
    half = validate_phase(packed, predict, SCHEMA, str(tmp_path / "half"), unused=["w_1"]).first()
    assert half["r2_broken"] == 1
    both = validate_phase(packed, predict, SCHEMA, str(tmp_path / "both"), weights, ["w_1"]).first()
    assert both["r2_broken"] == 0 and both["val_r2"] == pytest.approx(1) and both["val_loss"] == pytest.approx(0)
    assert spark.read.parquet(str(tmp_path / "both" / "broken_columns")).count() == 0


def test_one_holdout_and_masks_by_default():
    stats, export = parse(["statistics", "--out", "o"]), parse(["export", "--out", "o"])
    assert (stats.num_val, stats.order) == (export.num_val, export.order) == (5, "numeric")
    args = parse(["validate", "--out", "o", "--run", "r", "--weights", "w"])
    assert args.weights == "w" and not args.all_labels


def test_lookup_files_are_read_strictly(spark, tmp_path):
    def lookup(name, *lines):
        (tmp_path / name).write_text("\n".join(["timestamp,k,site,lat,lon", *lines]) + "\n")
        return load_lookup(spark, str(tmp_path / name), "site", "k").collect()

    good = lookup("good.csv", "0001-02-01 04:00:00,1.5,3.0,10,20", "0001-02-01 08:00:00,,4,,20")
    assert [(r["k"], r["location"], r["lat"]) for r in good] == [(1.5, 3, 10.0), (None, 4, None)]
    for name, line in (("short", "0001-02-01 04:00:00,1.5"), ("word", "0001-02-01 04:00:00,x,3,10,20"), ("part", "0001-02-01 04:00:00,1,3.5,10,20")):
        with pytest.raises(Exception):
            lookup(f"{name}.csv", line)
