"""Shift tests of the triage model and the tree on diagnostics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajscreen.functions.lineage import cut
from trajscreen.operators import answers

KINDS = ("none", "frozen", "penetration", "inversion")


@pytest.fixture(scope="module")
def parts(spark):
    """Kinds a feature apart each; frozen lies where none and penetration meet, so who never saw it can't be sure."""
    r = np.random.default_rng(1)
    at = {"none": (0.0, 0.0), "penetration": (4.0, 0.0), "inversion": (0.0, 4.0), "frozen": (2.0, 0.0)}
    rows = [(s, f, 1 + (s + f) % 3, k, *(float(x + r.normal() * 0.5) for x in at[k])) for s in range(30) for f in range(8) for k in KINDS]
    df = cut(spark.createDataFrame(rows, "sim long, frame int, sev int, kind string, a double, b double").withColumn("item", F.concat_ws("-", "sim", "frame", "kind")))
    return [df.where(F.col("sim") % 3 == i) for i in range(3)]


def test_unseen_type_is_abstained_on_and_the_rest_is_scored(parts):
    row = answers.heldout_type(*parts, ["a", "b"], "frozen").first()
    assert row["heldout"] == "frozen" and row["n"] == 10 * 8 * 3
    assert row["accuracy"] > 0.9 and 0.05 <= row["temperature"] <= 20
    seen = [p.where("kind <> 'frozen'") for p in parts]
    model = answers.fit_calibrated(seen[0], seen[1], ["a", "b"])
    unsure = model.predict(parts[2].where("kind = 'frozen'")).toPandas().conf < row["tau"]
    assert row["tau"] == model.tau and row["abstain_rate"] == pytest.approx(unsure.mean())


def test_tau_comes_from_the_calibration_part(parts):
    train, calibration, test = parts
    model = answers.fit_calibrated(train, calibration, ["a", "b"])
    sure = model.predict(calibration).select("item", "conf", (F.col("pred") == F.col("kind")).cast("int").alias("correct")).toPandas().sort_values(["conf", "item"], ascending=[False, True])
    cum = sure.correct.cumsum().to_numpy() / np.arange(1, len(sure) + 1)
    ok = np.flatnonzero(cum >= 0.95)
    assert model.tau == pytest.approx(sure.conf.iloc[ok.max()] if len(ok) else 1.0)
    assert model.evaluate(test).first()["tau"] == model.tau


def test_unseen_severity_counts_clean_frames_of_all(parts):
    row = answers.heldout_severity(*parts, ["a", "b"]).first()
    test = parts[2]
    assert row["n"] == test.where("kind = 'none' or sev = 1").count() and row["accuracy"] > 0.6


def test_tree_predicts_rows_it_was_not_fitted_on(parts):
    df = parts[0].unionByName(parts[1]).where("kind <> 'frozen'")
    got = answers.diagnostic_tree_cv(df, ["a", "b"], carry=("sev",)).toPandas()
    assert len(got) == df.count() and got.item.is_unique and (got.kind == got.pred).mean() > 0.9 and set(got.sev) == {1, 2, 3}
