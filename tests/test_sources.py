from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from curvewalk.operators.folds import WalkForward
from curvewalk.operators.panel import at_position, with_positions, within_dates_of
from curvewalk.plans.backtest import forecast_horizon
from curvewalk.plans.yields import transform_horizon
from curvewalk.sources import tables

CONFIG = {
    "one-day-ahead": {"max_features": ["x0", "x1"], "other_features": ["x2"]},
    "seven-day-ahead": {"max_features": ["x1"], "other_features": []},
    "dependent_variables": ["t0", "t1", "t2", "t3"],
}


def test_config_roles_and_unknown_horizon(spark, tmp_path):
    path = tmp_path / "features.yaml"
    path.write_text(json.dumps(CONFIG))
    config = tables.feature_config(spark, str(path))
    assert tables.features(config, "one-day-ahead") == ["x0", "x1"]
    assert tables.features(config, "one-day-ahead", ("max", "other")) == ["x0", "x1", "x2"]
    assert tables.targets(config) == ["t0", "t1", "t2", "t3"]
    assert sorted(r.horizon for r in tables.horizons(config).collect()) == ["one-day-ahead", "seven-day-ahead"]
    with pytest.raises(ValueError, match="seven-day-ahead"):
        tables.features(config, "ninety-day-ahead")
    with pytest.raises(FileNotFoundError):
        tables.feature_config(spark, str(tmp_path / "absent.yaml"))


def test_flat_config(spark, tmp_path):
    path = tmp_path / "flat.yaml"
    path.write_text("DGS10:\n- A\n- B_lag\n")
    assert tables.features(tables.feature_config(spark, str(path)), "DGS10") == ["A", "B_lag"]


def test_table_source_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.table_source(spark, str(tmp_path / "t.csv"))
    with pytest.raises(FileNotFoundError):
        tables.table_source(spark, str(tmp_path / "t.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(ValueError, match="lacks"):
        tables.table_source(spark, str(tmp_path / "t.parquet"), ["id", "other"])


def test_dates_from_file_names(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in ("2016-08-26", "2016-08-29.part"):
        pq.write_table(pa.table({"beta0": [0.1, 0.2]}), tmp_path / f"{name}.parquet")
    (tmp_path / "notes.txt").write_text("not data")
    got = tables.read_dated_files(spark, str(tmp_path)).groupBy("date").count().collect()
    assert {(r.date, r["count"]) for r in got} == {(datetime.date(2016, 8, 26), 2), (datetime.date(2016, 8, 29), 2)}


def test_rewriting_one_horizon_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "samples")
    tables.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "horizon string, v int"), path, ["horizon"])
    tables.write_table(spark.createDataFrame([("b", 3)], "horizon string, v int"), path, ["horizon"])
    assert {(r.horizon, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    assert [r.v for r in tables.read_samples(spark, path, "b").collect()] == [3]


class Session:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})


def test_shared_folder_follows_the_cluster_setting():
    assert tables.shared_folder(Session("yarn", "hdfs:///shared/"), "fits").startswith("hdfs:///shared/fits-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session("yarn", None), "fits")
    local = tables.shared_folder(Session("local[2]", None), "fits")
    assert local.rsplit("/", 1)[0] == tables.shared_folder(Session("local[2]", None), "other").rsplit("/", 1)[0]


def test_positions_out_of_range_raise(spark):
    df = spark.createDataFrame(
        [("a", i) for i in range(5)] + [("b", i) for i in range(2)], "series_id string, d int"
    ).select("series_id", F.date_add(F.lit("2020-12-30").cast("date"), F.col("d")).alias("date"), "d")
    placed = with_positions(df)
    assert [r.d for r in at_position(placed, 1, ["d"]).orderBy("series_id").collect()] == [1, 1]
    with pytest.raises(Exception, match="out of bounds"):
        at_position(placed, 3, ["d"]).collect()
    few = placed.filter("series_id = 'b'")
    assert within_dates_of(placed, few).count() == 4


def test_whole_run_from_stored_panel_to_yields(spark, tmp_path):
    panel, root = str(tmp_path / "panel.parquet"), str(tmp_path / "out")
    (tmp_path / "features.json").write_text(json.dumps(CONFIG))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 60)
    wave = F.sin(F.col("id") / 5.0)
    spark.range(120).select(
        F.when(F.col("id") < 60, "s1").otherwise("s2").alias("series_id"),
        day.alias("date"),
        wave.alias("x0"),
        F.cos(F.col("id") / 7.0).alias("x1"),
        (0.03 + wave / 100).alias("t0"),
        (-0.01 - wave / 200).alias("t1"),
        (0.01 + wave / 300).alias("t2"),
        (0.5 + wave / 10).alias("t3"),
    ).write.parquet(panel)
    run = forecast_horizon(
        spark, panel, str(tmp_path / "features.json"), "one-day-ahead", WalkForward(30, 10, 10), "ridge",
        output=root, n_samples=25,
    )
    assert run.summary().count() == 6
    samples = tables.read_samples(spark, f"{root}/samples", "one-day-ahead")
    assert samples.count() == 60 * 25
    with pytest.raises(ValueError):  # names that don't tell the coefficients
        transform_horizon(spark, root, "one-day-ahead", CONFIG["dependent_variables"], 25)
    named = dict(zip(CONFIG["dependent_variables"], ["beta0", "beta1", "beta2", "lambda_"]))
    transform_horizon(spark, root, "one-day-ahead", named, 25)
    assert run.report().count() == 8
    assert tables.read_samples(spark, f"{root}/sample_yields", "one-day-ahead").count() == 60 * 25 * 11
    assert tables.read_samples(spark, f"{root}/mean_yields", "one-day-ahead").count() == 60
    points = tables.read_samples(spark, f"{root}/yield_results", "one-day-ahead")
    assert points.count() == 60 and points.filter("DGS10_actual is null or DGS10_prediction is null").count() == 0
    with pytest.raises(ValueError):
        forecast_horizon(spark, panel, str(tmp_path / "features.json"), "one-day-ahead", WalkForward(30), "forest")


def test_scratch_tables_go_and_results_stay(spark, tmp_path):
    from pathlib import Path

    path = f"{tmp_path}/kept.parquet"
    with tables.scratch(spark):
        stored = tables.materialize(spark.range(5), "passing")
        folder = Path(stored.inputFiles()[0].removeprefix("file:")).parent
        stored.write.parquet(path)
        assert folder.exists()
    assert not folder.exists() and spark.read.parquet(path).count() == 5
    with pytest.raises(ZeroDivisionError), tables.scratch(spark):
        folder = Path(tables.materialize(spark.range(5), "lost").inputFiles()[0].removeprefix("file:")).parent
        raise ZeroDivisionError
    assert not folder.exists()
    outside = tables.materialize(spark.range(3), "kept")
    assert outside.count() == 3
