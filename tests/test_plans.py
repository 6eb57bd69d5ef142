"""The plans are the ones meant: what is read, what is shuffled and what never happens."""

import re

import pytest
from pyspark.sql import functions as F

from premia import actual_expected, generate_blueprint, prepare_data
from premia.operators.cells import aggregate_cells
from premia.operators.prepare import with_bins
from premia.operators.ratetable import generate_all_ratetables
from premia.session import ScratchTable, local_table, scratch_path, scratch_root
from workload.registry import pf
from workload.tariffs import PLAN, effects_model, revised_tariff, tariff


@pytest.fixture(scope="module")
def flat(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flat") / "portfolio")
    pf(spark, sf_dir).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan: str) -> set[str]:
    found = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    return {c.split(":")[0] for s in found for c in s.split(",")}


def test_scoring_is_one_projection_over_the_scan(flat):
    scored = tariff(exposure=True).predict(flat).select("prediction")
    plan = plan_of(scored)
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert read_columns(plan) == {"discount", "p_size", "segment", "Exposure"}


def test_model_prediction_does_not_shuffle_rows(flat):
    plan = plan_of(effects_model().predict(flat, fill={}).select("prediction"))
    assert "Exchange" not in plan and "Python" not in plan


def test_batch_means_take_one_aggregate_row_and_no_window(flat):
    wide = prepare_data(["tax_null", "p_size"], df=flat, formats={"tax_null": [0.02, 0.04], "p_size": [20]})
    plan = plan_of(wide)
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_report_sums_before_the_shuffle_and_prunes_columns(flat):
    report = actual_expected(tariff(exposure=True), flat)
    plan = plan_of(report)
    assert "partial_sum" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert read_columns(plan) == {"discount", "p_size", "segment", "Exposure", "ClaimNb", "traintest"}


def test_versions_are_scored_in_one_scan(flat):
    assert plan_of(revised_tariff().score_versions(flat)).count("FileScan") == 1


def test_cells_push_the_training_filter_to_the_scan(flat):
    plans = generate_blueprint(flat, ["discount", "segment"])
    ready, bins = with_bins(flat.where("traintest = 1"), list(plans), plans, {})
    plan = plan_of(aggregate_cells(ready, bins, {}, F.col("ClaimNb"), F.col("Exposure"), "poisson"))
    assert "EqualTo(traintest,1)" in plan and "partial_sum" in plan


def test_rate_tables_read_one_reference_row(flat):
    plan = plan_of(generate_all_ratetables(effects_model(), flat, list(PLAN)))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("LocalTableScan") >= 1


def test_local_tables_are_local_relations(spark):
    df = local_table(spark, [(1, None, "a")], "a int, b double, c string")
    assert "LocalTableScan" in plan_of(df) and df.collect() == [(1, None, "a")]
    assert local_table(spark, [], "a int").collect() == []


def test_scratch_tables_live_in_the_shared_folder(spark):
    root = scratch_root(spark)
    assert scratch_root(spark) == root and scratch_path(spark, "x").startswith(root)
    table = ScratchTable(spark.range(10), "numbers")
    assert table.path.startswith(root) and table.df.count() == 10
    table.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(table.path)


def test_registered_comparisons_use_the_defaults(monkeypatch):
    from workload import models

    seen = {}
    monkeypatch.setattr(models, "pf", lambda spark, sf: None)
    monkeypatch.setattr(models, "compare_methods", lambda *a, **k: seen.update(k))
    models.m10(None, "")
    assert tuple(seen["methods"]) == models.METHODS
    assert not {"cv_params", "gbt_iterations"} & set(seen)
