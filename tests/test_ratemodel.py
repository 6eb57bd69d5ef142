import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from premia import Blueprint, FromToRow, ModelMetadata, RateModel, VariableConfig, create_rate_model
from premia.operators.evaluate import compute_actual_expected
from premia.operators.relativities import apply_edits, diff_versions
from premia.sources.tariff_json import read_tariff, tariff_document, tariff_from_document, write_tariff

AGE = [(None, 20, 1.7), (20, 26, 1.25), (26, 40, 0.92), (40, 65, 1.0), (65, None, 1.33)]
REGION = [("North", 0.95), ("South", 1.05), ("Urban", 1.0)]


def numeric(rows):
    f = lambda x: None if x is None else float(x)
    return VariableConfig("numeric", tuple(FromToRow(f(a), f(b), None, r) for a, b, r in rows))


def categorical(rows, other=1.0):
    known = tuple(FromToRow(None, None, lv, r) for lv, r in rows)
    return VariableConfig("categorical", (*known, FromToRow(None, None, None, other)))


def age_model(**meta):
    return RateModel(0.1, {"DrivAge": numeric(AGE)}, ModelMetadata(**meta)).create_snapshot("Base model")


def predictions(model, df, **kw):
    return [r["prediction"] for r in model.predict(df, **kw).collect()]


def ages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "DrivAge double")


def test_numeric_rate_table_layout(spark):
    table = spark.createDataFrame([(0, 0.85), (5, 0.9), (10, 1.0), (15, 1.1)], "VehAge int, relativity double")
    model = RateModel.from_rate_tables({"VehAge": table}, {"VehAge": [0, 5, 10, 15]}, 0.1)
    rows = [(r.lower, r.upper, r.relativity) for r in model.variables["VehAge"].rows]
    assert rows == [(None, 0, 0.85), (0, 5, 0.85), (5, 10, 0.9), (10, 15, 1.0), (15, None, 1.1)]
    assert [s["description"] for s in model.list_snapshots()] == ["Base model"]
    assert model.current_version == 1


def test_categorical_rate_table_layout(spark):
    table = spark.createDataFrame(REGION, "Region string, relativity double")
    plan = {"Region": ["North", "South", "Urban", "West"]}
    model = RateModel.from_rate_tables({"Region": table}, plan, 0.1)
    rows = [(r.level, r.relativity) for r in model.variables["Region"].rows]
    assert rows == [("North", 0.95), ("South", 1.05), ("Urban", 1.0), ("West", 1.0), (None, 1.0)]


def test_variable_without_plan_is_skipped(spark):
    table = spark.createDataFrame([(1, 1.0)], "VarA int, relativity double")
    assert len(RateModel.from_rate_tables({"VarA": table}, {}, 0.1).variables) == 0


def test_break_without_a_rate_takes_one(spark):
    table = spark.createDataFrame([(0.0, 0.5)], "x double, relativity double")
    model = RateModel.from_rate_tables({"x": table}, {"x": [0.0, 1.0]}, 1.0)
    assert [r.relativity for r in model.variables["x"].rows] == [0.5, 0.5, 1.0]


@pytest.mark.parametrize(
    "values, expected",
    [
        ((20.0, 26.0, 40.0, 65.0, 19.5), (1.25, 0.92, 1.0, 1.33, 1.7)),
        ((21.0, 33.0, 64.999), (1.25, 0.92, 1.0)),
        ((5.0, 90.0), (1.7, 1.33)),
    ],
)
def test_numeric_scoring(spark, values, expected):
    got = predictions(age_model(), ages(spark, *values))
    assert got == pytest.approx([0.1 * e for e in expected])


def test_missing_number_is_an_error_unless_told_otherwise(spark):
    for bad in (None, float("nan")):
        with pytest.raises(PySparkException, match="falls in no bin"):
            predictions(age_model(), ages(spark, 20.0, bad))
    assert predictions(age_model(), ages(spark, 20.0, None), on_null="null")[1] is None
    assert predictions(age_model(), ages(spark, 20.0, None), on_null="mean")[1] == pytest.approx(0.125)


def test_levels_unknown_and_null_take_the_fallback(spark):
    model = RateModel(0.1, {"Region": categorical(REGION, other=2.0)})
    df = spark.createDataFrame([("North",), ("South",), ("Mars",), (None,)], "Region string")
    assert predictions(model, df) == pytest.approx([0.095, 0.105, 0.2, 0.2])


def test_empty_input_and_missing_column(spark):
    assert predictions(age_model(), ages(spark, 1.0).limit(0)) == []
    with pytest.raises(ValueError, match="lacks the rating variable"):
        age_model().predict(spark.createDataFrame([(1,)], "x int"))


def test_exposure(spark):
    model = age_model(exposure_col="Exposure")
    df = spark.createDataFrame([(20.0, 0.5, 2.0)], "DrivAge double, Exposure double, w double")
    assert predictions(model, df) == pytest.approx([0.0625])
    assert predictions(model, df, exposure_col=None) == pytest.approx([0.125])
    assert predictions(model, df, exposure_col="w") == pytest.approx([0.25])
    with pytest.warns(UserWarning, match="no exposure column"):
        assert predictions(model, ages(spark, 20.0)) == pytest.approx([0.125])


def test_column_map_goes_from_data_to_model(spark):
    df = spark.createDataFrame([(20.0,)], "age double")
    assert predictions(age_model(), df, column_map={"age": "DrivAge"}) == pytest.approx([0.125])


def test_edit_snapshot_and_score_by_version(spark):
    first = age_model()
    second = first.update_relativity("DrivAge", 20, 26, 2.0).create_snapshot("dearer")
    df = ages(spark, 20.0)
    assert predictions(second, df, version=1) == pytest.approx([0.125])
    assert predictions(second, df, version=2) == pytest.approx([0.2])
    assert predictions(first, df) == pytest.approx([0.125])
    assert [s["changes_count"] for s in second.list_snapshots()] == [0, 1]
    assert [s["parent_version"] for s in second.list_snapshots()] == [None, 1]
    (change,) = second.change_log(2)
    assert (change.old_relativity, change.new_relativity) == (1.25, 2.0)
    assert second.diff(1, 2) == [change] and second.diff(1, 1) == []
    with pytest.raises(KeyError):
        first.update_relativity("nope", 20, 26, 2.0)
    with pytest.raises(ValueError):
        first.update_relativity("DrivAge", 20, 27, 2.0)
    with pytest.raises(ValueError):
        first.switch_to(5)


def test_clone_and_signal():
    model = RateModel(1.0, {"a": numeric([(None, 1, 1.0), (1, None, 1.000001)]), "r": categorical(REGION)})
    assert model.clone() == model
    assert list(model.non_constant_variables) == ["r"]


def test_json_round_trip(spark, tmp_path):
    model = RateModel(
        0.1, {"DrivAge": numeric(AGE), "Region": categorical(REGION)},
        ModelMetadata("poisson", "ClaimNb", "Exposure", "Exposure", "traintest", ("DrivAge", "Region")),
        column_mapping={"age": "DrivAge"},
    ).create_snapshot("Base model")
    model = model.update_relativity("Region", None, None, 1.3).create_snapshot("other")
    path = str(tmp_path / "tariff")
    write_tariff(spark, model, path)
    assert read_tariff(spark, path) == model
    document = json.loads(json.dumps(tariff_document(model)))
    assert document["variables"]["DrivAge"]["table"][0] == {"from": None, "to": 20.0, "relativity": 1.7}
    assert document["variables"]["Region"]["table"][0] == {"from": "North", "to": "North", "relativity": 0.95}
    assert tariff_from_document(document) == model
    # A pretty-printed file of one document is read too.
    (tmp_path / "one.json").write_text(json.dumps(document, indent=2))
    assert read_tariff(spark, str(tmp_path / "one.json")) == model


def test_create_rate_model_saves(spark, tmp_path):
    table = spark.createDataFrame(REGION, "Region string, relativity double")
    path = str(tmp_path / "saved")
    model = create_rate_model({"Region": table}, {"Region": ["North", "South", "Urban"]}, 0.1,
                              save_to=path, spark=spark, target="ClaimNb")
    assert read_tariff(spark, path) == model


def test_table_edits_and_diff(spark):
    model = RateModel(0.1, {"DrivAge": numeric(AGE), "Region": categorical(REGION)})
    edits = spark.createDataFrame(
        [("DrivAge", None, 20.0, None, 3.0), ("Region", None, None, None, 1.5), ("Region", None, None, "Mars", 9.0)],
        "variable string, from_d double, to_d double, level string, new_relativity double",
    )
    base = model.relativity_table(spark)
    revised, changes, unmatched = apply_edits(base, edits)
    assert revised.count() == base.count() and changes.count() == 2 and unmatched.count() == 1
    versions = base.withColumn("version", F.lit(1)).unionByName(revised.withColumn("version", F.lit(2)))
    got = {(r["variable"], r["old_relativity"], r["new_relativity"]) for r in diff_versions(versions, 1, 2).collect()}
    assert got == {("DrivAge", 1.7, 3.0), ("Region", 1.0, 1.5)}
    again = RateModel.from_relativities(revised, 0.1)
    assert again.variables["Region"].fallback == 1.5


def test_wide_tariff_scores_like_a_loop(spark):
    """Far more branches than fit one generated method."""
    n_vars, n_breaks = 60, 20
    rows = [(None, 0, 1.0)] + [
        (i, i + 1 if i + 1 < n_breaks else None, 1 + i / 100) for i in range(n_breaks)
    ]
    model = RateModel(1.0, {f"x{j}": numeric(rows) for j in range(n_vars)})
    df = spark.range(50).select(
        "id", *[((F.col("id") * (j + 1)) % 23 - 1).cast("double").alias(f"x{j}") for j in range(n_vars)]
    )

    def rel(x):
        return 1.0 if x < 0 else 1 + min(int(x), n_breaks - 1) / 100

    for r in model.predict(df).collect():
        want = 1.0
        for j in range(n_vars):
            want *= rel(r[f"x{j}"])
        assert r["prediction"] == pytest.approx(want)


AE_ROWS = [(22, 0.6, 1, 1), (22, 1.4, 0, 0), (31, 0.5, 1, 1), (35, 0.75, 0, 1), (50, 1.0, 2, 1), (47, 0.8, 0, 0), (70, 0.4, 1, 0)]


def test_actual_expected(spark):
    df = spark.createDataFrame(AE_ROWS, "DrivAge int, Exposure double, ClaimNb int, traintest int")
    model = age_model(target="ClaimNb", weight_col="Exposure", exposure_col="Exposure", train_test_col="traintest")
    got = {
        (r["subset"], r["level"]): r
        for r in compute_actual_expected(model, df, "DrivAge", "sum_over_weight").collect()
    }
    assert {s for s, _ in got} == {"all", "train", "test"}
    assert len(got) == 3 * len(AGE)
    row = got["all", "[20.0, 26.0)"]
    assert row["actual"] == pytest.approx(1 / 2) and row["exposure"] == pytest.approx(2.0)
    assert row["expected"] == pytest.approx(0.125)
    assert tuple(got["all", "< 20.0"][c] for c in ("actual", "expected", "exposure")) == (0, 0, 0)
    assert got["test", "[26.0, 40.0)"]["exposure"] == 0
    weighted = {
        (r["subset"], r["level"]): r["actual"]
        for r in compute_actual_expected(model, df, "DrivAge", "sum_weighted").collect()
    }
    assert weighted["all", "[26.0, 40.0)"] == pytest.approx(0.4)


def test_actual_expected_without_flag_or_target(spark):
    df = spark.createDataFrame([r[:3] for r in AE_ROWS], "DrivAge int, Exposure double, ClaimNb int")
    model = age_model(target="ClaimNb", train_test_col="traintest")
    rows = compute_actual_expected(model, df, "DrivAge", "sum_unweighted").collect()
    assert {r["subset"] for r in rows} == {"all"}
    with pytest.raises(ValueError, match="which column is its target"):
        compute_actual_expected(age_model(), df, "DrivAge")
    with pytest.raises(ValueError, match="lacks the target"):
        compute_actual_expected(age_model(target="nope"), df, "DrivAge")


def test_blueprint_from_lists_kinds():
    plan = Blueprint.from_lists({"a": [2, 1, 1], "b": ["x"], "c": [], "d": "Error: broken"})
    assert [plan[v].kind for v in plan] == ["numeric", "categorical", "empty", "error"]
    assert plan["a"].breaks == (1.0, 2.0)


def test_switch_drops_edits_that_were_not_kept():
    rows = (FromToRow(None, 30.0, None, 1.4), FromToRow(30.0, None, None, 0.8))
    model = RateModel(1.0, {"x": VariableConfig("numeric", rows)}, ModelMetadata()).create_snapshot("first")
    key = rows[0].key
    edited = model.update_relativity("x", key[0], key[1], 9.0).switch_to(1).create_snapshot("again")
    assert edited.snapshots[-1].changes == ()


def test_edits_of_one_row_apply_in_order(spark):
    table = spark.createDataFrame(
        [("x", "numeric", 0, None, 30.0, None, 1.4), ("x", "numeric", 1, 30.0, None, None, 0.8)],
        "variable string, kind string, ord int, from_d double, to_d double, level string, relativity double",
    )
    edits = spark.createDataFrame(
        [("x", 30.0, None, None, 2.0, 1), ("x", 30.0, None, None, 1.5, 2)],
        "variable string, from_d double, to_d double, level string, new_relativity double, step int",
    )
    revised, changes, unmatched = apply_edits(table, edits, "step")
    assert sorted(r["relativity"] for r in revised.collect()) == [1.4, 1.5]
    assert sorted((r["old_relativity"], r["new_relativity"]) for r in changes.collect()) == [(0.8, 2.0), (2.0, 1.5)]
    assert unmatched.isEmpty()
