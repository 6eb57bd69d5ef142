"""Stores of versions, many versions at once, ordered edits, and plans that read nothing."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from premia import Blueprint
from premia.operators.glm import fixed_model
from premia.operators.ratemodel import RateModel
from premia.operators.ratetable import generate_all_ratetables, ratetable
from premia.operators.relativities import RELATIVITY_SCHEMA, apply_edits
from premia.operators.versions import VersionStore, version_totals
from workload.ratings import one_way_relativities

EDITS = "variable string, from_d double, to_d double, level string, new_relativity double, step int"


def numeric(name, *rows):
    return [(name, "numeric", i, a, b, None, x) for i, (a, b, x) in enumerate(rows)]


def levels(name, other, **values):
    rows = [(name, "categorical", i, None, None, lv, x) for i, (lv, x) in enumerate(values.items())]
    return [*rows, (name, "categorical", len(rows), None, None, None, other)]


FIRST = [*numeric("x", (None, 2.0, 1.5), (2.0, 5.0, 1.0), (5.0, None, 0.5)), *levels("k", 3.0, a=1.0, b=2.0)]
SECOND = [*numeric("x", (None, 3.0, 2.0), (3.0, None, 4.0)), *levels("k", 0.25, a=0.5, c=7.0)]
THIRD = numeric("x", (None, 1.0, 10.0), (1.0, None, 20.0))


@pytest.fixture(scope="module")
def data(spark):
    rows = [(float(i % 7), "abcd"[i % 4] if i % 5 else None, 1.0 + i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "x double, k string, w double")


def table(spark, rows):
    return spark.createDataFrame(rows, RELATIVITY_SCHEMA)


def test_versions_with_breaks_and_levels_of_their_own(spark, data, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert store.log().count() == 0
    for base, rows in ((10.0, FIRST), (5.0, SECOND), (1.0, THIRD)):
        store.add(table(spark, rows), base, "one more")
    got = {r["version"]: r["total"] for r in store.totals(data, F.col("w")).collect()}
    for version, (base, rows) in enumerate(((10.0, FIRST), (5.0, SECOND), (1.0, THIRD)), 1):
        model = RateModel.from_relativities(table(spark, rows), base)
        scored = model.predict(data, exposure_col="w", output_col="p")
        assert got[version] == pytest.approx(scored.agg(F.sum(F.col("p"))).first()[0])
    assert {r["version"] for r in store.totals(data, versions=[2]).collect()} == {2}


def test_a_number_in_no_range(spark, data):
    holes = data.withColumn("x", F.when(F.col("x") != 3, F.col("x")))
    rates = table(spark, FIRST).withColumn("version", F.lit(1))
    bases = spark.createDataFrame([(1, 10.0)], "version int, base_rate double")
    with pytest.raises(PySparkException, match="falls in no bin"):
        version_totals(holes, rates, bases).collect()
    known = RateModel.from_relativities(table(spark, FIRST), 10.0).predict(holes, exposure_col=None, on_null="null")
    got = version_totals(holes, rates, bases, on_null="null").first()["total"]
    assert got == pytest.approx(known.agg(F.sum("prediction")).first()[0])


def test_the_portfolio_is_read_once(spark, data, tmp_path):
    data.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    sizes = []
    for n in (2, 50):
        rates = table(spark, FIRST).crossJoin(spark.range(1, n + 1).select(F.col("id").cast("int").alias("version")))
        bases = spark.range(1, n + 1).select(F.col("id").cast("int").alias("version"), F.lit(1.0).alias("base_rate"))
        plan = version_totals(read, rates, bases)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [x#") == 1
        sizes.append(len(plan))
    assert abs(sizes[1] - sizes[0]) < 500


def test_two_edits_of_a_row_need_an_order(spark):
    rates = table(spark, FIRST)
    edits = spark.createDataFrame([("k", None, None, "a", 4.0, 1), ("k", None, None, "a", 2.0, 2)], EDITS)
    with pytest.raises(ValueError, match="edited twice"):
        apply_edits(rates, edits)
    with pytest.raises(ValueError, match="edited twice"):
        apply_edits(rates, edits.withColumn("step", F.lit(1)), "step")
    revised, changes, _ = apply_edits(rates, edits, "step")
    assert revised.where("level = 'a'").first()["relativity"] == 2.0
    assert sorted((r["old_relativity"], r["new_relativity"]) for r in changes.collect()) == [(1.0, 4.0), (4.0, 2.0)]


def test_store_refuses_what_it_does_not_have(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"))
    first = store.add(table(spark, FIRST), 1.0, "first")
    with pytest.raises(ValueError, match="no version 7"):
        store.at(7)
    with pytest.raises(ValueError, match="name no row"):
        store.edit(first, spark.createDataFrame([("k", None, None, "nowhere", 4.0, 1)], EDITS), "bad")
    second = store.edit(first, spark.createDataFrame([("k", None, None, None, 4.0, 1)], EDITS), "other")
    (row,) = store.diff(first, second).collect()
    assert (row["variable"], row["level"], row["old_relativity"], row["new_relativity"]) == ("k", None, 3.0, 4.0)
    assert [tuple(r) for r in store.log().orderBy("version").select("version", "parent_version", "n_changes").collect()] == [(1, None, 0), (2, 1, 1)]


@pytest.mark.parametrize("family", ["poisson", "gamma"])
def test_relativities_under_the_log_link_read_no_data(spark, data, tmp_path, family):
    data.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    plan = Blueprint.from_lists({"x": [2.0, 5.0], "k": ["a", "b"]})
    model = fixed_model(family, plan, 0.1, {"x": [0.5, 0.2, 0.0], "k": [0.3, -0.3, 0.0]})
    bare = generate_all_ratetables(model, read, ["x", "k"], include_raw=False)
    assert "parquet" not in bare._jdf.queryExecution().optimizedPlan().toString().lower()
    full = {(r["variable"], r["ord"]): r["relativity"] for r in generate_all_ratetables(model, read, ["x", "k"]).collect()}
    assert {(r["variable"], r["ord"]): r["relativity"] for r in bare.collect()} == pytest.approx(full)
    one = ratetable(model, read, "k", ["a", "b"], include_raw=False)
    assert "parquet" not in one._jdf.queryExecution().optimizedPlan().toString().lower()


def test_versions_are_written(spark, sf_dir):
    """Both sides of a diff read the same doubles, instead of summing them once for each side."""
    rows = one_way_relativities(spark, sf_dir)
    assert rows.inputFiles() and not any("lineitem" in f for f in rows.inputFiles())
