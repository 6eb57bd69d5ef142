"""Variables with many levels: lookups by join, whatever the size of the table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from premia import RateModel
from premia.operators.evaluate import actual_expected
from premia.operators.levels import LEVEL_SCHEMA, LevelTable, Lookup, attach, broadcast_limit, heavy_levels, small_table
from premia.operators.ratemodel import FromToRow, ModelMetadata, VariableConfig
from premia.session import local_table
from premia.sources.tariff_json import read_tariff, write_tariff

N = 3000


def rows():
    rng = random.Random(4)
    keys = [f"k{rng.randrange(4000)}" for _ in range(3000)] + ["k7"] * 2000 + [None] * 1500 + ["", "k 1", "Other"]
    return [(i, k, 1.0 + i % 3, i % 2) for i, k in enumerate(keys)]


def value(key):
    return 1.0 + int(key[1:]) / 1000 if key and key[1:].isdigit() and int(key[1:]) < N else 0.5


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id long, key string, w double, traintest int")


@pytest.fixture(scope="module")
def table(spark):
    return small_table(spark, {f"k{i}": 1.0 + i / 1000 for i in range(N)}, 0.5)


@pytest.fixture(params=["10485760", "-1"])
def limit(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def tariff(table):
    size = VariableConfig("numeric", (FromToRow(None, 2.0, None, 2.0), FromToRow(2.0, None, None, 3.0)))
    return RateModel(10.0, {"key": table, "w": size}, ModelMetadata(target="w", train_test_col="traintest")).create_snapshot("Base model")


def test_attach(spark, data, table, limit):
    out = attach(data, [Lookup(F.col("key"), table, {"v": "value", "at": "ord"}), Lookup(F.upper("key"), table, {"none": "value"})])
    assert out.columns == [*data.columns, "v", "at", "none"]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows())
    for i, k, *_ in rows():
        known = value(k) != 0.5
        assert got[i]["v"] == value(k) and got[i]["none"] == 0.5
        assert got[i]["at"] == (int(k[1:]) if known else N)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (limit != "-1")


def test_null_and_heavy_rows_are_spread(spark, data):
    assert heavy_levels(data, [F.col("key")]) == [["k7"]]
    keys = data.withColumn("salt", 1 + F.monotonically_increasing_id() % 1024).where("key IS NULL").select("salt").distinct().count()
    assert keys > 500


def test_plan_does_not_grow_with_levels(spark, data, limit):
    sizes = []
    for n in (300, 30_000):
        levels = local_table(spark, [(f"k{i}", i, 1.0) for i in range(n)], LEVEL_SCHEMA)
        model = tariff(LevelTable.write(levels, 1.0))
        plan = model.predict(data, exposure_col=None)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[1] - sizes[0]) < 200


def test_predict_edit_and_versions(spark, data, table, limit):
    model = tariff(table)
    model = model.update_relativity("key", "k7", "k7", 9.0).update_relativity("key", None, None, 0.25).create_snapshot("Second")
    for version in (1, 2):
        got = {r["id"]: r["prediction"] for r in model.predict(data, version=version, exposure_col=None).collect()}
        for i, k, w, _ in rows():
            x = value(k)
            if version == 2:
                x = 9.0 if k == "k7" else 0.25 if x == 0.5 else x
            assert math.isclose(got[i], 10 * x * (2 if w < 2 else 3))
    assert [(c.level, c.old_relativity, c.new_relativity) for c in model.diff(1, 2)] == [(None, 0.5, 0.25), ("k7", 1.007, 9.0)]
    assert set(model.non_constant_variables) == {"key", "w"}
    totals = {r["version"]: r["total"] for r in model.score_versions(data, exposure_col=None).collect()}
    assert totals[1] == pytest.approx(model.predict(data, version=1, exposure_col=None).agg(F.sum("prediction")).first()[0])
    with pytest.raises(ValueError, match="no level"):
        model.update_relativity("key", "nowhere", "nowhere", 1.0)
    assert model.relativity_table(spark).where("variable = 'key'").count() == N + 1
    assert model.version_table(spark).count() == 2 * (N + 3)


def test_report_by_level(spark, data, table):
    report = actual_expected(tariff(table), data, ["key", "w"])
    assert report.count() == (N + 1 + 2) * 3
    last = report.where("variable = 'key' AND subset = 'all' AND level = 'Other / Unknown'").first()
    assert last["ord"] == N and last["exposure"] == sum(value(k) == 0.5 for _, k, *_ in rows())


def test_many_levels_from_relativities_and_back(spark, data, table, tmp_path):
    model = tariff(table).update_relativity("key", "k7", "k7", 9.0).create_snapshot("Second")
    again = RateModel.from_relativities(model.relativity_table(spark), 10.0, model.metadata)
    assert isinstance(again.variables["key"], LevelTable) and again.variables["key"].fallback == 0.5
    write_tariff(spark, model, str(tmp_path / "t"))
    read = read_tariff(spark, str(tmp_path / "t"))
    want = sorted(map(tuple, model.predict(data, exposure_col=None).collect()), key=str)
    for other in (again, read):
        assert sorted(map(tuple, other.predict(data, exposure_col=None).collect()), key=str) == want
    assert [c.level for c in read.diff(1, 2)] == ["k7"]


def test_tables_are_checked(spark):
    with pytest.raises(ValueError, match="once"):
        LevelTable.write(local_table(spark, [("a", 0, 1.0), ("a", 1, 2.0)], LEVEL_SCHEMA), 1.0)
    with pytest.raises(ValueError, match="Null"):
        LevelTable.write(local_table(spark, [(None, 0, 1.0)], LEVEL_SCHEMA), 1.0)
    empty = LevelTable.write(local_table(spark, [], LEVEL_SCHEMA), 7.0)
    assert attach(spark.range(2), [Lookup(F.col("id"), empty, {"v": "value", "o": "ord"})]).collect()[0][1:] == (7.0, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for text, size in (("256k", 1 << 18), ("-1", 0), ("10MB", 10 << 20), ("77", 77), ("3g", 3 << 30)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert broadcast_limit(spark) == size
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream(spark, data, table, tmp_path):
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    scored = tariff(table).predict(stream, exposure_col=None)
    done = scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    done.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(map(tuple, tariff(table).predict(data, exposure_col=None).collect()), key=str)
