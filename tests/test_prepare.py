import pytest
from pyspark.sql import functions as F

from premia import lump_fun, o_matrix, prepare_data, quote_identifier
from premia.functions.binning import bin_id, lookup_level, lookup_range
from premia.functions.names import column
from premia.operators.prepare import one_hot


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quote_identifier():
    assert quote_identifier("a`b") == "`a``b`"
    with pytest.raises(TypeError):
        quote_identifier(1)
    with pytest.raises(ValueError):
        quote_identifier("  ")


def test_all_null_gives_an_empty_table(spark):
    df = spark.createDataFrame([(None, None)] * 5, "n double, c string")
    out = prepare_data(["n", "c"], df=df, formats={"n": [], "c": []})
    assert out.columns == [] and out.isEmpty()


def test_nulls_take_the_batch_mean_and_other(spark):
    data = [(1.0, "A"), (None, None), (3.0, "C"), (None, None), (None, None)]
    df = spark.createDataFrame(data, "n double, c string")
    out = prepare_data(["n", "c"], df=df, formats={"n": [1.0, 3.0], "c": ["A", "C"]})
    assert out.columns == ["n1.0", "n3.0", "c_lumped"]
    assert rows(out) == [(0, 1, "A"), (0, 1, "Other"), (0, 0, "C"), (0, 1, "Other"), (0, 1, "Other")]


def test_spaces_reserved_words_and_view_names(spark):
    df = spark.createDataFrame([(1.0, "A"), (3.0, "B"), (None, "C")], "`vehicle age` double, `select` string")
    df.createOrReplaceTempView("policy_data")
    out = prepare_data(
        ["vehicle age", "select"], df="policy_data", spark=spark,
        formats={"vehicle age": [2.0], "select": ["A", "B"]},
    )
    assert out.columns == ["vehicle age2.0", "select_lumped"]
    assert [r[1] for r in rows(out)] == ["A", "B", "Other"]
    with pytest.raises(ValueError, match="no table or view"):
        prepare_data(["x"], df="no_such_table", spark=spark)


def test_columns_without_a_plan_pass_through(spark):
    df = spark.createDataFrame([(10,), (20,)], "`raw score` int")
    out = prepare_data(["raw score"], df=df, formats={})
    assert out.columns == ["raw score"] and rows(out) == [(10,), (20,)]


def test_missing_columns_warn_and_lists_are_not_changed(spark):
    df = spark.createDataFrame([(1, 1)], "x int, flag int")
    extra = ["absent"]
    with pytest.warns(UserWarning):
        out = prepare_data(["x", "nope"], extra, "flag", df=df)
    assert out.columns == ["x", "flag"] and extra == ["absent"]


def test_two_breaks_with_one_name_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, x1 double")
    with pytest.raises(ValueError, match="share a name"):
        prepare_data(["x", "x1"], df=df, formats={"x": [11.0], "x1": [1.0]})


def test_nan_and_unfilled_null_are_below_no_break(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    out = df.select(*o_matrix("x", [2.0]))
    assert rows(out) == [(0,), (0,), (1,)]


def test_wrong_arguments():
    for bad in (lambda: o_matrix("x", []), lambda: o_matrix(" ", [1.0]), lambda: lump_fun("x", []),
                lambda: lump_fun("x", [None])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        o_matrix(1, [1.0])


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_lookups_agree_with_a_loop(spark, n):
    breaks = [i * 1.5 for i in range(n)]
    xs = [-1.0, 0.0, 0.7, 1.5, 2.999, 3.0, 1000.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    values = [float(i) * 10 for i in range(n + 1)]
    got = rows(df.select(bin_id(F.col("x"), breaks), lookup_range(F.col("x"), breaks, values)))
    for x, (b, v) in zip(xs, got):
        want = None if x is None else sum(k <= x for k in breaks)
        assert b == want and v == (None if want is None else values[want])


def test_level_lookup_with_many_and_odd_levels(spark):
    levels = ["", "a", "b'c", "É", "z", "ß", "中"] + [f"l{i}" for i in range(40)]
    table = {lv: F.lit(float(i)) for i, lv in enumerate(levels)}
    xs = levels + ["unknown", None]
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    got = [r[0] for r in df.select(lookup_level(F.col("x"), table, F.lit(-1.0))).collect()]
    assert got == [float(i) for i in range(len(levels))] + [-1.0, -1.0]


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    out = one_hot(df, "x", ["a", "b"], drop_first=True)
    assert rows(out) == [("a", 0.0), ("b", 1.0), (None, 0.0)]


def test_dotted_column(spark):
    df = spark.createDataFrame([(1.0,)], "`a.b` double")
    assert df.select(column("a.b")).first()[0] == 1.0
