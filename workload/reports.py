"""Actual against expected, and error measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.loss import FAMILIES, deviance, mae, rmse
from premia.operators.evaluate import (
    actual_expected,
    compare_actual_expected,
    compute_actual_expected,
    evaluate,
    overall_ratio,
    ratio_by_group,
)
from workload.registry import pf, pf_once, query, r, rs, with_pf
from workload.tariffs import (
    DISCOUNT,
    SEGMENT,
    SIZE,
    ord_sql,
    premium_sql,
    revised_tariff,
    segment_ord_sql,
    tariff,
)


def ranges_values(rows) -> str:
    """Row positions and labels of a numeric variable, as VALUES."""
    out = []
    for i, (a, b, _) in enumerate(rows):
        lo, hi = (None if x is None else float(x) for x in (a, b))
        label = f"< {hi}" if lo is None else f"≥ {lo}" if hi is None else f"[{lo}, {hi})"
        out.append(f"({i}, '{label}')")
    return ", ".join(out)


SEGMENT_VALUES = ", ".join(
    [f"({i}, '{lv}')" for i, (lv, _) in enumerate(SEGMENT)]
    + [f"({len(SEGMENT)}, 'Other / Unknown')"]
)
BINS = {
    "discount": (ranges_values(DISCOUNT), ord_sql(DISCOUNT, "discount")),
    "p_size": (ranges_values(SIZE), ord_sql(SIZE, "p_size")),
    "segment": (SEGMENT_VALUES, segment_ord_sql("segment")),
}

SUBSETS = "subsets(subset, flag) AS (VALUES ('all', NULL), ('train', 1), ('test', 0))"


def ae_sql(variables, actual, expected, exposure, subsets=SUBSETS, extra="", match=None) -> str:
    """A/E per bin and subset; ``match`` says which rows belong to a bin."""
    match = match or "s.ord = b.ord"
    bins = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, * FROM (VALUES {BINS[v][0]}) t(ord, level)" for v in variables
    )
    rows = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {BINS[v][1]} AS ord, traintest, y, p, w{extra} FROM scored"
        for v in variables
    )
    return with_pf(
        f""", scored AS (SELECT *, ClaimNb AS y, Exposure AS w, {premium_sql()} AS p,
             {premium_sql(version=2)} AS p2 FROM pf),
        {subsets}, bins AS ({bins}), placed AS ({rows})
        SELECT b.variable, u.subset, b.ord::INTEGER AS ord, b.level,
          {rs(f'coalesce({actual}, 0)')} AS actual, {rs(f'coalesce({expected}, 0)')} AS expected,
          {rs(f'coalesce({exposure}, 0)', 4)} AS exposure
        FROM bins b CROSS JOIN subsets u LEFT JOIN placed s
          ON s.variable = b.variable AND {match} AND (u.flag IS NULL OR s.traintest = u.flag)
        GROUP BY 1, 2, 3, 4"""
    )


def rounded(ae):
    return ae.withColumns(
        {"actual": r("actual"), "expected": r("expected"), "exposure": r("exposure", 4)}
    )


FORMULA_SQL = {
    "sum_weighted": ("sum(y * w) / sum(w)", "sum(p * w) / sum(w)"),
    "sum_over_weight": ("sum(y) / sum(w)", "sum(p) / sum(w)"),
    "sum_unweighted": ("avg(y)", "avg(p)"),
}


def _ae_query(formula):
    @query(
        f"a5_ae_{formula}", ae_sql(["discount"], *FORMULA_SQL[formula], "sum(w)")
    )
    def run(spark, sf):
        return rounded(compute_actual_expected(tariff(), pf(spark, sf), "discount", formula))

    return run


for _formula in FORMULA_SQL:
    _ae_query(_formula)


@query(
    "a5_ae_without_weight",
    ae_sql(["p_size"], "sum(y)", "sum(p)", "count(s.ord)"),
)
def a5_unweighted(spark, sf):
    model = tariff(weight=False)
    return rounded(model.compute_ae_for_variable(pf(spark, sf), "p_size", "sum_over_weight"))


@query(
    "a5_ae_other_takes_unmatched_rows",
    ae_sql(["segment"], "sum(y) / sum(w)", "sum(p) / sum(w)", "sum(w)"),
)
def a5_other(spark, sf):
    return rounded(compute_actual_expected(tariff(), pf(spark, sf), "segment", "sum_over_weight"))


@query(
    "a5_ae_other_takes_all_rows",
    ae_sql(
        ["segment"], "sum(y) / sum(w)", "sum(p) / sum(w)", "sum(w)",
        match=f"(s.ord = b.ord OR b.ord = {len(SEGMENT)})",
    ),
)
def a5_all_rows(spark, sf):
    return rounded(
        compute_actual_expected(
            tariff(), pf(spark, sf), "segment", "sum_over_weight", other="all_rows"
        )
    )


@query(
    "a6_ae_all_variables",
    ae_sql(["discount", "p_size", "segment"], "sum(y * w) / sum(w)", "sum(p * w) / sum(w)", "sum(w)"),
)
def a6(spark, sf):
    return rounded(actual_expected(tariff(), pf(spark, sf)))


@query(
    "j4_empty_bins",
    ae_sql(["p_size"], "sum(y) / sum(w)", "sum(p) / sum(w)", "sum(w)"),
)
def j4(spark, sf):
    return rounded(actual_expected(tariff(), pf(spark, sf), ["p_size"], "sum_over_weight"))


@query(
    "a7_overall_ratio",
    with_pf(
        f"""SELECT traintest, sum(ClaimNb)::DOUBLE AS actual, {rs(f'sum({premium_sql()})', 4)} AS expected,
        {rs(f'sum(ClaimNb) / sum({premium_sql()})')} AS ae FROM pf GROUP BY 1"""
    ),
)
def a7(spark, sf):
    scored = tariff().predict(pf(spark, sf))
    out = overall_ratio(scored, "ClaimNb", "prediction", ["traintest"])
    return out.withColumns({"expected": r("expected", 4), "ae": r("ae")})


_DECILES = ", ".join(f"{i / 10}" for i in range(1, 10))


@query(
    "a8_ae_by_decile",
    with_pf(
        f""", s AS (SELECT *, {premium_sql()} AS p FROM pf),
        e AS (SELECT unnest(quantile_cont(price, [{_DECILES}])) AS edge FROM pf),
        g AS (SELECT s.*, (SELECT count(*) FROM (SELECT DISTINCT edge FROM e) WHERE edge < price) AS g FROM s)
        SELECT g::INTEGER AS grouping, {rs('sum(ClaimNb) / sum(Exposure)')} AS actual,
        {rs('sum(p) / sum(Exposure)')} AS expected, {rs('sum(Exposure)', 4)} AS exposure,
        {rs('avg(price)', 2)} AS mid,
        {rs('sum(Exposure) / (SELECT sum(Exposure) FROM pf)')} AS exposure_share FROM g GROUP BY 1"""
    ),
)
def a8(spark, sf):
    data = pf_once(spark, sf, "discount", "p_size", "segment", "price", "ClaimNb", "Exposure")
    scored = tariff().predict(data)
    out = ratio_by_group(scored, "price", "ClaimNb", "prediction", "Exposure")
    return out.select(
        "grouping", r("actual").alias("actual"), r("expected").alias("expected"),
        r("exposure", 4).alias("exposure"), r("mid", 2).alias("mid"),
        r("exposure_share").alias("exposure_share"),
    )


@query(
    "a8_ae_by_level",
    with_pf(
        f"""SELECT segment AS level, {rs('sum(ClaimNb) / sum(Exposure)')} AS actual,
        {rs(f'sum({premium_sql()}) / sum(Exposure)')} AS expected, {rs('sum(Exposure)', 4)} AS exposure,
        {rs('sum(Exposure) / (SELECT sum(Exposure) FROM pf)')} AS exposure_share FROM pf GROUP BY 1"""
    ),
)
def a8_level(spark, sf):
    scored = tariff().predict(pf(spark, sf))
    out = ratio_by_group(scored, "segment", "ClaimNb", "prediction", "Exposure")
    return out.select(
        "level", r("actual").alias("actual"), r("expected").alias("expected"),
        r("exposure", 4).alias("exposure"), r("exposure_share").alias("exposure_share"),
    )


@query(
    "a9_ae_two_tariffs",
    with_pf(
        f""", scored AS (SELECT *, {premium_sql()} AS p, {premium_sql(version=2)} AS p2,
             {BINS['discount'][1]} AS o FROM pf WHERE traintest = 1),
        bins(ord, level) AS (VALUES {BINS['discount'][0]})
        SELECT 'discount' AS variable, ord::INTEGER AS ord, level,
        {rs('sum(ClaimNb) / sum(Exposure)')} AS actual, {rs('sum(p) / sum(Exposure)')} AS expected_base,
        {rs('sum(p2) / sum(Exposure)')} AS expected_revised, {rs('sum(Exposure)', 4)} AS exposure
        FROM bins JOIN scored ON ord = o GROUP BY 1, 2, 3"""
    ),
)
def a9(spark, sf):
    out = compare_actual_expected(
        tariff(), revised_tariff(), pf(spark, sf), ["discount"], "sum_over_weight"
    )
    rounds = {c: r(c) for c in ("actual", "expected_base", "expected_revised")}
    return out.withColumns({**rounds, "exposure": r("exposure", 4)})


# A target and a prediction per family, all with the same plain expressions.
TARGETS = {
    "poisson": ("ClaimNb", premium_sql()),
    "gamma": ("severity", "(price / 10 * 1.2::DOUBLE)"),
    "gaussian": ("margin", "(4000.0::DOUBLE + 20 * p_size)"),
    "binomial": ("ClaimNb", "(0.02::DOUBLE + discount / 10)"),
}
DEVIANCE_SQL = {
    "poisson": "2 * avg(CASE WHEN y = 0 THEN q ELSE y * ln(y / q) - (y - q) END)",
    "gamma": "2 * avg((y - q) / q - ln(y / q))",
    "gaussian": "avg((y - q) * (y - q))",
    "binomial": "-2 * avg(y * ln(q) + (1 - y) * ln(1 - q))",
}


def scored(spark, sf, family):
    data = tariff().predict(pf(spark, sf), output_col="premium")
    p = {
        "poisson": F.col("premium"),
        "gamma": F.col("price") / 10 * 1.2,
        "gaussian": 4000.0 + 20 * F.col("p_size"),
        "binomial": 0.02 + F.col("discount") / 10,
    }[family]
    y = F.col(TARGETS[family][0]).cast("double")
    return data.select("traintest", "segment", y.alias("y"), p.alias("q"))


def _digits(family):
    # Sums of large numbers agree to fewer decimals.
    return {"gaussian": 0, "gamma": 6}.get(family, 6), {"gaussian": 3, "gamma": 3}.get(family, 6)


def _deviance_query(number, family):
    d, _ = _digits(family)
    y, p = TARGETS[family]

    @query(
        f"a{number}_{family}_deviance",
        with_pf(
            f", s AS (SELECT segment, {y}::DOUBLE AS y, {p} AS q FROM pf) SELECT segment, "
            f"{rs(DEVIANCE_SQL[family], d)} AS deviance FROM s GROUP BY 1"
        ),
    )
    def run(spark, sf):
        s = scored(spark, sf, family)
        dev = deviance(F.col("y"), F.col("q"), family)
        return s.groupBy("segment").agg(r(dev, d).alias("deviance"))

    return run


for _number, _family in zip((11, 12, 13, 14), FAMILIES):
    _deviance_query(_number, _family)


@query(
    "a15_rmse_mae",
    with_pf(
        f", s AS (SELECT traintest, severity AS y, {TARGETS['gamma'][1]} AS q FROM pf) "
        f"SELECT traintest, {rs('sqrt(avg((y - q) * (y - q)))', 3)} AS rmse, "
        f"{rs('avg(abs(y - q))', 3)} AS mae FROM s GROUP BY 1"
    ),
)
def a15(spark, sf):
    s = scored(spark, sf, "gamma")
    y, p = F.col("y"), F.col("q")
    return s.groupBy("traintest").agg(r(rmse(y, p), 3).alias("rmse"), r(mae(y, p), 3).alias("mae"))


def _metrics_sql():
    parts = []
    for family, (y, p) in TARGETS.items():
        d, e = _digits(family)
        parts.append(
            f"SELECT '{family}' AS family, traintest, {rs(DEVIANCE_SQL[family], d)} AS deviance, "
            f"{rs('sqrt(avg((y - q) * (y - q)))', e)} AS rmse, {rs('avg(abs(y - q))', e)} AS mae "
            f"FROM (SELECT traintest, {y}::DOUBLE AS y, {p} AS q FROM pf) GROUP BY 2"
        )
    return with_pf(" UNION ALL ".join(parts))


@query("a16_metric_sets", _metrics_sql())
def a16(spark, sf):
    out = None
    for family in TARGETS:
        d, e = _digits(family)
        part = evaluate(scored(spark, sf, family), "y", "q", family, ["traintest"]).select(
            F.lit(family).alias("family"), "traintest", r("deviance", d).alias("deviance"),
            r("rmse", e).alias("rmse"), r("mae", e).alias("mae"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a17_median",
    with_pf(
        f", s AS (SELECT nation, sum(ClaimNb) / sum(Exposure) AS rate FROM pf GROUP BY 1) "
        f"SELECT nation, {rs('rate')} AS rate, {rs('rate / (SELECT median(rate) FROM s)')} AS relativity FROM s"
    ),
)
def a17(spark, sf):
    rates = pf(spark, sf).groupBy("nation").agg(
        (F.sum("ClaimNb") / F.sum("Exposure")).alias("rate")
    )
    median = rates.agg(F.median("rate")).scalar()
    return rates.select(
        "nation", r("rate").alias("rate"), r(F.try_divide(F.col("rate"), median)).alias("relativity")
    )


@query(
    "o1_sorted_report",
    with_pf(
        f"SELECT segment, {rs('sum(ClaimNb) / sum(Exposure)')} AS rate FROM pf GROUP BY 1 ORDER BY 1"
    ),
)
def o1(spark, sf):
    rate = F.try_divide(F.sum("ClaimNb"), F.sum("Exposure"))
    return pf(spark, sf).groupBy("segment").agg(r(rate).alias("rate")).orderBy("segment")
