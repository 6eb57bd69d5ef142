"""Variables with many levels, fits of many features, checked folds, and stores of versions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from premia.functions.names import column
from premia.functions.split import hash32
from premia.operators import kernels
from premia.operators.blueprint import generate_blueprint
from premia.operators.evaluate import actual_expected
from premia.operators.glm import TrainingCells, alpha_max, fit_glm
from premia.operators.prepare import prepare_data
from premia.operators.ratemodel import ModelMetadata, RateModel
from premia.operators.ratetable import LEVEL_COLUMN, ratetable
from premia.operators.relativities import RELATIVITY_COLUMNS, apply_edits
from premia.operators.validate import flag_report
from premia.operators.versions import VersionStore
from premia.plans.portfolio import read_table
from premia.session import ScratchTable, scratch_path, short_methods
from workload.binning import quantile_sql
from workload.models import ROLES, SEGMENT_PLAN, roles
from workload.ratings import ONE_WAY_SQL, one_way_relativities
from workload.registry import pf, pf_once, query, r, rs, with_pf
from workload.scans import _FLAG
from workload.tariffs import effects_model, eta_sql

# ------------------------------------------------------------- many levels by join

# One relativity per part number seen in training; holdout rows have unknown ones, and some have none.
PARTS_SQL = """
, keyed AS (SELECT *, CASE WHEN l_orderkey % 17 <> 0 THEN l_partkey::VARCHAR END AS part FROM pf),
seen AS (SELECT avg(severity) AS overall FROM keyed WHERE traintest = 1 AND part IS NOT NULL AND l_partkey % 5 <> 0),
rates AS (SELECT part, avg(severity) / any_value(overall) AS rel FROM keyed, seen
          WHERE traintest = 1 AND part IS NOT NULL AND l_partkey % 5 <> 0 GROUP BY 1)
"""
OTHER_PART = 0.75


def _parts(spark, sf, *columns):
    part = F.when(F.col("l_orderkey") % 17 != 0, F.col("l_partkey").cast("string"))
    needed = dict.fromkeys(["l_partkey", "traintest", "severity", *columns])
    return pf_once(spark, sf, *needed, part.alias("part"))


def _part_tariff(data) -> RateModel:
    """A tariff of all part numbers but every fifth, with a row for everything else."""
    known = data.where("traintest = 1 AND part IS NOT NULL AND l_partkey % 5 <> 0")
    overall = known.agg(F.avg("severity")).scalar()
    none = F.lit(None).cast("double")
    rates = known.groupBy(F.col("part").alias("level")).agg((F.avg("severity") / overall).alias("relativity"))
    rows = rates.select(
        F.lit("part").alias("variable"), F.lit("categorical").alias("kind"), F.col("level").cast("int").alias("ord"),
        none.alias("from_d"), none.alias("to_d"), "level", "relativity",
    )
    other = data.sparkSession.range(1).select(
        F.lit("part").alias("variable"), F.lit("categorical").alias("kind"), F.lit(1 << 30).alias("ord"),
        none.alias("from_d"), none.alias("to_d"), F.lit(None).cast("string").alias("level"), F.lit(OTHER_PART).alias("relativity"),
    )
    meta = ModelMetadata("gamma", "severity", "Exposure", "Exposure", "traintest", ("part",))
    return RateModel.from_relativities(rows.unionByName(other), 100.0, meta)


@query(
    "j1_many_levels",
    with_pf(
        PARTS_SQL + f"""SELECT l_orderkey, l_linenumber, k.part, {rs(f'coalesce(rel, {OTHER_PART})')} AS relativity
        FROM keyed k LEFT JOIN rates USING (part)"""
    ),
)
def j1_many(spark, sf):
    data = _parts(spark, sf, "l_orderkey", "l_linenumber")
    model = _part_tariff(data)
    return model.predict(data, exposure_col=None).select(
        "l_orderkey", "l_linenumber", "part", r(F.col("prediction") / 100).alias("relativity")
    )


@query(
    "r7_many_levels",
    with_pf(
        PARTS_SQL + f"""SELECT segment, {rs(f'sum(100 * coalesce(rel, {OTHER_PART}) * Exposure)', 2)} AS premium,
        count(*) FILTER (rel IS NULL)::BIGINT AS n_other FROM keyed LEFT JOIN rates USING (part) GROUP BY 1"""
    ),
)
def r7_many(spark, sf):
    data = _parts(spark, sf, "segment", "Exposure")
    model = _part_tariff(data)
    scored, places = model.predict_placed(data, ["part"])
    last = model.variables["part"].last
    return scored.groupBy("segment").agg(
        r(F.sum("prediction"), 2).alias("premium"), F.count_if(places["part"] == last).alias("n_other")
    )


@query(
    "a5_many_levels",
    with_pf(
        PARTS_SQL + f""", rows AS (SELECT CASE WHEN rel IS NULL THEN 'Other / Unknown' ELSE part END AS level, severity,
          Exposure, 100 * coalesce(rel, {OTHER_PART}) * Exposure AS p FROM keyed LEFT JOIN rates USING (part))
        SELECT level, {rs('sum(severity) / sum(Exposure)', 3)} AS actual, {rs('sum(p) / sum(Exposure)', 3)} AS expected,
        {rs('sum(Exposure)')} AS exposure FROM rows GROUP BY 1"""
    ),
)
def a5_many(spark, sf):
    data = _parts(spark, sf, "Exposure")
    report = actual_expected(_part_tariff(data), data, ["part"], "sum_over_weight").where("subset = 'all'")
    return report.select("level", r("actual", 3).alias("actual"), r("expected", 3).alias("expected"), r("exposure").alias("exposure"))


@query(
    "p11_threshold_zero",
    with_pf(
        """, lv AS (SELECT DISTINCT l_partkey::VARCHAR AS level FROM pf WHERE traintest = 1)
        SELECT 'part' AS variable, 'categorical' AS kind, (row_number() OVER (ORDER BY level) - 1)::INTEGER AS ord, level FROM lv"""
    ),
)
def p11_zero(spark, sf):
    data = pf_once(spark, sf, F.col("l_partkey").cast("string").alias("part"), "traintest")
    plan = generate_blueprint(data.where("traintest = 1"), ["part"], threshold=0.0)
    return plan.to_dataframe(spark).drop("break")


@query(
    "p12_many_levels",
    with_pf(
        """, lv AS (SELECT DISTINCT part FROM (SELECT l_partkey::VARCHAR AS part FROM pf WHERE traintest = 1 AND l_partkey % 3 <> 0)),
        o AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS pos FROM lv), n AS (SELECT count(*) AS n FROM lv)
        SELECT coalesce(pos, n)::INTEGER AS part_bin, count(*)::BIGINT AS n_rows FROM pf LEFT JOIN o ON l_partkey::VARCHAR = part, n GROUP BY 1"""
    ),
)
def p12_many(spark, sf):
    data = pf_once(spark, sf, F.col("l_partkey").cast("string").alias("part"), "l_partkey", "traintest")
    plan = generate_blueprint(data.where("traintest = 1 AND l_partkey % 3 <> 0"), ["part"], threshold=0.0)
    bins = prepare_data(["part"], df=data, formats=plan, encoding="bins")
    return bins.groupBy("part_bin").agg(F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------- fits of many features

MORE = 28
WIDE = ["discount", "p_size", "segment", "brand", *(f"x{i}_" for i in range(MORE))]
_EXTRA_SQL = ", ".join(f"((l_orderkey * {2 * i + 3} + l_linenumber * {i + 5} + l_partkey) % {40 + i})::DOUBLE AS x{i}_" for i in range(MORE))


def _wide(spark, sf, *columns):
    """Columns of the portfolio, and those computed from its keys; only the portfolio's are written."""
    extra = {
        f"x{i}_": ((F.col("l_orderkey") * (2 * i + 3) + F.col("l_linenumber") * (i + 5) + F.col("l_partkey")) % (40 + i)).cast("double")
        for i in range(MORE)
    }
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    base = pf_once(spark, sf, *dict.fromkeys([*(c for c in columns if c not in extra), *keys]))
    return base.withColumns(extra).select(*columns)


def _optimality(family: str, l1_ratio: float, share: float):
    """Optimality of the fit, per predictor, on raw rows and columns of their own."""
    numeric = [v for v in WIDE if v not in ("segment", "brand")]
    breaks = quantile_sql(numeric).replace("FROM pf ", "FROM wide ")

    @query(
        f"m1_wide_optimality_{family}",
        with_pf(
            f""", wide AS (SELECT *, {_EXTRA_SQL} FROM pf), {breaks}
            SELECT variable, count(*)::BIGINT AS n_features, 0::BIGINT AS n_violations FROM brk GROUP BY 1 UNION ALL
            SELECT 'segment', count(DISTINCT segment) + 1, 0 FROM wide WHERE traintest = 1 UNION ALL
            SELECT 'brand', count(DISTINCT brand) + 1, 0 FROM wide WHERE traintest = 1"""
        ),
    )
    def run(spark, sf):
        # Whole stages of so many columns would be methods the JVM never compiles.
        with short_methods(spark):
            return checked(spark, sf)

    def checked(spark, sf):
        # Read several times, so the joins behind it run once.
        target, weight, divide = ROLES[family]
        needed = dict.fromkeys([*WIDE, target, *([weight] if weight else []), "traintest"])
        data = _wide(spark, sf, *needed)
        plan = generate_blueprint(data.where("traintest = 1"), WIDE, threshold=0.0, few_values=True)
        # The largest penalty and the fit ask the same cells.
        cells = TrainingCells.build(data, target, family, WIDE, plan, **roles(family))
        try:
            top = alpha_max(data, target, family, WIDE, plan, cells=cells, **roles(family)).agg(F.max("alpha")).first()[0]
            alpha = top * share
            model = fit_glm(
                data, target, family, WIDE, plan, use_cv=False, alpha=alpha, l1_ratio=l1_ratio, cv_params={"solver": "active"}, cells=cells,
                **roles(family),
            )
        finally:
            cells.close()
        w = column(weight) if weight else F.lit(1.0)
        y = F.col(target) / w if divide else F.col(target)
        slope = 1 / F.col("fitted") if family == "gamma" else F.lit(1.0)
        scored = model.predict(data.where("traintest = 1"), "fitted").withColumns({"w": w, "resid": w * (y - F.col("fitted")) * slope})
        # Sums per predictor and raw value, in one pass; a feature is the sum of the values it holds.
        own = {v: plan[v].kind == "numeric" for v in WIDE}
        raw = [column(v).cast("double" if own[v] else "string").alias(v) for v in WIDE]
        sums_by_value = scored.select(*raw, F.col("w").cast("double"), F.col("resid").cast("double")).mapInArrow(
            kernels.value_sums_task(WIDE, ["w", "resid"]), "variable string, x double, level string, w double, resid double"
        )
        by_value: dict[str, list] = {v: [] for v in WIDE}
        for row in sums_by_value.groupBy("variable", "x", "level").agg(F.sum("w").alias("w"), F.sum("resid").alias("resid")).collect():
            by_value[row["variable"]].append(row)
        total = sum(row["w"] for row in by_value[WIDE[0]])
        found, sums = {v: [0, 0] for v in WIDE}, {}
        for v in WIDE:
            names = [f.name for f in model.features if f.variable == v]
            for k, name in enumerate(names):
                held = [
                    row for row in by_value[v]
                    if (row["x"] is not None and row["x"] < plan[v].breaks[k] if own[v] else row["level"] == name[len(v) + 8 : -1])
                ]
                sums[name] = (sum(row["resid"] for row in held) / total, sum(row["w"] for row in held) / total)
        for f, b in zip(model.features, model.coef):
            found[f.variable][0] += 1
            g, m = sums[f.name]
            sd = math.sqrt(max(m * (1 - m), 0.0))
            if sd < 1e-9:
                continue
            inner = g / sd - alpha * (1 - l1_ratio) * b * sd
            limit = alpha * l1_ratio
            gap = abs(inner) - limit if b == 0 else abs(inner - math.copysign(limit, b))
            found[f.variable][1] += int(gap > 1e-6 * top)
        return spark.createDataFrame([(v, n, bad) for v, (n, bad) in found.items()], "variable string, n_features bigint, n_violations bigint")

    return run


for _family, _rho, _share in (("poisson", 1.0, 0.1), ("gamma", 0.8, 0.05)):
    _optimality(_family, _rho, _share)


# ------------------------------------------------------------------------ checked folds

FOLDS = 4
# Deviance per row of a target y and a mean m, with weight w.
_DEVIANCE = {
    "poisson": "2 * w * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - y + m)",
    "gamma": "2 * w * (y / m - 1 - ln(y / m))",
    "gaussian": "w * (y - m) * (y - m)",
    "binomial": "-2 * w * (y * ln(m) + (1 - y) * ln(1 - m))",
}


def _held_out_sql(family: str) -> str:
    target, weight, divide = ROLES[family]
    w = weight or "1.0::DOUBLE"
    y = f"{target} / {w}" if divide else target
    return f"""SELECT '{family}' AS family, fold, sum(dev) / sum(w) AS held_out_deviance, sum(w) AS held_out_weight FROM (
      SELECT fold, w, {_DEVIANCE[family]} AS dev FROM (
        SELECT a.fold, a.w, a.y, b.m FROM (SELECT h4 AS fold, segment, {w} AS w, ({y})::DOUBLE AS y FROM folded) a
        JOIN (SELECT f.fold, segment, sum({w} * ({y})) / sum({w}) AS m FROM folded, (SELECT unnest(range({FOLDS})) AS fold) f
              WHERE h4 <> f.fold GROUP BY 1, 2) b ON a.fold = b.fold AND a.segment = b.segment)) GROUP BY 1, 2"""


@query(
    "m3_held_out_deviance",
    with_pf(
        f""", folded AS (SELECT *, ('0x' || substr(md5(concat_ws('-', l_linenumber, l_orderkey)), 1, 8))::BIGINT % {FOLDS} AS h4
          FROM pf WHERE traintest = 1), all_families AS ({' UNION ALL '.join(_held_out_sql(f) for f in ROLES)})
        SELECT family, fold::INTEGER AS fold, {rs('held_out_deviance', 4)} AS held_out_deviance,
        {rs('held_out_weight', 4)} AS held_out_weight, true AS converged FROM all_families"""
    ),
)
def m3_held_out(spark, sf):
    """Without a penalty one factor's fits are its means by level, so every fold has a closed form."""
    needed = dict.fromkeys(["segment", "traintest", *[c for target, weight, _ in ROLES.values() for c in (target, weight) if c]])
    fold = hash32(F.col("l_linenumber"), F.col("l_orderkey")) % FOLDS
    data = pf_once(spark, sf, *needed, fold.alias("fold"))
    out = None
    for family in ROLES:
        model = fit_glm(
            data, ROLES[family][0], family, ["segment"], SEGMENT_PLAN, fold_col="fold", drop_first=True,
            cv_params={"cv": FOLDS, "alphas": [0.0], "l1_ratio": [1.0]}, **roles(family),
        )
        part = model.fold_table(spark).select(
            F.lit(family).alias("family"), "fold", r("held_out_deviance", 4).alias("held_out_deviance"),
            r("held_out_weight", 4).alias("held_out_weight"), "converged",
        )
        out = part if out is None else out.unionByName(part)
    return out


# -------------------------------------------------------------------- stores of versions

MANY = 50


def _one_way(spark, sf):
    """One-way relativities and a row for everything else, which a tariff needs."""
    rows = one_way_relativities(spark, sf)
    other = rows.select("variable", "kind").distinct().select(
        "variable", "kind", F.lit(1000).alias("ord"), *[F.lit(None).cast(t).alias(c) for c, t in (("from_d", "double"), ("to_d", "double"), ("level", "string"))],
        F.lit(1.0).alias("relativity"),
    )
    return rows.unionByName(other).select(*RELATIVITY_COLUMNS)


def _store(spark, sf) -> VersionStore:
    """Version 1 from the data, 2 with three edits of it, 3 with one level edited twice."""
    store = VersionStore(spark, scratch_path(spark, "versions"))
    first = store.add(_one_way(spark, sf), 0.1, "one-way")
    schema = "variable string, from_d double, to_d double, level string, new_relativity double, step int"
    rows = [("segment", None, None, "BUILDING", 1.25, 1), ("priority", None, None, "1-URGENT", 0.9, 1), ("segment", None, None, None, 2.0, 1)]
    second = store.edit(first, spark.createDataFrame(rows, schema), "edited", "step")
    rows = [("segment", None, None, "BUILDING", 3.0, 1), ("segment", None, None, "BUILDING", 0.5, 2)]
    store.edit(second, spark.createDataFrame(rows, schema), "edited twice", "step")
    return store


@query(
    "r9_version_store",
    with_pf(
        ONE_WAY_SQL + f""", v1 AS (SELECT * FROM o UNION ALL SELECT 'segment', NULL, 1.0 UNION ALL SELECT 'priority', NULL, 1.0),
        v2 AS (SELECT variable, level, CASE WHEN variable = 'segment' AND level = 'BUILDING' THEN 1.25
          WHEN variable = 'priority' AND level = '1-URGENT' THEN 0.9 WHEN variable = 'segment' AND level IS NULL THEN 2.0 ELSE rel END AS rel FROM v1),
        v3 AS (SELECT variable, level, CASE WHEN variable = 'segment' AND level = 'BUILDING' THEN 0.5 ELSE rel END AS rel FROM v2)
        SELECT 3 AS version, 'edited twice' AS description, 2 AS parent_version, 2::BIGINT AS n_changes, a.variable, a.level,
        {rs('a.rel')} AS old_relativity, {rs('c.rel')} AS new_relativity
        FROM v1 a JOIN v3 c ON a.variable = c.variable AND a.level IS NOT DISTINCT FROM c.level WHERE a.rel <> c.rel"""
    ),
)
def r9_store(spark, sf):
    store = _store(spark, sf)
    log = store.log().where("version = 3").select("version", "description", "parent_version", "n_changes")
    changed = store.diff(1, 3).select(
        "variable", "level", r("old_relativity").alias("old_relativity"), r("new_relativity").alias("new_relativity")
    )
    return log.crossJoin(changed)


@query(
    "r10_many_versions",
    with_pf(
        ONE_WAY_SQL + f""", n(version) AS (SELECT unnest(range(1, {MANY + 1}))),
        p AS (SELECT n.version, a.rel * (1 + n.version * 0.01) AS s, b.rel AS q, Exposure FROM pf
          JOIN o a ON a.variable = 'segment' AND a.level = pf.segment JOIN o b ON b.variable = 'priority' AND b.level = pf.priority, n)
        SELECT version::INTEGER AS version, {rs('sum((0.1::DOUBLE + version * 0.001::DOUBLE) * s * q * Exposure)', 4)} AS total FROM p GROUP BY 1"""
    ),
)
def r10_many(spark, sf):
    """Fifty versions, each with its own base rate and factor on one variable; one scan of the portfolio."""
    from premia.operators.versions import version_totals

    first = _one_way(spark, sf)
    numbers = spark.range(1, MANY + 1).select(F.col("id").cast("int").alias("version"))
    up = F.when((F.col("variable") == "segment") & F.col("level").isNotNull(), 1 + F.col("version") * 0.01).otherwise(1.0)
    rates = first.crossJoin(F.broadcast(numbers)).withColumn("relativity", F.col("relativity") * up)
    bases = numbers.withColumn("base_rate", 0.1 + F.col("version") * 0.001)
    totals = version_totals(pf(spark, sf), rates, bases, F.col("Exposure"))
    return totals.withColumn("total", r("total", 4))


EDIT_STEPS = [("BUILDING", 3.0, 1), ("BUILDING", 0.5, 2), ("MACHINERY", 0.25, 1), ("MACHINERY", 2.0, 2)]


@query(
    "r8_edits_in_order",
    with_pf(
        ONE_WAY_SQL + f""", e(level, new, step) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE, {c})" for a, b, c in EDIT_STEPS)}),
        logged AS (SELECT level, step, coalesce(lag(new) OVER (PARTITION BY level ORDER BY step), rel) AS old, new,
          last_value(new) OVER (PARTITION BY level ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
          FROM e JOIN o USING (level) WHERE variable = 'segment')
        SELECT level, {rs('old')} AS old_relativity, {rs('new')} AS new_relativity, {rs('last')} AS relativity FROM logged"""
    ),
)
def r8_in_order(spark, sf):
    """Rows edited twice, once falling and once rising: the last step holds, and each is logged."""
    rows = [("segment", None, None, lv, x, step) for lv, x, step in EDIT_STEPS]
    steps = spark.createDataFrame(rows, "variable string, from_d double, to_d double, level string, new_relativity double, step int")
    revised, changes, _ = apply_edits(one_way_relativities(spark, sf), steps, "step")
    return changes.join(revised.select("variable", "level", "relativity"), ["variable", "level"]).select(
        "level", r("old_relativity").alias("old_relativity"), r("new_relativity").alias("new_relativity"), r("relativity").alias("relativity")
    )


# ------------------------------------------------------------------ reports and hooks


@query(
    "p3_flag_report",
    f"""SELECT flag, count(*)::BIGINT AS n FROM (SELECT ({_FLAG.replace('THEN 2', 'THEN o_orderkey')})::INTEGER AS flag FROM orders)
    WHERE flag NOT IN (0, 1) GROUP BY 1""",
)
def p3_report(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("flag", F.expr(_FLAG.replace("THEN 2", "THEN o_orderkey")).cast("int"))
    return flag_report(orders, "flag")


_HOOK_SIZES = (5.0, 15.0, 30.0)


@query(
    "r1_prepared_rate_table",
    with_pf(
        f""", lv(size) AS (VALUES {', '.join(f'({s}::DOUBLE)' for s in _HOOK_SIZES)}), low AS (SELECT min(tax_null) AS t, max(p_size) AS top FROM pf),
        p AS (SELECT size, exp({eta_sql(size='least(size * 2, top)', tax='t', segment="'BUILDING'")}) AS p FROM lv, low)
        SELECT size AS p_size, {rs('p / (SELECT median(p) FROM p)')} AS relativity FROM p"""
    ),
)
def r1_prepared(spark, sf):
    """A hook between the levels and the model, which reads the portfolio through a view."""
    pf(spark, sf).createOrReplaceTempView("hooked_portfolio")
    data = spark.table("hooked_portfolio")

    def prepare(rows):
        bounds = data.agg(F.min("tax_null").alias("t"), F.max("p_size").alias("top"))
        joined = rows.drop("tax_null", "segment_null").crossJoin(F.broadcast(bounds))
        return joined.withColumns(
            {"p_size": F.least(F.col(LEVEL_COLUMN) * 2, F.col("top").cast("double")), "tax_null": F.col("t"), "segment_null": F.lit("BUILDING")}
        )

    table = ratetable(effects_model(), data, "p_size", _HOOK_SIZES, prepare=prepare, include_raw=False)
    return table.select("p_size", r("relativity").alias("relativity"))


