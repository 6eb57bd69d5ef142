"""Rate tables and tariffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.names import column
from premia.operators.ratemodel import RateModel, create_rate_model, join_relativities
from premia.operators.ratetable import (
    generate_all_ratetables,
    ratetable,
    reference_row,
    with_reference,
)
from premia.operators.relativities import (
    apply_edits,
    comparison_table,
    diff_versions,
    relativity_rows,
    signal_variables,
)
from premia.session import ScratchTable, scratch_path
from premia.sources.tariff_json import read_tariff, read_tariff_tables, write_tariff
from premia.streaming.scoring import read_stream, score_stream, write_scored
from workload.binning import KEYS, KEYS_SQL
from workload.registry import pf, query, r, rs, with_pf
from workload.tariffs import (
    DISCOUNT,
    PLAN,
    SIZE,
    case_sql,
    effects_model,
    eta_sql,
    ord_sql,
    premium_sql,
    revised_tariff,
    tariff,
)

SIZES = (10.0, 25.0, 40.0)


def _md5_key():
    return F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))


# The row of the smallest hash; the values it is read for break ties.
REFERENCE = (
    "ref AS (SELECT tax_null, p_size, segment_null FROM pf ORDER BY md5(concat_ws('-', l_orderkey, "
    "l_linenumber, l_partkey)), tax_null NULLS FIRST, p_size, segment_null NULLS FIRST LIMIT 1)"
)
SIZE_LEVELS = f"lv(size) AS (VALUES {', '.join(f'({s}::DOUBLE)' for s in SIZES)})"


def _reference(data):
    return reference_row(data, ["tax_null", "p_size", "segment_null"], _md5_key())


@query(
    "j3_levels_by_reference_row",
    with_pf(
        f", {REFERENCE}, {SIZE_LEVELS} SELECT size AS p_size, tax_null, segment_null FROM lv CROSS JOIN ref"
    ),
)
def j3(spark, sf):
    levels = spark.createDataFrame([(s,) for s in SIZES], "size double")
    full = with_reference(
        levels, _reference(pf(spark, sf)), ["tax_null", "p_size", "segment_null"],
        {"p_size": F.col("size")},
    )
    return full.drop("size")


def _ratetable(family, inverse):
    @query(
        f"r1_rate_table_{family}",
        with_pf(
            f""", {REFERENCE}, {SIZE_LEVELS},
            p AS (SELECT size, {inverse.format(eta_sql(size='size'))} AS p FROM lv CROSS JOIN ref)
            SELECT size AS p_size, {rs('p / (SELECT median(p) FROM p)')} AS relativity,
            {rs('p')} AS prediction FROM p"""
        ),
    )
    def run(spark, sf):
        data = pf(spark, sf)
        table = ratetable(
            effects_model(family), data, "p_size", SIZES, reference=_reference(data)
        )
        return table.select(
            "p_size", r("relativity").alias("relativity"), r("prediction").alias("prediction")
        )

    return run


for _family, _inverse in (("poisson", "exp({})"), ("binomial", "1 / (1 + exp(-({})))")):
    _ratetable(_family, _inverse)


def _all_rates_sql(select: str) -> str:
    parts = []
    for v in PLAN:
        for i, x in enumerate(PLAN[v].breaks or PLAN[v].levels):
            kind = PLAN[v].kind
            lit = f"{x}::DOUBLE" if kind == "numeric" else f"'{x}'"
            name = {"tax_null": "tax", "p_size": "size", "segment_null": "segment"}[v]
            parts.append(
                f"SELECT '{v}' AS variable, '{kind}' AS kind, {i} AS ord, "
                f"{lit if kind == 'numeric' else 'NULL::DOUBLE'} AS \"break\", "
                f"{'NULL' if kind == 'numeric' else lit} AS level, "
                f"exp({eta_sql(**{name: lit})}) AS p FROM ref"
            )
    return with_pf(
        f""", {REFERENCE}, p AS ({' UNION ALL '.join(parts)}),
        rates AS (SELECT *, p / median(p) OVER (PARTITION BY variable) AS rel FROM p) {select}"""
    )


@query(
    "r2_all_rate_tables",
    _all_rates_sql(
        f'SELECT variable, kind, ord, "break", level, {rs("p")} AS prediction, {rs("rel")} AS relativity FROM rates'
    ),
)
def r2(spark, sf):
    data = pf(spark, sf)
    rates = generate_all_ratetables(
        effects_model(), data, list(PLAN), reference=_reference(data)
    )
    return rates.withColumns({"prediction": r("prediction"), "relativity": r("relativity")})


RELATIVITY_SQL = f"""
SELECT variable, kind, (ord + 1)::INTEGER AS ord, "break" AS from_d,
  lead("break") OVER (PARTITION BY variable ORDER BY ord) AS to_d, NULL AS level, {rs('rel')} AS relativity
FROM rates WHERE kind = 'numeric'
UNION ALL SELECT variable, kind, 0, NULL, "break", NULL, {rs('rel')} FROM rates WHERE kind = 'numeric' AND ord = 0
UNION ALL SELECT variable, kind, ord, NULL, NULL, level, {rs('rel')} FROM rates WHERE kind = 'categorical'
UNION ALL SELECT variable, kind, max(ord) + 1, NULL, NULL, NULL, 1.0 FROM rates
  WHERE kind = 'categorical' GROUP BY 1, 2
"""


def _rates(spark, sf):
    data = pf(spark, sf)
    return generate_all_ratetables(effects_model(), data, list(PLAN), reference=_reference(data))


@query("r3_numeric_rows", _all_rates_sql(f"SELECT * FROM ({RELATIVITY_SQL}) WHERE kind = 'numeric'"))
def r3(spark, sf):
    rows = relativity_rows(PLAN.to_dataframe(spark), _rates(spark, sf))
    return rows.where("kind = 'numeric'").withColumn("relativity", r("relativity"))


@query(
    "r4_categorical_rows",
    _all_rates_sql(f"SELECT * FROM ({RELATIVITY_SQL}) WHERE kind = 'categorical'"),
)
def r4(spark, sf):
    rows = relativity_rows(PLAN.to_dataframe(spark), _rates(spark, sf))
    return rows.where("kind = 'categorical'").withColumn("relativity", r("relativity"))


@query("r5_rate_model", _all_rates_sql(RELATIVITY_SQL))
def r5(spark, sf):
    model = RateModel.from_rate_tables(_rates(spark, sf), PLAN, 0.1)
    return model.switch_to(1).relativity_table(spark).withColumn("relativity", r("relativity"))


@query("r6_rate_model_from_fit", _all_rates_sql(RELATIVITY_SQL))
def r6(spark, sf):
    model = RateModel.from_glm_model(effects_model(), pf(spark, sf), base_rate=0.1)
    return model.relativity_table(spark).withColumn("relativity", r("relativity"))


@query("s5_tariff_json", _all_rates_sql(RELATIVITY_SQL))
def s5(spark, sf):
    path = scratch_path(spark, "tariff")
    create_rate_model(_rates(spark, sf), PLAN, 0.1, save_to=path, spark=spark)
    rows = read_tariff_tables(spark, path)["relativity"]
    return rows.drop("source").withColumn("relativity", r("relativity"))


@query(
    "r7_score",
    with_pf(f"SELECT {KEYS_SQL}, {rs(premium_sql() + ' * Exposure', 9)} AS prediction FROM pf"),
)
def r7(spark, sf):
    scored = tariff(exposure=True).predict(pf(spark, sf))
    return scored.select(*KEYS, r("prediction", 9).alias("prediction"))


@query(
    "r7_score_without_exposure",
    with_pf(
        f"SELECT {KEYS_SQL}, {rs(premium_sql('segment_null'), 9)} AS prediction FROM pf"
    ),
)
def r7_plain(spark, sf):
    model = tariff(exposure=True, segment="segment_null")
    scored = model.predict(pf(spark, sf), exposure_col=None)
    return scored.select(*KEYS, r("prediction", 9).alias("prediction"))


@query(
    "r7_score_with_column_map",
    with_pf(f"SELECT {KEYS_SQL}, {rs(premium_sql() + ' * Exposure', 9)} AS prediction FROM pf"),
)
def r7_map(spark, sf):
    data = pf(spark, sf).withColumnsRenamed({"discount": "rebate", "Exposure": "years"})
    scored = tariff(exposure=True).predict(
        data, column_map={"rebate": "discount", "years": "Exposure"}
    )
    return scored.select(*KEYS, r("prediction", 9).alias("prediction"))


@query(
    "r7_score_null_as_mean",
    with_pf(
        f""", f AS (SELECT *, coalesce(tax_null, avg(tax_null) OVER ()) AS t FROM pf)
        SELECT {KEYS_SQL}, {rs(f"2.0::DOUBLE * {case_sql(DISCOUNT, 't')}")} AS prediction,
        {rs(f"2.0::DOUBLE * CASE WHEN tax_null IS NOT NULL THEN {case_sql(DISCOUNT, 'tax_null')} END")}
          AS or_null FROM f"""
    ),
)
def r7_null(spark, sf):
    config = tariff().variables["discount"]
    model = RateModel(2.0, {"tax_null": config})
    scored = model.predict(pf(spark, sf), on_null="mean")
    scored = model.predict(scored, on_null="null", output_col="or_null")
    return scored.select(*KEYS, r("prediction").alias("prediction"), r("or_null").alias("or_null"))


@query(
    "r7_score_by_join",
    with_pf(f"SELECT {KEYS_SQL}, {case_sql(SIZE, 'p_size')} AS relativity FROM pf"),
)
def r7_join(spark, sf):
    model = tariff()
    joined = join_relativities(pf(spark, sf), model, "p_size", model.relativity_table(spark))
    return joined.select(*KEYS, "relativity")


@query(
    "r7_score_stream",
    f"""SELECT l_linenumber, count(*)::BIGINT AS n,
    {rs(f"sum(0.1::DOUBLE * {case_sql(DISCOUNT, 'l_discount')} * (l_quantity / 50))", 4)} AS premium
    FROM lineitem GROUP BY 1""",
)
def r7_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    stream = read_stream(spark, f"{sf}/lineitem.parquet*", schema)
    stream = stream.withColumn("Exposure", F.col("l_quantity") / 50)
    config = tariff().variables["discount"]
    model = RateModel(0.1, {"l_discount": config})
    scored = score_stream(stream, model, exposure_col="Exposure")
    out = scratch_path(spark, "scored")
    write_scored(scored, out, scratch_path(spark, "progress")).awaitTermination()
    return (
        spark.read.parquet(out)
        .groupBy("l_linenumber")
        .agg(F.count(F.lit(1)).alias("n"), r(F.sum("prediction"), 4).alias("premium"))
    )


# One-way relativities of the data as the tariff to edit.
ONE_WAY_SQL = f"""
, t AS (SELECT sum(ClaimNb) / sum(Exposure) AS total FROM pf),
o AS (SELECT 'segment' AS variable, segment AS level, sum(ClaimNb) / sum(Exposure) / any_value(total) AS rel
      FROM pf, t GROUP BY 2 UNION ALL
      SELECT 'priority', priority, sum(ClaimNb) / sum(Exposure) / any_value(total) FROM pf, t GROUP BY 2)
"""


def one_way_relativities(spark, sf):
    """Written, not planned: sums of doubles differ in their last digits from one run of a plan to the next."""
    sums = [F.sum(c).alias(c) for c in ("ClaimNb", "Exposure")]
    cells = ScratchTable(pf(spark, sf).groupBy("segment", "priority").agg(*sums), "one-way-cells").df
    total = cells.agg(F.sum("ClaimNb") / F.sum("Exposure")).scalar()
    parts = []
    for v in ("segment", "priority"):
        rate = (F.sum("ClaimNb") / F.sum("Exposure")).alias("rate")
        parts.append(cells.groupBy(F.lit(v).alias("variable"), column(v).alias("level")).agg(rate))
    rows = parts[0].unionByName(parts[1])
    null = F.lit(None).cast("double")
    rated = rows.select(
        "variable",
        F.lit("categorical").alias("kind"),
        F.lit(0).alias("ord"),
        null.alias("from_d"),
        null.alias("to_d"),
        "level",
        (F.col("rate") / total).alias("relativity"),
    )
    return ScratchTable(rated, "one-way").df


EDITS = [("segment", "BUILDING", 1.25), ("priority", "1-URGENT", 0.9), ("segment", "SHIPS", 2.0)]


def edits(spark):
    return spark.createDataFrame(
        [(v, None, None, lv, x) for v, lv, x in EDITS],
        "variable string, from_d double, to_d double, level string, new_relativity double",
    )


EDITS_SQL = "e(variable, level, new) AS (VALUES " + ", ".join(
    f"('{v}', '{lv}', {x}::DOUBLE)" for v, lv, x in EDITS
) + ")"


@query(
    "r8_apply_edits",
    with_pf(
        ONE_WAY_SQL + f""", {EDITS_SQL} SELECT variable, level, {rs('coalesce(new, rel)')} AS relativity
        FROM o LEFT JOIN e USING (variable, level)"""
    ),
)
def r8(spark, sf):
    revised, _, _ = apply_edits(one_way_relativities(spark, sf), edits(spark))
    return revised.select("variable", "level", r("relativity").alias("relativity"))


@query(
    "r8_edit_log",
    with_pf(
        ONE_WAY_SQL + f""", {EDITS_SQL} SELECT variable, level, {rs('rel')} AS old_relativity,
        new AS new_relativity, rel IS NOT NULL AS matched FROM e LEFT JOIN o USING (variable, level)"""
    ),
)
def r8_log(spark, sf):
    _, changes, unmatched = apply_edits(one_way_relativities(spark, sf), edits(spark))
    done = changes.select(
        "variable", "level", r("old_relativity").alias("old_relativity"), "new_relativity",
        F.lit(True).alias("matched"),
    )
    missed = unmatched.select(
        "variable", "level", F.lit(None).cast("double").alias("old_relativity"), "new_relativity",
        F.lit(False).alias("matched"),
    )
    return done.unionByName(missed)


def _versions(spark, sf):
    first = one_way_relativities(spark, sf)
    second, _, _ = apply_edits(first, edits(spark))
    return first.withColumn("version", F.lit(1)).unionByName(
        second.withColumn("version", F.lit(2))
    )


@query(
    "r9_version_diff",
    with_pf(
        ONE_WAY_SQL + f""", {EDITS_SQL} SELECT variable, level, {rs('rel')} AS old_relativity,
        new AS new_relativity FROM e JOIN o USING (variable, level) WHERE new <> rel"""
    ),
)
def r9(spark, sf):
    return diff_versions(_versions(spark, sf), 1, 2).select(
        "variable", "level", r("old_relativity").alias("old_relativity"), "new_relativity"
    )


@query(
    "r9_snapshots",
    """SELECT * FROM (VALUES (1, 'Base model', NULL::INTEGER, 0), (2, 'Second version', 1, 2))
    s(version, description, parent_version, changes_count),
    (SELECT count(*)::BIGINT AS n_rows FROM lineitem)""",
)
def r9_snapshots(spark, sf):
    path = scratch_path(spark, "tariff")
    write_tariff(spark, revised_tariff(), path)
    model = read_tariff(spark, path)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.count(F.lit(1))).scalar()
    return model.snapshot_table(spark).drop("timestamp").withColumn("n_rows", rows)


@query(
    "r10_versions_of_a_portfolio",
    with_pf(
        f"""SELECT 1 AS version, {rs(f"sum({premium_sql()} * Exposure)", 4)} AS total FROM pf UNION ALL
        SELECT 2, {rs(f"sum({premium_sql(version=2)} * Exposure)", 4)} FROM pf"""
    ),
)
def r10(spark, sf):
    totals = revised_tariff(exposure=True).score_versions(pf(spark, sf))
    return totals.withColumn("total", r("total", 4))


@query(
    "r11_variables_with_signal",
    with_pf(
        ONE_WAY_SQL + """ SELECT variable, count(DISTINCT round_even(rel, 5))::BIGINT AS n_distinct
        FROM o GROUP BY 1 HAVING count(DISTINCT round_even(rel, 5)) > 1"""
    ),
)
def r11(spark, sf):
    return signal_variables(one_way_relativities(spark, sf))


@query(
    "r12_copy_is_independent",
    with_pf(
        f"""SELECT segment, {rs(f'sum({premium_sql()})', 4)} AS original,
        {rs(f'sum({premium_sql(version=2)})', 4)} AS copy FROM pf GROUP BY 1"""
    ),
)
def r12(spark, sf):
    original = tariff()
    copy = original.clone().update_relativity("discount", 0.02, 0.04, 2.0)
    copy = copy.update_relativity("segment", "BUILDING", "BUILDING", 1.2)
    scored = copy.predict(original.predict(pf(spark, sf), output_col="a"), output_col="b")
    return scored.groupBy("segment").agg(
        r(F.sum("a"), 4).alias("original"), r(F.sum("b"), 4).alias("copy")
    )


@query(
    "r13_relativity_comparison",
    with_pf(
        ONE_WAY_SQL + f""", {EDITS_SQL} SELECT variable, level AS label, {rs('rel')} AS original,
        {rs('coalesce(new, rel)')} AS revised FROM o LEFT JOIN e USING (variable, level)"""
    ),
)
def r13(spark, sf):
    from pyspark.sql import Window

    first = one_way_relativities(spark, sf)
    first = first.withColumn(
        "ord", F.row_number().over(Window.partitionBy("variable").orderBy("level")) - 1
    )
    second, _, _ = apply_edits(first, edits(spark))
    return comparison_table(first, second).select(
        "variable", "label", r("original").alias("original"), r("revised").alias("revised")
    )


@query(
    "j5_baseline_and_revised",
    with_pf(
        f"""SELECT {ord_sql(DISCOUNT, 'discount')} AS ord, count(*)::BIGINT AS n,
        any_value({case_sql(DISCOUNT, 'discount')}) AS original,
        any_value(CASE WHEN discount >= 0.02::DOUBLE AND discount < 0.04::DOUBLE THEN 2.0::DOUBLE
          ELSE {case_sql(DISCOUNT, 'discount')} END) AS revised FROM pf GROUP BY 1"""
    ),
)
def j5(spark, sf):
    model = revised_tariff()
    pair = comparison_table(
        model.switch_to(1).relativity_table(spark), model.relativity_table(spark)
    ).where("variable = 'discount'")
    counts = (
        pf(spark, sf)
        .groupBy(model.row_column("discount", F.col("discount")).alias("ord"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(pair, "ord").select("ord", "n", "original", "revised")
