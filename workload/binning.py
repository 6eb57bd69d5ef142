"""Blueprints, encodings and labels."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from premia.functions.binning import bin_id, bin_label_column, lump_fun
from premia.functions.loss import inverse_link
from premia.functions.names import column
from premia.operators.blueprint import (
    QUANTILE_PROBABILITIES,
    generate_blueprint,
    lump_rare_levels,
)
from premia.operators.prepare import one_hot, prepare_data
from premia.operators.quantiles import order_statistics
from workload.registry import pf, query, r, rs, with_pf
from workload.tariffs import (
    DISCOUNT,
    SIZE,
    case_sql,
    ord_sql,
    segment_ord_sql,
    segment_sql,
    tariff,
)

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYS_SQL = ", ".join(KEYS)
BREAKS = [0.02, 0.04, 0.06]


@query(
    "p6_o_matrix",
    with_pf(
        f""", f AS (SELECT segment, coalesce(tax_null, avg(tax_null) OVER ()) AS x FROM pf)
        SELECT segment, {', '.join(
            f'sum(CASE WHEN x < {b}::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS below_{i}'
            for i, b in enumerate(BREAKS))} FROM f GROUP BY 1"""
    ),
)
def p6(spark, sf):
    wide = prepare_data(["tax_null"], ["segment"], df=pf(spark, sf), formats={"tax_null": BREAKS})
    return wide.groupBy("segment").agg(
        *[F.sum(column(f"tax_null{b}")).alias(f"below_{i}") for i, b in enumerate(BREAKS)]
    )


@query(
    "p7_bin_id",
    f"""SELECT {KEYS_SQL}, CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice < 45000
    THEN 1 WHEN l_extendedprice < 80000 THEN 2 ELSE 3 END AS bin FROM lineitem""",
)
def p7(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.select(*KEYS, bin_id(F.col("l_extendedprice"), [20000, 45000, 80000]).alias("bin"))


@query(
    "p8_lump",
    with_pf(
        f"""SELECT {KEYS_SQL}, CASE WHEN segment_null IN ('BUILDING', 'MACHINERY')
        THEN segment_null ELSE 'Other' END AS segment_lumped FROM pf"""
    ),
)
def p8(spark, sf):
    lumped = lump_fun("segment_null", ["BUILDING", "MACHINERY", "O'Hare"])
    return pf(spark, sf).select(*KEYS, lumped.alias("segment_lumped"))


@query(
    "p9_lump_rare_levels",
    with_pf(
        f""", c AS (SELECT brand_type, count(*) AS n FROM pf GROUP BY 1)
        SELECT {KEYS_SQL}, CASE WHEN n::DOUBLE / (SELECT count(*) FROM pf) < 0.006 THEN 'Other'
        ELSE brand_type END AS brand_type FROM pf JOIN c USING (brand_type)"""
    ),
)
def p9(spark, sf):
    data = pf(spark, sf).select(*KEYS, "brand_type")
    return lump_rare_levels(data, "brand_type", threshold=0.006)


@query(
    "p9_lump_rare_levels_of_many",
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CASE WHEN n::DOUBLE / (SELECT count(*) FROM lineitem) < 0.0005 THEN 'Other'
    ELSE l_partkey::VARCHAR END AS part, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
)
def p9_many(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("part"))
    lumped = lump_rare_levels(lines, "part", threshold=0.0005)
    return lumped.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def quantile_sql(variables, where: str = "traintest = 1") -> str:
    """Distinct nearest-rank breaks per variable, as ``brk(variable, brk)``."""
    ranked = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {v}::DOUBLE AS x, row_number() OVER (ORDER BY {v}) - 1 AS rn, "
        f"count(*) OVER () AS n FROM pf WHERE {where} AND {v} IS NOT NULL"
        for v in variables
    )
    return (
        f"ranked AS ({ranked}), "
        "probs AS (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS q FROM range(20) t(i)), "
        "brk AS (SELECT DISTINCT variable, x AS brk FROM ranked, probs "
        "WHERE rn = floor(q * (n - 1) + 0.5))"
    )


NUMERICS = ["discount", "tax_null", "p_size", "price"]


@query(
    "p10_numeric_blueprint",
    with_pf(
        f""", {quantile_sql(NUMERICS)}
        SELECT variable, 'numeric' AS kind, (row_number() OVER (PARTITION BY variable ORDER BY brk)
        - 1)::INTEGER AS ord, brk AS "break" FROM brk"""
    ),
)
def p10(spark, sf):
    train = pf(spark, sf).where(F.col("traintest") == 1)
    return generate_blueprint(train, NUMERICS).to_dataframe(spark).drop("level")


@query(
    "p11_categorical_blueprint",
    with_pf(
        """, lv AS (SELECT 'segment_null' AS variable, segment_null AS level FROM pf WHERE traintest = 1
              UNION ALL SELECT 'brand_type', brand_type FROM pf WHERE traintest = 1
              UNION ALL SELECT 'nation', nation FROM pf WHERE traintest = 1),
        c AS (SELECT variable, level, count(*) AS n, sum(count(*)) OVER (PARTITION BY variable) AS t
              FROM lv WHERE level IS NOT NULL GROUP BY 1, 2)
        SELECT variable, 'categorical' AS kind, (row_number() OVER (PARTITION BY variable ORDER BY
        level) - 1)::INTEGER AS ord, level FROM c WHERE n::DOUBLE / t >= 0.006 AND level <> 'Other'"""
    ),
)
def p11(spark, sf):
    train = pf(spark, sf).where(F.col("traintest") == 1)
    names = ["segment_null", "brand_type", "nation"]
    return generate_blueprint(train, names, threshold=0.006).to_dataframe(spark).drop("break")


@query(
    "p11_whole_table_blueprint",
    """WITH kinds(variable, kind) AS (VALUES ('c_custkey', 'numeric'), ('c_name', 'empty'),
    ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical'),
    ('tags', 'error'))
    SELECT variable, kind, (SELECT count(DISTINCT c_mktsegment) FROM customer
    WHERE variable = 'c_mktsegment')::BIGINT AS n_levels FROM kinds""",
)
def p11_whole(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    # All names differ, so at this threshold each of them is rare.
    customers = customers.withColumn("tags", F.array("c_name"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        plan = generate_blueprint(customers, threshold=0.01).to_dataframe(spark)
    is_level = (F.col("kind") == "categorical") & F.col("level").isNotNull()
    return plan.groupBy("variable", "kind").agg(F.count_if(is_level).alias("n_levels"))


@query(
    "w2_running_counts",
    """WITH c AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1),
    w AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto FROM c),
    p AS (SELECT floor((0.05::DOUBLE + i * 0.05::DOUBLE) * ((SELECT count(*) FROM lineitem) - 1)
          + 0.5) AS rank FROM range(20) t(i))
    SELECT rank::BIGINT AS rank, x AS value FROM p JOIN w ON rank < upto AND rank >= upto - n""",
)
def w2(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")

    def ranks(_name, n):
        return [int(q * (n - 1) + 0.5) for q in QUANTILE_PROBABILITIES]

    # A low limit, so that the splitting of large inputs runs here too.
    _, found = order_statistics(lines, ["l_quantity"], ranks, rank_limit=1000)
    rows = [(int(k), float(v)) for k, v in found["l_quantity"].items()]
    return spark.createDataFrame(rows, "rank bigint, value double")


WIDE = {"discount": [0.03, 0.06], "tax_null": [0.04], "segment_null": ["BUILDING"], "status": []}


@query(
    "p12_prepare_wide",
    with_pf(
        f""", f AS (SELECT *, coalesce(tax_null, avg(tax_null) OVER ()) AS t FROM pf)
        SELECT {KEYS_SQL}, CASE WHEN discount < 0.03::DOUBLE THEN 1 ELSE 0 END AS discount_0,
        CASE WHEN discount < 0.06::DOUBLE THEN 1 ELSE 0 END AS discount_1,
        CASE WHEN t < 0.04::DOUBLE THEN 1 ELSE 0 END AS tax_0,
        CASE WHEN segment_null = 'BUILDING' THEN 'BUILDING' ELSE 'Other' END AS segment_null_lumped,
        p_size, traintest FROM f"""
    ),
)
def p12_wide(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        wide = prepare_data(
            ["discount", "tax_null", "segment_null", "status", "p_size", "absent"],
            KEYS, "traintest", df=pf(spark, sf), formats=WIDE,
        )
    return wide.withColumnsRenamed(
        {"discount0.03": "discount_0", "discount0.06": "discount_1", "tax_null0.04": "tax_0"}
    )


@query(
    "p12_prepare_bins",
    with_pf(
        f""", f AS (SELECT *, coalesce(tax_null, avg(tax_null) OVER ()) AS t FROM pf)
        SELECT {KEYS_SQL}, CASE WHEN discount < 0.03::DOUBLE THEN 0 WHEN discount < 0.06::DOUBLE
        THEN 1 ELSE 2 END AS discount_bin, CASE WHEN t < 0.04::DOUBLE THEN 0 ELSE 1 END AS tax_null_bin,
        CASE WHEN segment_null = 'BUILDING' THEN 0 ELSE 1 END AS segment_null_bin FROM f"""
    ),
)
def p12_bins(spark, sf):
    return prepare_data(
        ["discount", "tax_null", "segment_null"], KEYS, df=pf(spark, sf), formats=WIDE,
        encoding="bins",
    )


@query(
    "p12_prepare_view",
    """SELECT l_linestatus, sum(CASE WHEN l_tax < 0.03::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS low_tax
    FROM lineitem GROUP BY 1""",
)
def p12_view(spark, sf):
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("policy_lines")
    wide = prepare_data(
        ["l_tax"], ["l_linestatus"], df="policy_lines", formats={"l_tax": [0.03]}, spark=spark
    )
    return wide.groupBy("l_linestatus").agg(F.sum(column("l_tax0.03")).alias("low_tax"))


@query(
    "p13_odd_names",
    with_pf(
        """SELECT CASE WHEN segment IN ('BUILDING') THEN segment ELSE 'Other' END AS "select_lumped",
        sum(CASE WHEN p_size < 20 THEN 1 ELSE 0 END)::BIGINT AS young, count(*)::BIGINT AS n
        FROM pf GROUP BY 1"""
    ),
)
def p13(spark, sf):
    odd = pf(spark, sf).select(
        F.col("p_size").alias("vehicle`s age.y"), F.col("segment").alias("select")
    )
    wide = prepare_data(
        ["vehicle`s age.y", "select"], df=odd,
        formats={"vehicle`s age.y": [20.0], "select": ["BUILDING"]},
    )
    return wide.groupBy("select_lumped").agg(
        F.sum(column("vehicle`s age.y20.0")).alias("young"), F.count(F.lit(1)).alias("n")
    )


@query(
    "p17_one_hot",
    with_pf(
        f"""SELECT {KEYS_SQL}, CASE WHEN status = 'O' THEN 1.0::DOUBLE ELSE 0 END AS "status_O",
        CASE WHEN status = 'P' THEN 1.0::DOUBLE ELSE 0 END AS "status_P" FROM pf"""
    ),
)
def p17(spark, sf):
    data = pf(spark, sf).select(*KEYS, "status")
    return one_hot(data, "status", ["F", "O", "P"], drop_first=True).drop("status")


@query(
    "p18_bin_labels",
    with_pf(
        f"""SELECT CASE WHEN discount < 0.02::DOUBLE THEN '< 0.02'
          WHEN discount < 0.04::DOUBLE THEN '[0.02, 0.04)'
          WHEN discount < 0.06::DOUBLE THEN '[0.04, 0.06)'
          WHEN discount < 0.08::DOUBLE THEN '[0.06, 0.08)' ELSE '≥ 0.08' END AS discount_label,
        CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN segment
          ELSE 'Other / Unknown' END AS segment_label, count(*)::BIGINT AS n FROM pf GROUP BY 1, 2"""
    ),
)
def p18(spark, sf):
    model = tariff()
    labels = model.relativity_table(spark).select(
        "variable", "ord", bin_label_column(F.col("from_d"), F.col("to_d"), F.col("level")).alias("label")
    )
    counts = (
        pf(spark, sf)
        .groupBy(
            model.row_column("discount", F.col("discount")).alias("d"),
            model.row_column("segment", F.col("segment")).alias("s"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_d = labels.where("variable = 'discount'").select(
        F.col("ord").alias("d"), F.col("label").alias("discount_label")
    )
    by_s = labels.where("variable = 'segment'").select(
        F.col("ord").alias("s"), F.col("label").alias("segment_label")
    )
    return counts.join(by_d, "d").join(by_s, "s").select("discount_label", "segment_label", "n")


@query(
    "p19_row_in_bin",
    with_pf(
        f"""SELECT {KEYS_SQL}, {ord_sql(SIZE, 'p_size')} AS size_row,
        {segment_ord_sql('segment_null')} AS segment_row FROM pf"""
    ),
)
def p19(spark, sf):
    model = tariff(segment="segment_null")
    return pf(spark, sf).select(
        *KEYS,
        model.row_column("p_size", F.col("p_size")).alias("size_row"),
        model.row_column("segment_null", F.col("segment_null")).alias("segment_row"),
    )


@query(
    "j1_level_lookup",
    with_pf(f"SELECT {KEYS_SQL}, {segment_sql('segment_null')} AS relativity FROM pf"),
)
def j1(spark, sf):
    model = tariff(segment="segment_null")
    found = model.relativity_column("segment_null", F.col("segment_null"))
    return pf(spark, sf).select(*KEYS, found.alias("relativity"))


@query(
    "j2_range_lookup",
    with_pf(f"SELECT {KEYS_SQL}, {case_sql(DISCOUNT, 'discount')} AS relativity FROM pf"),
)
def j2(spark, sf):
    found = tariff().relativity_column("discount", F.col("discount"))
    return pf(spark, sf).select(*KEYS, found.alias("relativity"))


@query(
    "u2_distinct_breaks",
    with_pf(
        f""", {quantile_sql(['discount', 'tax_null'])}
        SELECT variable, count(*)::BIGINT AS n_breaks, min(brk) AS first, max(brk) AS last
        FROM brk GROUP BY 1"""
    ),
)
def u2(spark, sf):
    train = pf(spark, sf).where(F.col("traintest") == 1)
    plan = generate_blueprint(train, ["discount", "tax_null"]).to_dataframe(spark)
    return plan.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_breaks"), F.min("break").alias("first"), F.max("break").alias("last")
    )


@query(
    "f_scalar_functions",
    with_pf(
        f"""SELECT {KEYS_SQL}, CASE WHEN margin > 0 THEN 'gain' ELSE 'loss' END AS sign,
        p_size::VARCHAR AS size_text, status IN ('O', 'P') AS is_open,
        {rs('ln(severity)')} AS log_severity, {rs('sqrt(price)')} AS root_price,
        {rs('abs(margin)', 4)} AS abs_margin, {rs('pow(discount, 2)')} AS discount_sq,
        least(greatest(discount, 0.02::DOUBLE), 0.08::DOUBLE) AS clipped,
        round_even(price / 100, 1) AS banker,
        {rs('exp(discount)')} AS log_mean, {rs('1 / (1 + exp(-discount))')} AS logit_mean,
        discount AS identity_mean, tax_null IS NULL AS missing FROM pf"""
    ),
)
def f_scalar(spark, sf):
    eta = F.col("discount")
    return pf(spark, sf).select(
        *KEYS,
        F.when(F.col("margin") > 0, "gain").otherwise("loss").alias("sign"),
        F.col("p_size").cast("string").alias("size_text"),
        F.col("status").isin("O", "P").alias("is_open"),
        r(F.log("severity")).alias("log_severity"),
        r(F.sqrt("price")).alias("root_price"),
        r(F.abs("margin"), 4).alias("abs_margin"),
        r(F.pow("discount", F.lit(2.0))).alias("discount_sq"),
        F.least(F.greatest("discount", F.lit(0.02)), F.lit(0.08)).alias("clipped"),
        F.bround(F.col("price") / 100, 1).alias("banker"),
        r(inverse_link(eta, "poisson")).alias("log_mean"),
        r(inverse_link(eta, "binomial")).alias("logit_mean"),
        inverse_link(eta, "gaussian").alias("identity_mean"),
        F.col("tax_null").isNull().alias("missing"),
    )
