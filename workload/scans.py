"""Sources, sinks, splits, checks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from premia.functions.names import column, rename_columns
from premia.functions.split import train_flag
from premia.operators.blueprint import level_counts
from premia.operators.profile import column_profile, histogram, level_distribution, value_counts
from premia.operators.prepare import batch_means
from premia.operators.validate import check_columns, distinct_flags, rule_counts, validate_fit_input
from premia.plans.portfolio import read_table
from premia.session import scratch_path
from premia.sources.tables import (
    append_rows,
    read_portfolio,
    read_rate_tables,
    sample_rows,
    write_portfolio,
    write_rate_tables,
)
from workload.registry import pf, query, r, rs, with_pf


@query(
    "s1_read_parquet",
    "SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity "
    "FROM lineitem GROUP BY 1",
)
def s1(spark, sf):
    lines = read_portfolio(spark, f"{sf}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "s2_csv_round_trip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def s2(spark, sf):
    return s2_all(spark, sf).drop("o_orderdate")


@query("s2_csv_round_trip_all_columns", "SELECT * FROM orders")
def s2_all(spark, sf):
    orders = read_table(spark, sf, "orders")
    path = scratch_path(spark, "orders") + ".csv"
    write_portfolio(orders, path, "csv")
    return read_portfolio(spark, path, schema=orders.schema)


def _one_way(spark, sf):
    """Claims per exposure by level of two predictors, over the total."""
    data = pf(spark, sf)
    total = data.agg(F.sum("ClaimNb") / F.sum("Exposure")).scalar()
    parts = []
    for v in ("segment", "priority"):
        rate = (F.sum("ClaimNb") / F.sum("Exposure")).alias("prediction")
        parts.append(
            data.groupBy(F.lit(v).alias("variable"), column(v).alias("level")).agg(rate)
        )
    rates = parts[0].unionByName(parts[1])
    return rates.withColumn("relativity", F.col("prediction") / total)


ONE_WAY = f"""
, t AS (SELECT sum(ClaimNb) / sum(Exposure) AS total FROM pf),
o AS (SELECT 'segment' AS variable, segment AS level, sum(ClaimNb) / sum(Exposure) AS p
      FROM pf GROUP BY 2
      UNION ALL
      SELECT 'priority', priority, sum(ClaimNb) / sum(Exposure) FROM pf GROUP BY 2)
SELECT variable, level, {rs('p')} AS prediction, {rs('p / total')} AS relativity FROM o, t
"""


@query("s3_write_rate_tables", with_pf(ONE_WAY))
def s3(spark, sf):
    path = scratch_path(spark, "rates")
    write_rate_tables(_one_way(spark, sf), path)
    return read_rate_tables(spark, path).select(
        "variable", "level", r("prediction").alias("prediction"), r("relativity").alias("relativity")
    )


@query("s4_read_one_rate_table", with_pf(ONE_WAY + " WHERE variable = 'segment'"))
def s4(spark, sf):
    path = scratch_path(spark, "rates")
    write_rate_tables(_one_way(spark, sf), path)
    return read_rate_tables(spark, path, ["segment"]).select(
        "variable", "level", r("prediction").alias("prediction"), r("relativity").alias("relativity")
    )


@query(
    "s7_sample_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY "
    "md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey)), l_orderkey, l_linenumber, "
    "l_partkey, l_quantity LIMIT 1000",
)
def s7(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = read_table(spark, sf, "lineitem").select(*keys, "l_quantity")
    return sample_rows(lines, 1000, keys)


@query(
    "p1_train_flag",
    "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 "
    "< 70 THEN 1 ELSE 0 END AS traintest FROM orders",
)
def p1(spark, sf):
    orders = read_table(spark, sf, "orders")
    return orders.select("o_orderkey", train_flag(F.col("o_orderkey")).alias("traintest"))


@query(
    "p2_holdout_rows",
    with_pf(
        f"SELECT segment, count(*)::BIGINT AS n, sum(ClaimNb)::BIGINT AS claims, "
        f"{rs('sum(Exposure)', 4)} AS exposure FROM pf WHERE traintest = 0 GROUP BY 1"
    ),
)
def p2(spark, sf):
    return (
        pf(spark, sf)
        .where(F.col("traintest") == 0)
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("ClaimNb").alias("claims"),
            r(F.sum("Exposure"), 4).alias("exposure"),
        )
    )


_FLAG = "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 2 ELSE o_orderkey % 2 END"


@query(
    "p3_flag_rules",
    f"""WITH f AS (SELECT ({_FLAG})::INTEGER AS flag FROM orders)
    SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (flag = 1)::BIGINT AS n_train,
           count(*) FILTER (flag NOT IN (0, 1))::BIGINT AS bad_flag FROM f""",
)
def p3(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("flag", F.expr(_FLAG).cast("int"))
    return rule_counts(orders, "o_totalprice", "flag", "gaussian").select(
        "n_rows", "n_train", "bad_flag"
    )


_MARGIN = "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE margin / 10000 END"
_WEIGHT = "CASE WHEN l_orderkey % 23 = 0 THEN -Exposure WHEN l_orderkey % 29 = 0 THEN NULL ELSE Exposure END"


@query(
    "p4_target_rules",
    with_pf(
        f""", v AS (SELECT {_MARGIN} AS y, {_WEIGHT} AS w FROM pf)
        SELECT family, count(*)::BIGINT AS n_rows,
          count(*) FILTER (y IS NULL OR (family = 'poisson' AND y < 0)
            OR (family = 'gamma' AND y <= 0)
            OR (family = 'binomial' AND (y < 0 OR y > 1)))::BIGINT AS bad_target,
          count(*) FILTER (w IS NULL OR w <= 0)::BIGINT AS bad_weight
        FROM v, (VALUES ('poisson'), ('gamma'), ('gaussian'), ('binomial')) f(family) GROUP BY 1"""
    ),
)
def p4(spark, sf):
    data = pf(spark, sf).withColumns({"y": F.expr(_MARGIN), "w": F.expr(_WEIGHT)})
    out = None
    for family in ("poisson", "gamma", "gaussian", "binomial"):
        part = rule_counts(data, "y", "traintest", family, "w").select(
            F.lit(family).alias("family"), "n_rows", "bad_target", "bad_weight"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p5_input_checks",
    "SELECT c.name AS check_name, true AS raised, count(l_orderkey)::BIGINT AS n_rows "
    "FROM (VALUES ('missing column'), ('duplicate column'), ('unknown family'), ('empty table')) "
    "c(name), lineitem GROUP BY 1",
)
def p5(spark, sf):
    lines = read_table(spark, sf, "lineitem").withColumn("traintest", F.lit(1))
    lines = lines.select("l_orderkey", "l_quantity", "traintest")
    doubled = lines.select("*", F.col("l_quantity"))

    def raised(fn) -> bool:
        try:
            fn()
        except ValueError:
            return True
        return False

    checks = {
        "missing column": raised(lambda: check_columns(lines, ["absent"])),
        "duplicate column": raised(lambda: check_columns(doubled, ["l_quantity"])),
        "unknown family": raised(
            lambda: validate_fit_input(lines, "l_quantity", "traintest", "tweedie")
        ),
        "empty table": raised(
            lambda: validate_fit_input(
                lines.where("l_quantity < 0"), "l_quantity", "traintest", "gaussian"
            )
        ),
    }
    pairs = [x for name, ok in checks.items() for x in (F.lit(name), F.lit(ok))]
    return (
        lines.agg(F.count("l_orderkey").alias("n_rows"))
        .select("n_rows", F.stack(F.lit(len(checks)), *pairs).alias("check_name", "raised"))
    )


@query(
    "p14_column_mapping",
    "SELECT l_discount AS discount, l_quantity AS \"my quantity\", count(*)::BIGINT AS n "
    "FROM lineitem GROUP BY 1, 2",
)
def p14(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    renamed = rename_columns(
        lines, {"l_discount": "discount", "l_quantity": "my quantity", "absent": "x"}
    )
    return renamed.groupBy("discount", column("my quantity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p15_target_per_weight",
    with_pf(
        f"SELECT segment, {rs('sum(ClaimNb / Exposure)', 4)} AS total, "
        f"{rs('max(severity / Exposure)', 4)} AS largest FROM pf GROUP BY 1"
    ),
)
def p15(spark, sf):
    data = pf(spark, sf)
    return data.groupBy("segment").agg(
        r(F.sum(F.try_divide(F.col("ClaimNb"), F.col("Exposure"))), 4).alias("total"),
        r(F.max(F.try_divide(F.col("severity"), F.col("Exposure"))), 4).alias("largest"),
    )


@query(
    "j6_portfolio",
    with_pf(
        f"""SELECT l_orderkey, l_linenumber, l_partkey, discount, tax, p_size, price, segment,
        priority, status, nation, brand, brand_type, {rs('Exposure')} AS Exposure, traintest,
        ClaimNb, {rs('severity')} AS severity, {rs('margin')} AS margin, returned, tax_null,
        segment_null FROM pf"""
    ),
)
def j6(spark, sf):
    data = pf(spark, sf)
    return data.withColumns({c: r(c) for c in ("Exposure", "severity", "margin")})


@query(
    "a1_level_shares",
    "SELECT o_orderpriority AS level, count(*)::BIGINT AS n, "
    "round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1",
)
def a1(spark, sf):
    return level_distribution(read_table(spark, sf, "orders"), "o_orderpriority").withColumn(
        "share", r("share")
    )


@query(
    "a1_level_counts_of_many_columns",
    with_pf(
        "SELECT 'segment_null' AS variable, segment_null AS level, count(*)::BIGINT AS n FROM pf "
        "WHERE segment_null IS NOT NULL GROUP BY 2 UNION ALL "
        "SELECT 'brand_type', brand_type, count(*)::BIGINT FROM pf GROUP BY 2"
    ),
)
def a1_many(spark, sf):
    return level_counts(pf(spark, sf), ["segment_null", "brand_type"])


@query(
    "a2_value_counts",
    with_pf(
        "SELECT nation AS level, count(*)::BIGINT AS n FROM pf GROUP BY 1 ORDER BY 2 DESC, 1"
    ),
)
def a2(spark, sf):
    return value_counts(pf(spark, sf), "nation")


_HIST = """
SELECT least(floor((x - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*)::BIGINT AS n,
       round(any_value(lo + least(floor((x - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30)), 4) AS lower
FROM v, (SELECT min(x) lo, max(x) hi FROM v) GROUP BY 1
"""


@query(
    "a3_histogram",
    "WITH v AS (SELECT l_extendedprice AS x FROM lineitem)" + _HIST,
)
def a3(spark, sf):
    h = histogram(read_table(spark, sf, "lineitem"), "l_extendedprice")
    return h.select("bin", "n", r("lower", 4).alias("lower"))


@query(
    "a3_column_profile",
    with_pf(", v AS (SELECT tax_null AS x FROM pf WHERE tax_null IS NOT NULL)" + _HIST),
)
def a3_profile(spark, sf):
    h = column_profile(pf(spark, sf), "tax_null")
    return h.select("bin", "n", r("lower", 4).alias("lower"))


@query(
    "a4_distinct_flags",
    f"SELECT DISTINCT ({_FLAG})::INTEGER AS flag FROM orders WHERE ({_FLAG}) IS NOT NULL",
)
def a4(spark, sf):
    orders = read_table(spark, sf, "orders").withColumn("f", F.expr(_FLAG).cast("int"))
    return distinct_flags(orders, "f")


@query(
    "a10_batch_means",
    with_pf(f"SELECT {rs('avg(tax_null)')} AS tax_mean, {rs('avg(p_size)')} AS size_mean FROM pf"),
)
def a10(spark, sf):
    data = pf(spark, sf)
    return data.agg(
        r(F.avg("tax_null")).alias("tax_mean"), r(F.avg("p_size")).alias("size_mean")
    )


@query(
    "w1_mean_over_all_rows",
    with_pf(
        f"SELECT l_orderkey, l_linenumber, l_partkey, "
        f"{rs('coalesce(tax_null, avg(tax_null) OVER ())')} AS tax FROM pf"
    ),
)
def w1(spark, sf):
    data = pf(spark, sf)
    mean = batch_means(data, ["tax_null"])["tax_null"]
    return data.select(
        "l_orderkey", "l_linenumber", "l_partkey", r(F.coalesce("tax_null", mean)).alias("tax")
    )


@query(
    "o2_first_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
)
def o2(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return (
        lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
        .limit(10)
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    )


@query(
    "u1_append_rows",
    "SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS balance FROM "
    "(SELECT c_mktsegment, c_acctbal FROM customer UNION ALL "
    "SELECT 'SUPPLIER', s_acctbal FROM supplier) GROUP BY 1",
)
def u1(spark, sf):
    customers = read_table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    suppliers = read_table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLIER").alias("c_mktsegment")
    )
    return (
        append_rows(customers, suppliers)
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("balance"))
    )
