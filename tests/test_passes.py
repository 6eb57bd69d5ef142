"""Queries that read the portfolio several times run its joins once, or as often as stated."""

import pytest

import __spark_entry__ as registered
from workload import registry

ONCE = [
    "m7_pipeline_equals_steps", "a5_many_levels", "r7_many_levels", "j1_many_levels", "m3_held_out_deviance", "a8_ae_by_decile",
    "r9_version_diff", *(f"{q}_{f}" for f in ("poisson", "gamma", "gaussian", "binomial") for q in ("m1_optimality", "m2_all_shrunk", "m2_balance")),
]
TIMES = {**dict.fromkeys(ONCE, 1), "r10_many_versions": 2}


@pytest.mark.parametrize("name", TIMES)
def test_joins_run_once(spark, sf_dir, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)
    plain = registry.portfolio

    def counted(spark, sf_dir):
        rows = plain(spark, sf_dir)

        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(registry, "portfolio", counted)
    assert registered.queries()[name](spark, sf_dir).collect()
    assert seen.value == TIMES[name] * plain(spark, sf_dir).count()


def test_portfolio_joins(spark, sf_dir):
    """Orders meet customers before the lines, so lines are not shuffled by customer."""
    rows = registry.pf(spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    text = rows._jdf.queryExecution().analyzed().toString()
    join = text[text.index("Join") :].splitlines()
    assert "l_orderkey" in join[0] and any("o_custkey" in x and "Join" in x for x in join[1:])
