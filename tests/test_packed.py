"""Cells packed to a few large rows, values counted one by one, and the questions that share cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia import fit_glm, generate_blueprint
from premia.operators import cells as cell_module
from premia.operators import kernels, quantiles
from premia.operators.blueprint import Blueprint
from premia.operators.cells import CellTable, aggregate_cells
from premia.operators.glm import CellPasses, TrainingCells, alpha_max, fixed_model
from premia.operators.quantiles import nearest_rank, order_statistics
from premia.operators.wide import RangeDesign
from workload import many
from workload.registry import QUERIES

SIZES = [3, 5, 30, 4]
LISTS = {"a": [1, 2], "b": [1, 2, 3, 4], "c": list(range(1, 30)), "d": ["u", "v", "w"]}
FOLDS = 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 3_000
    data = [
        (int(rng.integers(0, 3)), int(rng.integers(0, 5)), int(rng.integers(0, 30)), "uvwx"[rng.integers(0, 4)], float(rng.normal()),
         int(rng.poisson(1.0)), float(rng.random() + 0.1), int(rng.integers(0, FOLDS)))
        for _ in range(n)
    ]
    return spark.createDataFrame(data, "a int, b int, c int, d string, z double, y int, w double, fold int").repartition(4)


@pytest.mark.parametrize("most, few_cells", [(kernels.GROUP_CELLS, 1), (16, 1), (16, 10**9)])
@pytest.mark.parametrize("folds", [1, FOLDS])
def test_packed_cells_answer_like_rows(rows, monkeypatch, most, few_cells, folds):
    """In groups of any size, a predictor wider than a group among them, with raw columns and folds."""
    monkeypatch.setattr(kernels, "GROUP_CELLS", most)
    monkeypatch.setattr(cell_module, "FEW_CELLS", few_cells)
    plan = Blueprint.from_lists(LISTS)
    level = F.coalesce(*[F.when(F.col("d") == x, i) for i, x in enumerate("uvw")], F.lit(3))
    bins = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "d": level}
    raws = {"z": F.col("z")} if few_cells == 1 else {}
    y, w = F.col("y") / F.col("w"), F.col("w")
    design = RangeDesign(plan, list(bins), list(raws))
    fold = F.col("fold") if folds > 1 else None
    by_row = CellTable.build(aggregate_cells(rows, bins, raws, y, w, "poisson", fold))
    packed = CellTable.pack(rows, bins, raws, y, w, "poisson", design.layout, fold, folds)
    assert packed.df.columns == ["packed"] and packed.df.count() <= 8
    plain, quick = (CellPasses(t, design, "poisson", folds) for t in (by_row, packed))
    for a, b in zip(plain.light_moments().values(), quick.light_moments().values()):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    rng = np.random.default_rng(6)
    held = [-1, 0, folds - 1]
    b0, beta = rng.normal(0, 0.1, 3), rng.normal(0, 0.1, (3, design.p))
    for a, b in zip(plain.evaluate(b0, beta, held, False), quick.evaluate(b0, beta, held, False)):
        assert (a is None) == (b is None)
        if a is not None:
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-8)
    # Gram matrices against the dense product over rows.
    active = [np.array([0, 3, 20, design.p - 1])] * 3
    here = rows.select(*[c.alias(v) for v, c in bins.items()], "z", "y", "w", "fold").toPandas()
    full = [np.ones(len(here))] + [
        here["z"] if v < 0 else ((here[list(bins)[v]] >= lo) & (here[list(bins)[v]] < hi)).astype(float) for v, lo, hi in design.columns(active[0])
    ]
    x, coefs = np.column_stack(full), design.onehot_coefs(b0, beta)
    for k, gram in enumerate(quick.active_grams(b0, beta, held, active)):
        eta = coefs[k, 0] + sum(coefs[k, at + here[v]] for v, at in zip(bins, design.layout.offsets))
        eta = eta + (coefs[k, design.layout.raw_at] * here["z"] if raws else 0.0)
        keep = here["fold"] != held[k] if folds > 1 else np.full(len(here), held[k] != 0)
        np.testing.assert_allclose(gram, x.T @ (x * (keep * here["w"] * np.exp(eta)).to_numpy()[:, None]), rtol=1e-9, atol=1e-8)
    by_row.close()
    packed.close()


def test_rows_that_repeat_are_summed(spark, monkeypatch):
    """Where the least hashes show few distinct cells, a cell comes once."""
    monkeypatch.setattr(cell_module, "FEW_CELLS", 1)
    df = spark.range(40_000).select((F.col("id") % 50).cast("int").alias("a"), (F.col("id") % 7).alias("y"))
    for bins, n in (({"a": F.col("a")}, 50), ({"a": F.col("a"), "b": (F.hash("a", "y") % 3 + 2).cast("int")}, None)):
        layout = kernels.Layout([50, 5][: len(bins)], 0)
        table = CellTable.pack(df, bins, {}, F.col("y"), F.lit(2.0), "poisson", layout)
        assert table.n_cells == n if n else table.n_cells <= 250
        groups = kernels.Groups(layout)
        got = [kernels.Packed(r["packed"], groups, 1) for r in table.df.collect()]
        assert sum(p.sw.sum() for p in got) == 80_000
        assert sum(len(p.sw) for p in got) == table.n_cells
        table.close()


def test_estimate_of_distinct_cells():
    rng = np.random.default_rng(7)
    hashes = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert kernels.distinct_hashes(kernels.least(np.concatenate([hashes, hashes]))) == pytest.approx(50_000, rel=0.15)
    assert kernels.distinct_hashes(kernels.least(np.repeat(hashes[:20], 9))) == 20


@pytest.mark.parametrize("most", [4_096, 40, 3])
def test_counted_values_give_the_same_ranks(spark, monkeypatch, most):
    """Columns of few values are settled in the first pass, those of many by the rounds; both exactly."""
    monkeypatch.setattr(quantiles, "FEW_VALUES", most)
    rng = np.random.default_rng(8)
    n = 3_000
    own = {
        "ints": rng.integers(-5, 5, n).astype(float),
        "some": rng.integers(0, 40, n).astype(float),
        "many": rng.normal(size=n),
        "holes": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 3, n)),
        "ends": rng.choice([-math.inf, -0.0, 0.0, math.inf], n),
        "none": np.full(n, np.nan),
    }
    data = [tuple(None if c == "holes" and i % 5 == 0 else float(x[i]) for c, x in own.items()) for i in range(n)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in own)).repartition(3)
    ranks = lambda _c, k: [nearest_rank(q, k) for q in (0.0, 0.1, 0.5, 0.9, 1.0)]
    counts, found = order_statistics(df, list(own), ranks, rank_limit=200, few=True)
    for i, c in enumerate(own):
        x = sorted(r[i] for r in data if r[i] is not None and not math.isnan(r[i]))
        assert counts[c] == len(x)
        assert found[c] == ({k: x[k] for k in ranks(c, len(x))} if x else {})


def test_plan_by_counted_values(policies):
    plain, quick = (generate_blueprint(policies, few_values=few) for few in (False, True))
    assert quick.to_lists() == plain.to_lists()


def test_shared_cells_give_the_same_fit(policies, monkeypatch):
    plan = Blueprint.from_lists({"VehAge": [3, 6, 9], "DrivAge": [30, 40, 50], "Region": ["North", "South"]})
    roles = {"weight_col": "Exposure", "divide_target_by_weight": True}
    options = {"use_cv": False, "alpha": 1e-3, "cv_params": {"solver": "active"}, **roles}
    ask = ("ClaimNb", "Poisson", list(plan), plan)
    alphas, model = alpha_max(policies, *ask, **roles).collect(), fit_glm(policies, *ask, **options)
    cells = TrainingCells.build(policies, *ask, **roles)
    try:
        monkeypatch.setattr(cell_module, "ScratchTable", None)
        shared = alpha_max(policies, *ask, cells=cells, **roles).collect()
        again = fit_glm(policies, *ask, cells=cells, **options)
        with pytest.raises(ValueError, match="other columns"):
            alpha_max(policies, "ClaimNb", "Gamma", list(plan), plan, cells=cells, **roles)
    finally:
        cells.close()
    assert [r["feature"] for r in shared] == [r["feature"] for r in alphas]
    assert [r["alpha"] for r in shared] == pytest.approx([r["alpha"] for r in alphas])
    assert again.coef == pytest.approx(model.coef) and again.intercept == pytest.approx(model.intercept) and again.fill == model.fill


@pytest.mark.parametrize("family", ["poisson", "gamma"])
def test_query_packs_its_cells_once(spark, sf_dir, monkeypatch, family):
    """One table of packed cells for the largest penalty and the fit, and methods the JVM compiles."""
    name, made, limits = "spark.sql.codegen.hugeMethodLimit", [], []
    before, pack = spark.conf.get(name), CellTable.pack.__func__

    def watched(cls, *args, **options):
        limits.append(int(spark.conf.get(name)))
        made.append(pack(cls, *args, **options))
        return made[-1]

    monkeypatch.setattr(CellTable, "pack", classmethod(watched))
    monkeypatch.setattr(CellTable, "build", None)
    monkeypatch.setattr(CellTable, "unwritten", None)
    found = QUERIES[f"m1_wide_optimality_{family}"](spark, sf_dir).collect()
    assert len(found) == len(many.WIDE) and not any(r["n_violations"] for r in found)
    assert len(made) == 1 and limits == [8_000] and spark.conf.get(name) == before
    assert made[0].groups is not None and len(made[0].groups.words) <= 3


def test_prediction_looks_up_what_varies(spark):
    """Equal neighbours need no comparison and a constant predictor no mean; the result is that of all bins."""
    plan = Blueprint.from_lists({"a": [1, 2, 3, 4], "b": [1, 2], "s": ["u", "v"], "c": [1, 2]})
    adds = {"a": [0.5, 0.5, -1.0, -1.0, 0.25], "b": [0.125] * 3, "s": [0.0, 1.0, 1.0], "c": [0.0] * 3}
    model = fixed_model("Poisson", plan, 0.3, adds)
    nan = float("nan")
    data = [(a, b, s, None) for a in (None, nan, 0.0, 1.0, 1.5, 2.0, 3.0, 3.5, 4.0, 9.0) for b, s in ((None, "u"), (5.0, None), (nan, "x"), (0.0, "v"))]
    df = spark.createDataFrame(data, "a double, b double, s string, c double")
    scored = model.predict(df, fill={"a": 2.5})
    for r in scored.collect():
        a = 2.5 if r["a"] is None else r["a"]
        at = 4 if math.isnan(a) else sum(x <= a for x in (1, 2, 3, 4))
        eta = 0.3 + adds["a"][at] + 0.125 + adds["s"][{"u": 0, "v": 1}.get(r["s"], 2)]
        assert r["prediction"] == pytest.approx(math.exp(eta), rel=1e-14)
    text = scored._jdf.queryExecution().analyzed().toString()
    assert "b#" in text and text.count("< 2.0") == 1 and "< 1.0" not in text and "< 3.0" not in text and text.count("< 4.0") == 1


def test_wide_query_writes_portfolio_columns_only(spark, sf_dir, monkeypatch):
    """Columns computed from keys are computed again and not written."""
    written = []
    once = many.pf_once
    monkeypatch.setattr(many, "pf_once", lambda spark, sf, *columns: written.extend(columns) or once(spark, sf, *columns))
    df = many._wide(spark, sf_dir, *many.WIDE, "ClaimNb")
    assert df.columns == [*many.WIDE, "ClaimNb"]
    assert sorted(written) == sorted(["discount", "p_size", "segment", "brand", "ClaimNb", "l_orderkey", "l_linenumber", "l_partkey"])
