"""The optimality query of many features: what it counts, and that a single pass writes nothing."""

import numpy as np
import pytest

from premia.operators import cells
from premia.operators.blueprint import Blueprint
from premia.operators.glm import alpha_max
from workload import many
from workload.registry import QUERIES


def test_violations_are_counted(spark, sf_dir, monkeypatch):
    plain = many.fit_glm

    def worse(*args, **options):
        model = plain(*args, **options)
        on = int(np.flatnonzero(model.coef)[0])
        model.coef[on] *= -1
        worse.changed = model.features[on].variable
        return model

    monkeypatch.setattr(many, "fit_glm", worse)
    found = {r["variable"]: r["n_violations"] for r in QUERIES["m1_wide_optimality_poisson"](spark, sf_dir).collect()}
    assert found[worse.changed] == 1 and sum(found.values()) == 1


def test_largest_penalty_takes_one_unwritten_pass(policies, monkeypatch):
    plan = Blueprint.from_lists({"VehAge": [3, 6, 9], "DrivAge": [30, 40, 50], "Region": ["North", "South"]})
    roles = {"weight_col": "Exposure", "divide_target_by_weight": True}
    ask = lambda: alpha_max(policies, "ClaimNb", "Poisson", list(plan), plan, **roles).collect()
    want = ask()

    def refuse(*_, **__):
        raise AssertionError("cells were written")

    monkeypatch.setattr(cells, "FEW_CELLS", 1)
    monkeypatch.setattr(cells, "ScratchTable", refuse)
    got = ask()
    assert [r["feature"] for r in got] == [r["feature"] for r in want]
    assert [r["alpha"] for r in got] == pytest.approx([r["alpha"] for r in want])
