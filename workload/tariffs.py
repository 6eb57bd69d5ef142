"""The tariff and the model effects with which the queries score, and the same in SQL."""

from __future__ import annotations

from premia.operators.blueprint import Blueprint
from premia.operators.glm import GlmModel, fixed_model
from premia.operators.ratemodel import FromToRow, ModelMetadata, RateModel, VariableConfig

BASE_RATE = 0.1
DISCOUNT = ((None, 0.02, 0.82), (0.02, 0.04, 0.96), (0.04, 0.06, 1.07), (0.06, 0.08, 1.24),
            (0.08, None, 1.6))
# The last range lies beyond all sizes, so that one bin is empty.
SIZE = ((None, 10, 0.8), (10, 20, 0.9), (20, 30, 1.0), (30, 40, 1.1), (40, 60, 1.25),
        (60, None, 2.0))
SEGMENT = (("AUTOMOBILE", 1.05), ("BUILDING", 1.5), ("MACHINERY", 0.7))
OTHER_SEGMENT = 1.0


def _ranges(rows) -> VariableConfig:
    return VariableConfig(
        "numeric",
        tuple(
            FromToRow(None if a is None else float(a), None if b is None else float(b), None, x)
            for a, b, x in rows
        ),
    )


def tariff(exposure: bool = False, weight: bool = True, segment: str = "segment") -> RateModel:
    levels = tuple(FromToRow(None, None, lv, x) for lv, x in SEGMENT)
    model = RateModel(
        BASE_RATE,
        {
            "discount": _ranges(DISCOUNT),
            "p_size": _ranges(SIZE),
            segment: VariableConfig(
                "categorical", (*levels, FromToRow(None, None, None, OTHER_SEGMENT))
            ),
        },
        ModelMetadata(
            model_type="poisson",
            target="ClaimNb",
            weight_col="Exposure" if weight else None,
            exposure_col="Exposure" if exposure else None,
            train_test_col="traintest",
            predictor_variables=("discount", "p_size", segment),
        ),
    )
    return model.create_snapshot("Base model")


def revised_tariff(**options) -> RateModel:
    """Two edits, saved as version 2."""
    model = tariff(**options)
    model = model.update_relativity("discount", 0.02, 0.04, 2.0)
    model = model.update_relativity("segment", "BUILDING", "BUILDING", 1.2)
    return model.create_snapshot("Second version")


def case_sql(rows, x: str) -> str:
    whens = "".join(f" WHEN {x} < {b}::DOUBLE THEN {v}::DOUBLE" for _, b, v in rows if b is not None)
    return f"(CASE{whens} ELSE {rows[-1][2]}::DOUBLE END)"


def ord_sql(rows, x: str) -> str:
    whens = "".join(
        f" WHEN {x} < {b}::DOUBLE THEN {i}" for i, (_, b, _v) in enumerate(rows) if b is not None
    )
    return f"(CASE{whens} ELSE {len(rows) - 1} END)"


def segment_sql(x: str = "segment", levels=SEGMENT) -> str:
    whens = "".join(f" WHEN {x} = '{lv}' THEN {v}::DOUBLE" for lv, v in levels)
    return f"(CASE{whens} ELSE {OTHER_SEGMENT}::DOUBLE END)"


def segment_ord_sql(x: str = "segment") -> str:
    whens = "".join(f" WHEN {x} = '{lv}' THEN {i}" for i, (lv, _) in enumerate(SEGMENT))
    return f"(CASE{whens} ELSE {len(SEGMENT)} END)"


DISCOUNT_V2 = tuple((a, b, 2.0 if a == 0.02 else v) for a, b, v in DISCOUNT)
SEGMENT_V2 = tuple((lv, 1.2 if lv == "BUILDING" else v) for lv, v in SEGMENT)


def premium_sql(segment: str = "segment", version: int = 1) -> str:
    discount = DISCOUNT if version == 1 else DISCOUNT_V2
    levels = SEGMENT if version == 1 else SEGMENT_V2
    return (
        f"({BASE_RATE}::DOUBLE * {case_sql(discount, 'discount')} * {case_sql(SIZE, 'p_size')}"
        f" * {segment_sql(segment, levels)})"
    )


# Effects per bin of a model on the linear predictor.
PLAN = Blueprint.from_lists(
    {"tax_null": [0.02, 0.04, 0.06], "p_size": [10, 25, 40], "segment_null": ["BUILDING", "MACHINERY"]}
)
EFFECTS = {
    "tax_null": [0.30, 0.10, -0.05, 0.0],
    "p_size": [-0.40, -0.10, 0.05, 0.20],
    "segment_null": [0.40, -0.35, 0.05],
}
INTERCEPT = -1.5


def effects_model(family: str = "poisson") -> GlmModel:
    return fixed_model(family, PLAN, INTERCEPT, EFFECTS)


def _effect(name: str, x: str) -> str:
    values = EFFECTS[name]
    plan = PLAN[name]
    if plan.kind == "numeric":
        whens = "".join(
            f" WHEN {x} < {b}::DOUBLE THEN ({v})::DOUBLE" for b, v in zip(plan.breaks, values)
        )
    else:
        whens = "".join(
            f" WHEN {x} = '{lv}' THEN ({v})::DOUBLE" for lv, v in zip(plan.levels, values)
        )
    return f"(CASE{whens} ELSE ({values[-1]})::DOUBLE END)"


def eta_sql(tax="tax_null", size="p_size", segment="segment_null") -> str:
    return (
        f"(({INTERCEPT})::DOUBLE + {_effect('tax_null', tax)} + {_effect('p_size', size)}"
        f" + {_effect('segment_null', segment)})"
    )
