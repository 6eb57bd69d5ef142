"""Pricing GLMs, rate tables and tariffs on Spark."""

from premia.functions.binning import lump_fun, o_matrix
from premia.functions.names import quote_identifier
from premia.functions.split import HOLDOUT_FLAG, TRAIN_FLAG, train_flag
from premia.operators.blueprint import (
    Blueprint,
    VariablePlan,
    generate_blueprint,
    lump_rare_levels,
)
from premia.operators.evaluate import (
    FORMULAS,
    actual_expected,
    compare_actual_expected,
    compute_actual_expected,
    evaluate,
    overall_ratio,
    ratio_by_group,
)
from premia.operators.glm import (
    GlmModel,
    alpha_max,
    fit_glm,
    fit_lasso_glm,
    fixed_model,
    predict_with_model,
)
from premia.operators.prepare import prepare_data
from premia.operators.ratemodel import (
    Change,
    FromToRow,
    ModelMetadata,
    RateModel,
    Snapshot,
    VariableConfig,
    create_rate_model,
)
from premia.operators.ratetable import generate_all_ratetables, ratetable
from premia.operators.validate import validate_train_test_column
from premia.plans.compare import compare_methods
from premia.plans.pipeline import PricingPipeline

__all__ = [
    "Blueprint",
    "Change",
    "FORMULAS",
    "FromToRow",
    "GlmModel",
    "HOLDOUT_FLAG",
    "ModelMetadata",
    "PricingPipeline",
    "RateModel",
    "Snapshot",
    "TRAIN_FLAG",
    "VariableConfig",
    "VariablePlan",
    "actual_expected",
    "alpha_max",
    "compare_actual_expected",
    "compare_methods",
    "compute_actual_expected",
    "create_rate_model",
    "evaluate",
    "fit_glm",
    "fit_lasso_glm",
    "fixed_model",
    "generate_all_ratetables",
    "generate_blueprint",
    "lump_fun",
    "lump_rare_levels",
    "o_matrix",
    "overall_ratio",
    "predict_with_model",
    "prepare_data",
    "quote_identifier",
    "ratetable",
    "ratio_by_group",
    "train_flag",
    "validate_train_test_column",
]
