"""Links, deviances and error measures, per row and as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("poisson", "gamma", "gaussian", "binomial")

# Floors and clips under which results must agree.
POSITIVE_FLOOR = 1e-9
PROBABILITY_EPS = 1e-15
GAMMA_PREDICTION_FLOOR = 1e-6


def family_name(model_type: str) -> str:
    name = model_type.lower() if isinstance(model_type, str) else model_type
    if name not in FAMILIES:
        raise ValueError(f"Unknown model type {model_type!r}; one of {', '.join(FAMILIES)} is needed.")
    return name


def inverse_link(eta: Column, family: str) -> Column:
    """Mean from the linear predictor: log, logit or identity link."""
    family = family_name(family)
    if family == "gaussian":
        return eta
    if family == "binomial":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    return F.exp(eta)


def unit_deviance(y: Column, p: Column, family: str) -> Column:
    """Deviance of one row, so that the mean of it is the model's deviance."""
    family = family_name(family)
    if family == "gaussian":
        return F.pow(y - p, F.lit(2.0))
    if family == "binomial":
        q = F.greatest(F.least(p, F.lit(1 - PROBABILITY_EPS)), F.lit(PROBABILITY_EPS))
        return -2.0 * (y * F.log(q) + (1.0 - y) * F.log(1.0 - q))
    q = F.greatest(p, F.lit(POSITIVE_FLOOR))
    if family == "gamma":
        return 2.0 * ((y - q) / q - F.log(y / q))
    t = F.greatest(y, F.lit(POSITIVE_FLOOR))
    return 2.0 * F.when(y == 0, q).otherwise(t * F.log(t / q) - (t - q))


def deviance(y: Column, p: Column, family: str) -> Column:
    return F.avg(unit_deviance(y, p, family))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def clip_prediction(p: Column, family: str) -> Column:
    """Clip applied before methods are compared."""
    family = family_name(family)
    if family == "gamma":
        return F.greatest(p, F.lit(GAMMA_PREDICTION_FLOOR))
    if family == "binomial":
        return F.greatest(F.least(p, F.lit(1 - PROBABILITY_EPS)), F.lit(PROBABILITY_EPS))
    return p


def metric_aggregates(y: Column, p: Column, family: str) -> list[Column]:
    return [
        deviance(y, p, family).alias("deviance"),
        rmse(y, p).alias("rmse"),
        mae(y, p).alias("mae"),
    ]
