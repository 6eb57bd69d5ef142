"""A fitted pipeline as a folder of tables: nothing in it is a pickle."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from premia.operators.blueprint import Blueprint
from premia.operators.glm import Feature, GlmModel
from premia.session import local_table
from premia.sources.tables import read_rate_tables, write_rate_tables
from premia.sources.tariff_json import read_tariff, write_tariff


def _write_json(spark: SparkSession, value: dict, path: str, mode: str) -> None:
    text = json.dumps(value, ensure_ascii=False)
    local_table(spark, [(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _finite(x: float) -> float | None:
    return float(x) if np.isfinite(x) else None


def save_model(spark: SparkSession, model: GlmModel, path: str, mode: str) -> None:
    model.blueprint.to_dataframe(spark).coalesce(1).write.mode(mode).parquet(
        f"{path}/model_blueprint"
    )
    model.coefficients(spark).coalesce(1).write.mode(mode).parquet(f"{path}/coefficients")
    model.contribution_table(spark).coalesce(1).write.mode(mode).parquet(
        f"{path}/contributions"
    )
    _write_json(
        spark,
        {
            "family": model.family,
            "plans": list(model.blueprint),
            "predictors": model.predictors,
            "alpha": model.alpha,
            "l1_ratio": model.l1_ratio,
            "fill": model.fill,
            "grid": model.grid,
            "train_deviance": _finite(model.train_deviance),
            "gap": _finite(model.gap),
        },
        f"{path}/model",
        mode,
    )


def load_model(spark: SparkSession, path: str) -> GlmModel:
    meta = _read_json(spark, f"{path}/model")
    plans = spark.read.parquet(f"{path}/model_blueprint")
    coefs = spark.read.parquet(f"{path}/coefficients").orderBy("ord").collect()
    effects: dict[str, list[float]] = {}
    slopes: dict[str, float] = {}
    rows = spark.read.parquet(f"{path}/contributions").orderBy("variable", "bin").collect()
    for r in rows:
        if r["bin"] is None:
            slopes[r["variable"]] = r["contribution"]
        else:
            effects.setdefault(r["variable"], []).append(r["contribution"])
    order = meta["predictors"]
    deviance = meta["train_deviance"]
    return GlmModel(
        family=meta["family"],
        blueprint=Blueprint.from_dataframe(plans, meta["plans"]),
        predictors=order,
        features=[Feature(r["variable"], r["feature"]) for r in coefs[1:]],
        coef=np.array([r["coef"] for r in coefs[1:]]),
        intercept=coefs[0]["coef"],
        alpha=meta["alpha"],
        l1_ratio=meta["l1_ratio"],
        contributions={v: effects[v] for v in order if v in effects},
        raw_slopes={v: slopes[v] for v in order if v in slopes},
        fill=meta["fill"],
        grid=[tuple(g) for g in meta["grid"]],
        train_deviance=float("nan") if deviance is None else deviance,
        gap=meta["gap"] or 0.0,
    )


def save_pipeline(spark: SparkSession, pipeline, path: str, mode: str = "errorifexists") -> None:
    path = path.rstrip("/")
    pipeline.blueprint.to_dataframe(spark).coalesce(1).write.mode(mode).parquet(
        f"{path}/blueprint"
    )
    save_model(spark, pipeline.model, f"{path}/glm", mode)
    write_rate_tables(pipeline.rates, f"{path}/rate_tables", mode)
    write_tariff(spark, pipeline.rate_model, f"{path}/rate_model", mode)
    config = {"predictors": pipeline.predictors, "plans": list(pipeline.blueprint)}
    _write_json(spark, config, f"{path}/config", mode)


def load_parts(spark: SparkSession, path: str) -> dict:
    path = path.rstrip("/")
    config = _read_json(spark, f"{path}/config")
    return {
        "blueprint": Blueprint.from_dataframe(
            spark.read.parquet(f"{path}/blueprint"), config["plans"]
        ),
        "model": load_model(spark, f"{path}/glm"),
        "rate_model": read_tariff(spark, f"{path}/rate_model"),
        "predictors": config["predictors"],
        "rates": read_rate_tables(spark, f"{path}/rate_tables"),
    }
