"""Score a stream of portfolio files.

Scoring keeps no state, so any tariff or model that needs no batch mean runs on a stream
as it is; restarting from the checkpoint neither loses nor repeats a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from premia.operators.glm import GlmModel
from premia.operators.ratemodel import RateModel


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("header", True) if format == "csv" else reader).load(path)


def score_stream(
    stream: DataFrame, model: RateModel | GlmModel, output_col: str = "prediction", **options
) -> DataFrame:
    if isinstance(model, GlmModel):
        options.setdefault("fill", "train")
        return model.predict(stream, output_col, **options)
    return model.predict(stream, output_col=output_col, **options)


def write_scored(
    scored: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
