"""Joins whose key may be shared by a large part of all rows, and tables dealt out by a key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.session import scratch_path

#: A key with more than one in so many of all rows is heavy; so at most as many are.
HEAVY = 256


def heavy_values(rows: DataFrame, key: str) -> list:
    """Values of ``key`` that hold more than 1/``HEAVY`` of all rows; null is not among them."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = counts.agg(F.sum("n") / HEAVY).first()[0] or 0
    return [r[0] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull() & (F.col("n") > 1)).collect()]


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left", heavy: list | None = None) -> DataFrame:
    """``rows`` joined to ``table``, which has each value of ``key`` once.

    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``.  Rows with a heavy value
    meet its one row of ``table`` by broadcast (at most ``HEAVY`` rows), so they stay where
    they are; all others are joined as Spark sees fit.  Null matches nothing.  ``rows``
    should be a written table, as it is read up to three times.
    """
    heavy = heavy_values(rows, key) if heavy is None else heavy
    loose = F.col(key).isNull()
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    some = rows.where(F.coalesce(hot, F.lit(False)) | loose)
    few = F.broadcast(table.where(hot))
    rest = rows.where(~loose & ~hot).join(table.where(~hot), key, how)
    return some.join(few, key, how).unionByName(rest)


class Dealt:
    """``df`` written once, dealt out and sorted by ``key``.

    Joins on ``key`` between such tables of equal ``parts`` need no shuffle.  The files lie in
    the shared folder; the name in the session's catalog is dropped with them.
    """

    def __init__(self, df: DataFrame, key: str, parts: int, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        self.name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
