"""Session helpers: where shared intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder of this machine.
    """
    root = (
        spark.conf.get(CHECKPOINT_CONF, None)
        or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
        or spark.sparkContext.getCheckpointDir()
    )
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(
            f"Set {CHECKPOINT_CONF} to a folder all executors share; "
            "intermediate tables are written there."
        )
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="premia-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few rows of the driver as a table.

    Arrow makes it a local relation of known size, which Spark joins by broadcast and
    reads without a job.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=fields)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python workers at most so many rows at a time.

    Spark keeps such a batch outside its heap, so rows of large arrays need small ones.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of code up to which the JVM compiles a method; a longer one it interprets for good.
COMPILED_METHOD = 8_000


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """What is run inside has no generated method that is too long for the JVM to compile.

    A projection of dozens of lookups becomes one method of a whole stage; past the bound Spark makes
    functions of its parts instead.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, min(COMPILED_METHOD, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class ScratchTable:
    """A DataFrame written once to the shared folder and read back.

    Reading back gives a plan without history, so a lost executor costs a re-read
    of some files and not a rerun of what produced them.
    """

    def __init__(self, df: DataFrame, label: str, spread: bool = False, **options):
        """``spread`` lets Spark even out the parts of an input before they are written; ``options`` are of the writer."""
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        if spread:
            # A hint and not a look at the parts, which would run the shuffles of an open plan twice.
            df = df.hint("rebalance")
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
