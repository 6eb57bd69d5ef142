"""Shards along a Hilbert curve over several columns.

Each column is quantised: numbers by their magnitude, texts by a hash.  Rows sorted by curve
index lie near rows that are like them in all columns at once, so a shard, which is a run
of that order, covers a small box, and readers skip files by the least and greatest values.

Defined results: null values are a cell of their own; a null text has no bytes; ties of the
curve go by text hash and id; repeated rows take places one after another; counts of shards
differ by one at most; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.order import ranked
from premia.llm.tables import text_of

BITS = 8


def curve_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of ``points`` (whole numbers under ``2 ** bits``)."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> level & 1)
    return out


def magnitude(value: Column) -> Column:
    """Eight cells per doubling, from 0 to 255."""
    return F.least(F.floor(8 * F.log2(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)), F.lit(255)).cast("int")


def cell(value: Column) -> Column:
    return F.when(value.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(value), F.lit(255))).cast("int")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("cells").flatten().to_numpy()
        points = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(curve_index(points))], ["id", "size", "text_crc32", "curve"])


def shard_documents(
    docs: DataFrame, shards: int = 40, dimensions: Sequence[str] = ("lang", "source"), text: str = "text", id: str = "doc_id", extra: int = 16
) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot): runs of the curve, equal in rows."""
    body = text_of(text)
    size = (F.octet_length(body) + extra).cast("long")
    cells = F.array(*[cell(F.col(c)) for c in dimensions], magnitude(size))
    slim = docs.select(F.col(id).alias("id"), size.alias("size"), F.crc32(body).alias("text_crc32"), cells.alias("cells"))
    kind = docs.schema[id].dataType.simpleString()
    placed = ranked(slim.mapInArrow(_index, f"id {kind}, size long, text_crc32 long, curve long"), ["curve", "text_crc32", "id"], label="hilbert")
    n = placed.count()
    p = F.col("position")
    # Shard s holds the places from ceil(s * n / shards) on.
    shard = F.expr(f"(position * {shards}) div {max(n, 1)}") if n else F.lit(0).cast("long")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", p - first).withColumn("shard", F.col("shard").cast("int")).drop("position")
