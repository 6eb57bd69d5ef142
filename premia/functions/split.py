"""Reproducible splits and samples: a row's place depends on its key alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAIN_FLAG = 1
HOLDOUT_FLAG = 0


def hash32(*keys: Column, method: str = "md5") -> Column:
    """A number in [0, 2^32) from the text of the keys.

    ``md5`` can be recomputed in any engine; ``xxhash64`` is several times cheaper.
    """
    if method == "xxhash64":
        return F.pmod(F.xxhash64(*keys), F.lit(1 << 32))
    text = keys[0].cast("string") if len(keys) == 1 else F.concat_ws("-", *keys)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def train_flag(*keys: Column, percent: int = 70, method: str = "md5") -> Column:
    """1 for about ``percent`` of the keys, else 0; rerunning gives the same flags."""
    return F.when(
        hash32(*keys, method=method) % 100 < percent, TRAIN_FLAG
    ).otherwise(HOLDOUT_FLAG)
