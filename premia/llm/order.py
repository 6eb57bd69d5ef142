"""Positions of rows in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.tables import written
from premia.session import local_table


def ranked(df: DataFrame, by: list[str], within: str | None = None, label: str = "ranked") -> DataFrame:
    """``df`` with ``position``, from 0, in the order of ``by``; or in each ``within`` alone.

    ``within`` must be the first of ``by``.  Rows are dealt out by ranges of the whole key,
    so rows with equal first columns spread over tasks; a sorted copy is written once.  The
    driver sees one count per task, and with ``within`` one per task and value in it: tasks
    hold ranges, so these are at most as many as tasks and values together.
    """
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    table = written(spread.withColumn("__row", F.monotonically_increasing_id()), label)
    task, at = F.shiftright("__row", 33), F.col("__row").bitwiseAND((1 << 33) - 1)
    keys = [task.alias("__task")] + ([F.col(within).alias("__within")] if within else [])
    parts = sorted(
        (tuple(r) for r in table.groupBy(*keys).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).collect()),
        key=lambda r: (r[0], r[-2]),
    )
    rows, before, last = [], 0, None
    for part in parts:
        value = part[1] if within else None
        if within and value != last:
            before, last = 0, value
        rows.append((part[0], *((value,) if within else ()), before - part[-2]))
        before += part[-1]
    kind = f", __within {table.schema[within].dataType.simpleString()}" if within else ""
    shifts = local_table(df.sparkSession, rows, f"__task bigint{kind}, __shift bigint")
    on = [task == shifts["__task"]] + ([table[within].eqNullSafe(shifts["__within"])] if within else [])
    joined = table.join(shifts, on)
    return joined.select(*[table[c] for c in df.columns], (at + F.col("__shift")).alias("position"))
