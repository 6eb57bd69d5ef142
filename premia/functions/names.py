"""Column names that may hold spaces, dots, quotes or reserved words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_identifier(name: str) -> str:
    """``name`` as a back-ticked Spark identifier."""
    if not isinstance(name, str):
        raise TypeError(f"A column name is text, not {type(name).__name__}.")
    if not name.strip():
        raise ValueError("A column name needs at least one visible character.")
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column called exactly ``name``, dots and all."""
    return F.col(quote_identifier(name))


def rename_columns(df, mapping: dict[str, str] | None):
    """Rename data columns to model names; names that are absent are left out."""
    present = {old: new for old, new in (mapping or {}).items() if old in df.columns}
    return df.withColumnsRenamed(present) if present else df
