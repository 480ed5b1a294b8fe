"""Small helpers on columns and names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have: ``wanted`` with underscores in front if need be."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
