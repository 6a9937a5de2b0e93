"""Small helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so both engines print the same digits."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])
