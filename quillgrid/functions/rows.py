"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later ones refer to without working them out again.

    The optimizer puts an expression into the places that use it, also into lambdas over arrays, where it would be worked
    out for each element; it doesn't do so across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
