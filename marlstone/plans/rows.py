"""Whole rows carried beside working columns, whatever the rows' own columns are called."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly that name, dots and spaces included."""
    return F.col(f"`{re.sub('`', '``', name)}`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "row", **new: Column) -> DataFrame:
    """The rows again, with columns of ``new`` in place of the old."""
    return df.select(*[new[c].alias(c) if c in new else F.col(name).getField(c).alias(c) for c in columns])
