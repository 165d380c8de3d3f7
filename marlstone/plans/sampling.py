"""Samples of a bounded number of rows, drawn by hash, whose traffic to the driver does not grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 62


def place(*keys: str | Column) -> Column:
    """Place of a row in the order that samples follow: 62 bits of hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 2)


def _thinned(df: DataFrame, n: int, keys: list[str | Column], total: int) -> DataFrame:
    """Rows below a threshold on the hash, set from the number of rows so that about 2n are left, n at least."""
    if total > 4 * n:
        some = df.filter(place(*keys) < F.lit(int(SPAN * (2 * n + 64) / total)))
        if some.count() >= min(n, total):
            return some
    return df


def hash_sample(df: DataFrame, n: int, keys: list[str | Column], order: list[str | Column] = (), total: int | None = None) -> DataFrame:
    """The ``n`` rows that come first by hash of ``keys``, then by ``order``. ``total``: the number of rows, if known.

    Few more than these are sorted, so all partitions together ship about 2n. Keys with a large share of the rows are in
    or out together; the limit still holds.
    """
    return _thinned(df, n, keys, df.count() if total is None else total).orderBy(place(*keys), *order).limit(n)


def hash_filter(df: DataFrame, n: int, keys: list[str | Column]) -> DataFrame:
    """The rows of ``hash_sample``, found by a filter: they stay where they are, only places come to the driver. Rows
    that tie with the last one are in too."""
    p = place(*keys)
    got = _thinned(df, n, keys, df.count()).select(p.alias("p")).orderBy("p").limit(n).toArrow().column(0)
    return df.filter(p <= F.lit(got[-1].as_py())) if len(got) else df
