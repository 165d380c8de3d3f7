"""First-wins deduplication, last-wins merging and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: Column | str, order: list) -> DataFrame:
    """The first row of each key; rows with a null key are all kept.

    The choice is a minimum of (order, row) and so is combined before the shuffle; a hot key moves a row per task.
    Rows are dealt out by the key, which may be a digest of what is long.
    """
    key = F.col(key) if isinstance(key, str) else key
    order_struct = F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)])
    x = rows.withColumn("_k", key)
    single = x.filter("_k is null").drop("_k")
    won = x.filter("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*rows.columns), order_struct).alias("_r")).select("_r.*")
    return won.unionByName(single)


def two_stage(rows: DataFrame, name: str, body: str, order: list, usable: Column | None = None) -> DataFrame:
    """First by name over all rows, then (of usable ones) first by body. ``order`` tells all rows apart.

    Both choices are made on names and SHA-256 digests of bodies; the rows themselves move once, to meet the chosen.
    """
    digest = F.sha2(F.col(body).cast("binary"), 256)
    thin = rows.select(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(name).alias("n"), digest.alias("b"), (F.lit(True) if usable is None else usable).alias("u"))
    won = first_by(first_by(thin, "n", keys := [f"o{i}" for i in range(len(order))]).filter("u"), "b", keys)
    meet = [rows[o].eqNullSafe(won[k]) for o, k in zip(order, keys, strict=True)]
    return rows.join(won, meet, "left_semi")


def replayed(names: DataFrame, name: str, saved: DataFrame, **options) -> DataFrame:
    """(name, split) as ``saved`` has it; names that it does not know are split among themselves."""
    new = split(names.join(saved.select(name), name, "left_anti"), name, **options)
    return names.select(name).distinct().join(saved.select(name, "split"), name).unionByName(new)


def last_by(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Last-wins merge of rows by key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def split(names: DataFrame, name: str, parts: tuple[tuple[str, float], ...] = (("train", 0.8), ("test", 0.1), ("validation", 0.1)), seed: str = "split") -> DataFrame:
    """(name, split): names in order of a seeded digest, cut at the parts' floors; the last part takes the rest.

    Ranks come from counts of digest prefixes, so no task holds all names.
    """
    x = names.select(name).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = x.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 rows at most
    ahead = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    r = x.join(F.broadcast(ahead), "_b").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h", name)) - 1 + F.col("_ahead"))
    out, share = F.lit(parts[-1][0]), 0.0
    bounds = []
    for label, p in parts[:-1]:
        share += p
        bounds.append((label, share))
    for label, s in reversed(bounds):
        out = F.when(F.col("_r") < F.floor(F.lit(s) * F.col("_total")), label).otherwise(out)
    return r.select(name, out.alias("split"))
