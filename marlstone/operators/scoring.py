"""Scores: token precision, recall and F1; agreement of two judges; rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T


def exact_counts(right: Column, guess: Column) -> Column:
    """(tp, fp, fn) of two word lists by equality: equal lists count all words, others as sets."""
    equal = right == guess
    tp = F.when(equal, F.size(right)).otherwise(F.size(F.array_intersect(right, guess)))
    fp = F.when(equal, 0).otherwise(F.size(F.array_except(guess, right)))
    fn = F.when(equal, 0).otherwise(F.size(F.array_except(right, guess)))
    return F.struct(tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))


def micro(counts: DataFrame) -> DataFrame:
    """One row: summed tp, fp, fn and precision, recall, f1; all 0 without predictions, recall null without truths."""
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    none = F.col("tp") + F.col("fp") == 0
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    zero = lambda c: F.when(none, F.lit(0.0)).otherwise(c)
    return s.select("tp", "fp", "fn", zero(p).alias("precision"), zero(r).alias("recall"), zero(f1).alias("f1"))


def verdicts(rows: DataFrame, order: str, key: str = "ground_truth", verdict: str = "similarity") -> DataFrame:
    """(key, similar) with canonical keys, the last row of each by ``order``; blank keys fall out."""
    x = rows.filter(T.strip(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
    x = x.select(T.canonical_name(F.col(key).cast("string")).alias("key"), T.as_boolean(F.col(verdict)).alias("similar"), F.col(order).alias("o"))
    return x.groupBy("key").agg(F.max_by("similar", F.struct("o", "similar")).alias("similar"))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: keys in common, both true, their ratio (0 without common keys), and keys of one side only."""
    x = one.withColumnRenamed("similar", "a").join(two.withColumnRenamed("similar", "b"), "key", "full_outer")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    s = x.agg(F.count_if(common).alias("n_common"), F.count_if(F.col("a") & F.col("b")).alias("n_both_true"), F.count_if(F.col("b").isNull()).alias("n_only_first"), F.count_if(F.col("a").isNull()).alias("n_only_second"))
    return s.withColumn("ratio", F.coalesce(F.try_divide("n_both_true", "n_common"), F.lit(0.0)))


def rate(rows: DataFrame, flag: Column) -> DataFrame:
    """One row: how many hold, of how many, and the share (null without rows)."""
    return rows.agg(F.count_if(flag).alias("n_similar"), F.count("*").alias("n_total")).withColumn("rate", F.try_divide("n_similar", "n_total"))


def throughput(rows: DataFrame, started: str, finished: str) -> DataFrame:
    """One row: how many, over which seconds, and how many a second (null without a span of time)."""
    span = F.max(F.unix_micros(F.col(finished).cast("timestamp"))) - F.min(F.unix_micros(F.col(started).cast("timestamp")))
    return rows.agg(F.count("*").alias("n"), (span / 1e6).alias("seconds")).withColumn("per_second", F.try_divide("n", "seconds"))


def vector_verdict(score: Column, threshold: float = 0.7) -> Column:
    """(similarity, similarity_score): the threshold sees the clamped score, the record the rounded one."""
    c = T.clamp(score)
    return F.struct((c >= threshold).alias("similarity"), F.bround(c, 4).alias("similarity_score"))
