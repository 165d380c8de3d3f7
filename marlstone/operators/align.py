"""Alignment of blocks: candidates of equal type, a blended score, and a greedy one-to-one choice.

Pairs meet in an equi-join on (group, type); the greedy choice runs once per group over its scored pairs, in Arrow
batches of whole groups. A group is a function's blocks, which a function's size bounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import similarity as S

ALPHA, THRESHOLD, KEYWORD = 0.8, 0.3, 0.9
NOT_ALIGNED = ("full_function", "function_definition")


def scored_pairs(left: DataFrame, right: DataFrame, group: str, kind: str, semantic: Column | None = None, alpha: float = ALPHA) -> DataFrame:
    """(group, kind, left_id, left_pos, right_id, right_pos, structure_score, semantic_score, final_score).

    Both sides: group, kind, id, pos, paths (array<string>), vec, keyword. Equal keywords score KEYWORD outright.
    """
    side = lambda df, p: df.filter(~F.col(kind).isin(*NOT_ALIGNED)).select(group, kind, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "pos", "paths", "vec", "keyword")])
    x = side(left, "left").join(side(right, "right"), [group, kind])
    x = x.withColumn("structure_score", S.jaccard(F.col("left_paths"), F.col("right_paths")))
    x = x.withColumn("semantic_score", S.cosine(F.col("left_vec"), F.col("right_vec")) if semantic is None else semantic)
    blended = F.lit(alpha) * F.col("structure_score") + F.lit(1 - alpha) * F.col("semantic_score")
    x = x.withColumn("final_score", F.when(F.col("left_keyword") == F.col("right_keyword"), F.lit(KEYWORD)).otherwise(blended))
    return x.select(group, kind, "left_id", "left_pos", "right_id", "right_pos", "structure_score", "semantic_score", "final_score")


def greedy(pairs: DataFrame, group: str, threshold: float = THRESHOLD) -> DataFrame:
    """Each left block, in order, takes the best right block that is still free; the first of equals; from threshold up."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for _, own in rows.sort_values(["left_pos", "right_pos"]).groupby("left_pos", sort=True):
            free = own[~own["right_id"].isin(used) & (own["final_score"] > 0)]
            if len(free) and free["final_score"].max() >= threshold:
                best = free.loc[free["final_score"].idxmax()]
                used.add(best["right_id"])
                out.append(best.name)
        return rows.loc[out]

    # Pairs under the threshold can never be chosen.
    return pairs.filter(F.col("final_score") >= threshold).groupBy(group).applyInPandas(choose, pairs.schema)


def snippets(blocks: DataFrame, functions: DataFrame, matches: DataFrame, aligned: DataFrame) -> DataFrame:
    """(func, input, output, history): descriptions of a function and of its blocks, told of its aligned counterpart.

    blocks: (func, block, pos, output); functions: (func, output); matches: (func, block, other_block, other_code);
    aligned: (func, code). A block without a match falls out of the history, a function without a counterpart is lost.
    ``history``: (block, input, output) by the counterpart's block, of two with the same one the later.
    """
    h = blocks.join(matches, ["func", "block"]).groupBy("func", "other_block").agg(F.max_by(F.struct("pos", "other_code", "output"), "pos").alias("h"))
    h = h.groupBy("func").agg(F.sort_array(F.collect_list(F.struct("h.pos", F.col("other_block").alias("block"), F.col("h.other_code").alias("input"), "h.output"))).alias("history"))
    x = functions.join(aligned.select("func", F.col("code").alias("input")), "func").join(h, "func", "left")
    none = F.array().cast("array<struct<block:string,input:string,output:string>>")
    return x.select("func", "input", "output", F.coalesce(F.transform("history", lambda s: F.struct(s["block"].cast("string").alias("block"), s["input"].alias("input"), s["output"].alias("output"))), none).alias("history"))


def best_candidate(pairs: DataFrame, by: str) -> DataFrame:
    """The best pair of each ``by``, the first of equals."""
    best = F.max_by(F.struct(*[c for c in pairs.columns if c != by]), F.struct("final_score", (-F.col("right_pos")).alias("p")))
    return pairs.groupBy(by).agg(best.alias("_r")).select(by, "_r.*")
