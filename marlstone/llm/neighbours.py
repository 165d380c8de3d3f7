"""Approximate nearest neighbours by NN-descent and greedy graph search, for the largest inner product.

Graph. Equal vectors count once (class representative: smallest id). Vectors go to the cells of pivots, the square root
of their number (at most ``PIVOTS``), drawn by hash (which is all that is fitted on a sample; every vector is indexed),
and cells to blocks of about ``BLOCK``. Blocks give each vector its first ``K`` neighbours; NN-descent then joins, at every
vector, its neighbours and reverse neighbours with each other (neighbours of neighbours), and keeps the best K, until less
than ``SETTLED`` of all links change; no number of rounds ends it before. Joins ship each vector once per block of vectors
that needs it. Reverse lists of much-linked vectors are thinned by hash to about K; that is the method's own sampling.

Search. Queries start from their own lists and expand the ``WIDTH`` best unexpanded vectors of a pool of ``POOL``, until
every vector of the pool is expanded; all queries of a block are scored in double precision against everything that the block reaches. Classes
are expanded at the end: the first k + 1 members of a class are all that can enter a result.

* null vectors, zero vectors, and vectors that hold null or non-finite components take no part, as query or candidate;
* vectors of unequal length have no inner product: the most common length takes part (of equally common ones the least);
* null ids take no part; ties: smaller id first; equal vectors: exact, by classes; fewer candidates than k: all of them;
* repeated rows: rows with the same id and vector count as one candidate; rows of one id and other vectors as several;
* empty table: empty result; extra columns: only id and vector are read, so clashing names do not matter.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.plans.rows import col
from marlstone.plans.sampling import hash_sample
from marlstone.plans.storage import Cut, cut

K = 40  #: neighbours of each vector in the graph
PIVOTS = 65_536
BLOCK = 512
SETTLED = 0.06  #: share of changed links below which NN-descent ends
SENT = 10  #: better neighbours that a block reports for a vector
POOL = 80
WIDTH = 40


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the vectors that take part; x as doubles."""
    v = F.transform(col(vec_col), lambda c: c.cast("double"))
    r = rows.select(col(id_col).cast("long").alias("id"), v.alias("x")).filter("id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    r = r.filter(finite & F.exists("x", lambda c: c != 0))
    common = r.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "n").first()
    return r.filter(F.size("x") == (common["n"] if common else 0)).dropDuplicates(["id", "x"])


def _cells(vectors: DataFrame, n: int) -> DataFrame:
    """(cell, rank, id, x): each vector in the cells of its two nearest pivots; rank 0 is its home."""
    n_pivots = 1 if n <= BLOCK else min(PIVOTS, int(math.sqrt(n)))
    pivots = np.array([r["x"] for r in hash_sample(vectors, n_pivots, ["id"], ["id", "x"], n).collect()], np.float32)
    known = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            p = known.value / np.maximum(np.linalg.norm(known.value, axis=1, keepdims=True), 1e-30)
            ranks = min(2, len(p))
            x = _matrix(b.column(1)).astype(np.float32)
            near = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :ranks]
            take = np.repeat(np.arange(len(x)), ranks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(ranks, dtype=np.int32), len(x))), b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take))],
                names=["cell", "rank", "id", "x"],
            )

    return vectors.mapInArrow(run, "cell int, rank int, id bigint, x array<double>")


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    """(block, rank, id, x): cells cut by hash into blocks of about BLOCK. There are at most PIVOTS cells."""
    cells = Cut(_cells(vectors, n), "cells")
    parts = cells.df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    b = cells.df.join(F.broadcast(parts), "cell")
    b = cut(b.select((F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "rank", "id", "x"), "blocks")
    cells.drop()
    return b


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k best."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))


def _first_lists(key, table):
    ids, x = table.column("id").to_numpy(), _matrix(table.column("x")).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = _best(s, min(K, len(ids) - 1)) if len(ids) > 1 else np.empty((len(ids), 0), np.int64)
    u = np.repeat(ids, best.shape[1])
    score = np.take_along_axis(s, best, axis=1).ravel() if best.size else np.empty(0, np.float32)
    return pa.table({"u": u, "v": ids[best.ravel().astype(np.int64)], "s": score.astype(np.float64)}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64())]))


def _keep_best(links: DataFrame) -> DataFrame:
    """The K best of each u; a link met again is not new. One shuffle, by u."""
    one = links.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    r = F.row_number().over(W.partitionBy("u").orderBy(F.col("s").desc(), "v"))
    return one.withColumn("r", r).filter(F.col("r") <= K).drop("r")


def _local_join(key, links, vectors):
    """At each u of the block: pairs of its neighbours, one of them new, that better i's list. (u, v, s) of the best of each i."""
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    if not len(links) or not len(vectors):
        return none
    ids = vectors.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    x, least = _matrix(vectors.column("x")).astype(np.float32)[order], vectors.column("least").to_numpy()[order].astype(np.float32)
    u, v, new = links.column("u").to_numpy(), links.column("v").to_numpy(), links.column("new").to_numpy(zero_copy_only=False).astype(bool)
    o = np.lexsort((new, v, u))
    u, at, new = u[o], np.searchsorted(ids, v[o]), new[o]
    cuts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    found_i, found_j, found_s, held = [], [], [], 0

    def reduce_found():
        i, j, s = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_s)
        _, first = np.unique(i * np.int64(len(ids)) + j, return_index=True)
        i, j, s = i[first], j[first], s[first]
        by = np.lexsort((j, -s, i))
        i, j, s = i[by], j[by], s[by]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        return [i[rank < SENT]], [j[rank < SENT]], [s[rank < SENT]]

    for a, b in zip(cuts, np.append(cuts[1:], len(u)), strict=True):
        m, first = np.unique(at[a:b], return_index=True)  # sorted by new: an old link counts before a new one
        fresh = new[a:b][first]
        if len(m) < 2 or not fresh.any():
            continue
        y = x[m]
        s = y @ y.T
        ok = (s > least[m][:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok)
        found_i.append(m[i])
        found_j.append(m[j])
        found_s.append(s[i, j])
        held += len(i)
        if held > 2_000_000:
            found_i, found_j, found_s = reduce_found()
            held = len(found_i[0])
    if not held:
        return none
    (i,), (j,), (s,) = reduce_found()
    return pa.table({"u": ids[i], "v": ids[j], "s": s.astype(np.float64)})


def graph(vectors: DataFrame, blocks: DataFrame) -> DataFrame:
    """(u, v, s, new): the K nearest found of every vector. ``blocks``: a written table of _blocks."""
    home = blocks.filter("rank = 0").select("id", "block", "x")
    first = blocks.groupBy("block").applyInArrow(_first_lists, "u bigint, v bigint, s double").withColumn("new", F.lit(True))
    lists = Cut(_keep_best(first), "graph")
    for t in itertools.count():  # a list only ever gets better, so the share of changes falls
        into = lists.df.groupBy("v").agg(F.count("*").alias("into"))
        worst = lists.df.groupBy("u").agg(F.min("s").alias("least"), F.count("*").alias("n"))
        m = home.select("id", "block").join(into, F.col("id") == into["v"], "left").join(worst, F.col("id") == worst["u"], "left")
        meta = Cut(m.select("id", "block", F.coalesce("into", F.lit(0)).alias("into"), F.when(F.col("n") >= K, F.col("least")).otherwise(F.lit(-1e300)).alias("least")), "meta")
        own = meta.df.select(F.col("id").alias("u"), "block")
        ahead = lists.df.join(own, "u").select("block", "u", "v", "new")
        target = meta.df.select(F.col("id").alias("v"), "block", "into")
        chance = F.pmod(F.xxhash64("u", "v", F.lit(t)), F.lit(1 << 20)) * F.col("into") < F.lit(K << 20)
        back = lists.df.join(target, "v").filter(chance).select("block", F.col("v").alias("u"), F.col("u").alias("v"), "new")
        edges = Cut(ahead.unionByName(back), "edges")
        ids = home.join(meta.df.select("id", "least"), "id").select("id", F.transform("x", lambda c: c.cast("float")).alias("x"), "least")
        wanted = edges.df.select("block", F.col("v").alias("id")).distinct().join(ids, "id").select(F.col("block").alias("at"), "id", "x", "least")
        better = edges.df.groupBy("block").cogroup(wanted.groupBy("at")).applyInArrow(_local_join, "u bigint, v bigint, s double")
        both = lists.df.withColumn("new", F.lit(False)).unionByName(better.withColumn("new", F.lit(True)))
        after = Cut(_keep_best(both), "graph")
        n = after.df.agg(F.sum(F.col("new").cast("long")).alias("new"), F.count("*").alias("all")).first()
        for x in (lists, meta, edges):
            x.drop()
        lists = after
        if not n["all"] or n["new"] < SETTLED * n["all"]:
            break
    return lists.df


def _score(key, queries, found):
    """The POOL best of what the block reaches, for each of its queries, in double precision."""
    q, qx = queries.column("q").to_numpy(), _matrix(queries.column("x"))
    v, vx = found.column("id").to_numpy(), _matrix(found.column("x"))
    out_q, out_v, out_s = [], [], []
    if len(q) and len(v):
        for a in range(0, len(q), 256):
            s = qx[a : a + 256] @ vx.T
            s[q[a : a + 256][:, None] == v[None, :]] = -np.inf
            best = _best(s, POOL)
            out_q.append(np.repeat(q[a : a + 256], best.shape[1]))
            out_v.append(v[best.ravel()])
            out_s.append(np.take_along_axis(s, best, axis=1).ravel())
    if not out_q:
        return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
    s = np.concatenate(out_s)
    real = s > -np.inf
    return pa.table({"q": np.concatenate(out_q)[real], "v": np.concatenate(out_v)[real], "s": s[real]})


def search(queries: DataFrame, vectors: DataFrame, lists: DataFrame) -> DataFrame:
    """(q, v, s): the pool of each query. queries: (q, block, x), each q a vector of the graph."""
    adjacent = cut(lists.select(F.col("u").alias("v"), F.col("v").alias("w")), "adjacent")
    asked = cut(queries, "asked")
    start = lists.join(asked.select(F.col("q").alias("u"), "block"), "u").select("block", F.col("u").alias("q"), "v", F.col("s"), F.lit(False).alias("done"))
    pool = Cut(start, "pool")
    while True:  # each step expands a vector of every query that has one left
        open_ = F.row_number().over(W.partitionBy("q", "done").orderBy(F.col("s").desc(), "v"))
        marked = pool.df.withColumn("r", open_).withColumn("go", ~F.col("done") & (F.col("r") <= WIDTH)).drop("r")
        marked = Cut(marked, "marked")
        going = marked.df.filter("go").select("q").distinct()
        if going.isEmpty():
            marked.drop()
            break
        reached = marked.df.filter("go").select("block", "v").distinct().join(adjacent, "v").select("block", F.col("w").alias("id")).distinct()
        found = reached.join(vectors.select("id", "x"), "id").select(F.col("block").alias("at"), "id", "x")
        scored = asked.join(going, "q", "left_semi").select("block", "q", "x").groupBy("block").cogroup(found.groupBy("at")).applyInArrow(_score, "q bigint, v bigint, s double")
        blocks = asked.select("q", "block")
        rows = marked.df.select("q", "v", F.col("s"), (F.col("done") | F.col("go")).alias("done")).unionByName(scored.withColumn("done", F.lit(False)))
        one = rows.repartition("q").groupBy("q", "v").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        r = F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), "v"))
        after = Cut(one.withColumn("r", r).filter(F.col("r") <= POOL).drop("r").join(blocks, "q").select("block", "q", "v", "s", "done"), "pool")
        pool.drop()
        marked.drop()
        pool = after
    # The first lists were scored in single precision; all are scored once more below.
    return pool.df.select("q", "v")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row for which ``is_query`` (of column id) holds."""
    valid = cut(valid_vectors(rows, id_col, vec_col), "vectors")
    classes = cut(valid.groupBy("x").agg(F.min("id").alias("rep")), "vec-classes")
    reps = classes.select(F.col("rep").alias("id"), "x")
    n = reps.count()
    blocks = _blocks(reps, n)
    lists = graph(reps, blocks)
    # The first k + 1 members of each class; the limit by rank reaches below the shuffle, so large classes stay small.
    r = F.row_number().over(W.partitionBy("x").orderBy("id"))
    members = valid.withColumn("r", r).filter(F.col("r") <= k + 1).join(classes, "x").select("rep", "id")
    asked = valid.filter(is_query(F.col("id"))).withColumnRenamed("id", "query_id").join(classes, "x").select("query_id", "rep", "x")
    asked = cut(asked, "queries")
    homes = blocks.filter("rank = 0").select(F.col("id").alias("q"), "block", "x")
    pool = search(asked.select(F.col("rep").alias("q")).distinct().join(homes, "q").select("q", "block", "x"), reps, lists)
    own = asked.select(F.col("rep").alias("q"), F.col("rep").alias("v")).distinct()
    near = pool.unionByName(own).distinct().join(reps.select(F.col("id").alias("v"), F.col("x").alias("vx")), "v").join(reps.select(F.col("id").alias("q"), F.col("x").alias("qx")), "q")
    scored = near.select("q", "v", _dot(F.col("qx"), F.col("vx")).alias("score"))
    # A class's k + 1 nearest members serve each of its queries, which drops itself.
    m = scored.join(members.select(F.col("rep").alias("v"), "id"), "v")
    best = m.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "id"))).filter(F.col("r") <= k + 1).select("q", "id", "score")
    out = asked.select("query_id", F.col("rep").alias("q")).join(best, "q").filter("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
