"""Call graphs as edge tables: extraction, closure, classification and neighbour inlining.

``keys`` name the binary that a graph belongs to: equal function names in two binaries are two nodes, and a node's row
holds the neighbours of one binary, never of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(calls: DataFrame, caller: str, callee: str, keys: list[str]) -> DataFrame:
    """Distinct (keys, caller, callee)."""
    return calls.select(*keys, F.col(caller).alias("caller"), F.col(callee).alias("callee")).filter("caller is not null and callee is not null").distinct()


def adjacency(edge: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """(keys, func, callee_internal): each caller's distinct callees, by first place (``order``) or by name."""
    if order is None:
        return edge.groupBy(*keys, F.col("caller").alias("func")).agg(F.sort_array(F.collect_set("callee")).alias("callee_internal"))
    first = edge.groupBy(*keys, "caller", "callee").agg(F.min(order).alias("at"))
    placed = first.groupBy(*keys, F.col("caller").alias("func")).agg(F.sort_array(F.collect_list(F.struct("at", "callee"))).alias("x"))
    return placed.select(*keys, "func", F.transform("x", lambda e: e["callee"]).alias("callee_internal"))


def closed(forward: DataFrame, backward: DataFrame, keys: list[str], external: DataFrame | None = None, two_way: bool = True) -> DataFrame:
    """(keys, func, callee_internal, caller) where every forward edge has its reverse and, with two_way, every reverse its edge.

    forward and backward: (keys, caller, callee); external: (symbol), and keys if symbols belong to binaries: callees that
    take no forward edge. Nodes met only as the other end of an edge get a row of their own.
    """
    back = forward.unionByName(backward).distinct()
    ahead = forward
    if two_way:
        missing = backward.join(forward, [*keys, "caller", "callee"], "left_anti")
        if external is not None:
            own = [k for k in keys if k in external.columns]
            missing = missing.join(external.select(*own, F.col("symbol").alias("callee")), [*own, "callee"], "left_anti").select(*keys, "caller", "callee")
        ahead = forward.unionByName(missing).distinct()
    rows = ahead.select(*keys, F.col("caller").alias("func"), F.col("callee").alias("out"), F.lit(None).cast("string").alias("into"))
    rows = rows.unionByName(back.select(*keys, F.col("callee").alias("func"), F.lit(None).cast("string").alias("out"), F.col("caller").alias("into")))
    return rows.groupBy(*keys, "func").agg(F.sort_array(F.collect_set("out")).alias("callee_internal"), F.sort_array(F.collect_set("into")).alias("caller"))


def symbols(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, symbol) of external functions, and of those a binary defines, from the nodes (keys, func_name, is_external) of a dump."""
    outside = F.coalesce("is_external", F.lit(False))
    of = lambda x: nodes.filter(x & F.col("func_name").isNotNull()).select(*keys, F.col("func_name").alias("symbol")).distinct()
    return of(outside), of(~outside)


def classified(edge: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, caller, callee, kind): external if the callee is an external symbol, of the binary if symbols have its keys."""
    own = [k for k in keys if k in external.columns]
    e = external.select(*own, F.col("symbol").alias("callee"), F.lit(True).alias("is_external")).distinct()
    return edge.join(e, [*own, "callee"], "left").select(*keys, "caller", "callee", F.when(F.coalesce("is_external", F.lit(False)), "external").otherwise("internal").alias("kind"))


def inline(functions: DataFrame, keys: list[str], name: str, code: str, neighbours: str, label: str, skip: tuple[str, ...] = (), replace_always: bool = False) -> DataFrame:
    """``neighbours`` (array of names) becomes an array of (kind, name, text), with the code of those that the binary has.

    Names in ``skip`` and unknown names fall out; a list of which nothing is found stays as names (unless replace_always).
    A row stands for a function of a binary (keys, name); the order of the list is kept.

    Code is never broadcast, neither that of all functions nor the lists found: the size of the first is guessed from files,
    which say little of it, and both would pass through the driver, the lists at run time, when adaptive execution finds them
    under the session's threshold. The merge sort of both sides spills, and adaptive execution splits names that many
    functions call.
    """
    target = functions.select(*keys, F.col(name).alias("_n"), F.struct(F.lit("code").alias("kind"), F.col(label).alias("name"), F.col(code).alias("text")).alias("_hit"))
    asked = functions.select(*keys, name, F.posexplode(neighbours).alias("_pos", "_n"))
    if skip:
        asked = asked.filter(~F.col("_n").isin(*skip))
    hits = asked.join(target.hint("merge"), [*keys, "_n"]).groupBy(*keys, name).agg(F.sort_array(F.collect_list(F.struct("_pos", "_hit"))).alias("_hits"))
    found = F.transform("_hits", lambda h: h["_hit"])
    plain = F.transform(F.col(neighbours), lambda n: F.struct(F.lit("name").alias("kind"), n.alias("name"), F.lit(None).cast("string").alias("text")))
    none = F.array().cast("array<struct<kind:string,name:string,text:string>>")
    return functions.join(hits.hint("merge"), [*keys, name], "left").withColumn(neighbours, F.coalesce(found, none if replace_always else plain, none)).drop("_hits")
