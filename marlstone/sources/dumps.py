"""Disassembler dumps as tables: functions, their variables, and call graphs, read by the schemas they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import ingest
from marlstone.sources import files, schemas

PLACE = [*files.PLACE, "bin_name"]


def functions(docs: DataFrame, depth: int = 4) -> DataFrame:
    """(place, pos, func_name, start, end, assembly, decomp_code, mask_code, variable_metadata, args_metadata) of function
    dumps (path, value). A record's own func_name goes before its key, which then is its address."""
    r = files.place_columns(files.records(docs, schemas.FUNCTION), depth=depth)
    at = F.col("function_address")
    return r.select(*[c for c in PLACE if c in r.columns], "pos", F.coalesce("func_name", "key").alias("func_name"), F.coalesce(at["start"], F.when(F.col("func_name").isNotNull(), F.col("key"))).alias("start"), at["end"].alias("end"), "assembly", "decomp_code", "mask_code", "variable_metadata", "args_metadata")


def variables(dumped: DataFrame, base: Column | None = None) -> DataFrame:
    """(place, func_name, kind, name, type, is_enum, is_struct, is_union, register, count): a row per variable and argument.
    ``base``: what a typedef stands for, as a Column of ``type``."""
    keys = [c for c in PLACE if c in dumped.columns] + ["func_name"]
    # Both maps of a row at once: the dumps are read a single time.
    sides = F.explode(F.array(F.struct(F.lit("local").alias("kind"), F.col("variable_metadata").alias("of")), F.struct(F.lit("argument").alias("kind"), F.col("args_metadata").alias("of"))))
    x = dumped.select(*keys, sides.alias("s")).select(*keys, "s.kind", F.explode("s.of").alias("name", "v"))
    x = x.select(*keys, "kind", "name", F.col("v.type").alias("type"), F.col("v.agg.*"), "v.register", "v.count")
    return x.withColumn("type", ingest.type_label(F.col("type"), F.lit(None).cast("string") if base is None else base))


def call_nodes(docs: DataFrame, depth: int = 4) -> DataFrame:
    """(place, pos, func_name, address, is_external, caller, callee_internal, callee_external) of call-graph dumps."""
    r = files.place_columns(files.records(docs, schemas.CALLS), depth=depth)
    return r.select(*[c for c in PLACE if c in r.columns], "pos", F.coalesce("func_name", "key").alias("func_name"), F.coalesce("address", F.lit("unknown")).alias("address"), F.coalesce("is_external", F.lit(False)).alias("is_external"), "caller", "callee_internal", "callee_external")


def call_edges(nodes: DataFrame) -> DataFrame:
    """(place, caller, callee, kind): each edge that a node lists, from either end, once."""
    keys = [c for c in PLACE if c in nodes.columns]
    out = lambda c, kind: nodes.select(*keys, F.col("func_name").alias("caller"), F.explode(c).alias("callee"), F.lit(kind).alias("kind"))
    into = nodes.select(*keys, F.explode("caller").alias("caller"), F.col("func_name").alias("callee"), F.when(F.col("is_external"), "external").otherwise("internal").alias("kind"))
    return out("callee_internal", "internal").unionByName(out("callee_external", "external")).unionByName(into).distinct()
