"""Pairing of the two sides of functions with their call graphs, and what keeps or drops them.

Keys are (arch, opt, project, binary) and the function's name or start address; ``KEYS`` names the former. No side is
broadcast: Catalyst and adaptive execution choose by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

KEYS = ["arch", "opt", "project", "binary"]
INVALID = ["?? ??"]
SHORTEST, LONGEST = 5, 1024
# Compiler-generated functions that stages skip; the lists differ by stage.
SKIP_SPLIT = (
    "deregister_tm_clones", "register_tm_clones", "__do_global_dtors_aux", "_start", "__x86.get_pc_thunk.bx", "frame_dummy", "__x86.get_pc_thunk.dx",
    "__x86.get_pc_thunk.ax", "__libc_csu_init", "__libc_csu_fini", "main", "_FINI_0", "_DT_INIT",
)
SKIP_INLINE = (
    "deregister_tm_clones", "register_tm_clones", "do_global_dtors_aux", "frame_dummy", "x86.get_pc_thunk.dx", "_x86.get_pc_thunk.ax",
    "_x86.get_pc_thunk.bx", "__libc_csu_init", "__libc_csu_fini", "main",
)
SKIP_INLINE_B = (*SKIP_INLINE, "__do_global_dtors_aux", "_start")
SKIP_FORMAT = (
    "deregister_tm_clones", "register_tm_clones", "__do_global_dtors_aux", "_start", "__x86.get_pc_thunk.bx", "frame_dummy", "__x86.get_pc_thunk.dx",
    "__x86.get_pc_thunk.ax", "__libc_csu_init", "__libc_csu_fini", "main",
)
AUTO_NAMES = {"a": "FUN_", "b": "sub_"}


def has_valid_assembly(assembly: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    n = F.size(F.coalesce(assembly, F.array().cast("array<string>")))
    return n.between(shortest, longest) & F.coalesce(assembly != F.array(*[F.lit(x) for x in INVALID]), F.lit(True))


def complete_binaries(unstripped: DataFrame, *siblings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of binaries that all sibling tables know too."""
    for s in siblings:
        unstripped = unstripped.join(s.select(*keys).distinct(), keys, "left_semi")
    return unstripped


def pair(unstripped: DataFrame, stripped: DataFrame, calls: DataFrame, stripped_calls: DataFrame, keys: list[str] = KEYS, mask=lambda code: code, clean: bool = False) -> DataFrame:
    """(keys, func_name, unstripped, stripped, stripped_function_name) of every function with a call-graph entry.

    unstripped: func_name, assembly, decomp_code, start; stripped: start, func_name, assembly, decomp_code;
    calls: func_name, caller, callee_internal, callee_external; stripped_calls: start and the same.
    A function without a stripped side keeps nulls; a stripped side without a graph entry keeps its code and its name.
    ``mask`` hides a function's own name; ``clean`` removes line comments from both sides.
    """
    tidy = T.strip_line_comments if clean else (lambda c: c)
    u = unstripped.filter(has_valid_assembly(F.col("assembly"))).select(*keys, "func_name", "start", tidy(mask(F.col("decomp_code"))).alias("u_code"))
    c = calls.select(*keys, "func_name", "caller", "callee_internal", "callee_external")
    invalid = F.coalesce(F.col("assembly") == F.array(*[F.lit(x) for x in INVALID]), F.lit(False))
    s = stripped.select(*keys, "start", F.col("func_name").alias("stripped_function_name"), tidy(mask(F.col("decomp_code"))).alias("s_code"), invalid.alias("invalid"))
    sc = stripped_calls.select(*keys, "start", F.col("callee_external").alias("s_external"), F.lit(True).alias("known"))
    x = u.join(c, [*keys, "func_name"]).join(s, [*keys, "start"], "left").filter(~F.coalesce("invalid", F.lit(False))).join(sc, [*keys, "start"], "left")
    own = F.struct(F.col("u_code").alias("code"), "callee_external", "callee_internal", "caller")
    known = F.coalesce("known", F.lit(False))
    # The stripped side's neighbours are the named ones, so that both sides can be joined by name.
    other = F.struct(F.col("s_code").alias("code"), F.when(known, F.col("s_external")).alias("callee_external"), F.when(known, F.col("callee_internal")).alias("callee_internal"), F.when(known, F.col("caller")).alias("caller"))
    return x.select(*keys, "func_name", own.alias("unstripped"), F.when(F.col("s_code").isNotNull(), other).alias("stripped"), "stripped_function_name")


def attach_calls(functions: DataFrame, calls: DataFrame, on: list[str]) -> DataFrame:
    """Prediction mode: functions with their graph entry; a missing one leaves nulls."""
    return functions.filter(has_valid_assembly(F.col("assembly"), 10)).join(calls.select(*on, "caller", "callee_internal", "callee_external"), on, "left")


def attach_context(samples: DataFrame, context: DataFrame, on: str = "bin_name") -> DataFrame:
    return samples.join(context, on)


def without_context(samples: DataFrame, context: DataFrame, on: str = "bin_name") -> DataFrame:
    return samples.join(context.select(on), on, "left_anti")


def attach_constant(samples: DataFrame, context: DataFrame, order: str) -> DataFrame:
    """The first context row, on every sample: one row is read on the driver and becomes a constant."""
    first = context.orderBy(order).limit(1).first()
    for c in context.columns:
        samples = samples.withColumn(c, F.lit(first[c] if first else None).cast(context.schema[c].dataType))
    return samples


def not_skipped(name: Column, skip: tuple[str, ...] = SKIP_SPLIT, auto: str = AUTO_NAMES["a"]) -> Column:
    return ~name.isin(*skip) & ~name.contains(auto)
