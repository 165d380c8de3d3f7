"""Predicates and labels at the edge, where disassembler output is taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of disassembler databases, and the middle of names of segments that hold code.
DATABASES = (".id0", ".id1", ".id2", ".nam", ".til", ".i64", ".idb")
CODE_SEGMENTS = ("OA", "OM", "te")


def is_binary_file(path: Column) -> Column:
    return ~F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)).isin(*DATABASES)


def is_code_segment(segment: Column) -> Column:
    return F.substring(segment, 2, 2).isin(*CODE_SEGMENTS)


def is_linkage_segment(segment: Column) -> Column:
    """Functions there are external."""
    return F.substring(segment, 2, 3) == "plt"


def display_id(name: Column, address: Column, is_external: Column) -> Column:
    """External functions go by their name, others by their address; without an address the name is labelled."""
    return F.when(F.coalesce(is_external, F.lit(False)), name).otherwise(F.coalesce(address, F.concat(F.lit("EXT_"), name)))


def renamed_edges(edge: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, caller, callee) by display id; ids: (keys, name, id). A name without an id stays."""
    a, b = (ids.select(*keys, F.col("name").alias(f"{c}"), F.col("id").alias(f"{c}_id")) for c in ("caller", "callee"))
    x = edge.join(a, [*keys, "caller"], "left").join(b, [*keys, "callee"], "left")
    return x.select(*keys, F.coalesce("caller_id", "caller").alias("caller"), F.coalesce("callee_id", "callee").alias("callee"))


def type_label(name: Column, base: Column) -> Column:
    """A variable's type: the base behind typedefs and pointers, with one star if there were any."""
    plain = F.trim(F.replace(name, F.lit("*"), F.lit("")))
    return F.concat(F.coalesce(base, plain), F.when(name.contains("*"), " *").otherwise(""))


def aggregate_flags(description: Column) -> Column:
    """(is_enum, is_struct, is_union) from a type's printed description: its third line names a Struct or a Union; an
    enumeration counts its values."""
    third = F.coalesce(F.get(F.split(description, "\n", -1), F.lit(2)), F.lit(""))
    struct = third.contains("Struct")
    return F.struct(F.coalesce(description.contains("Count"), F.lit(False)).alias("is_enum"), struct.alias("is_struct"), (~struct & third.contains("Union")).alias("is_union"))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; a path that is not below it stays."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def one_mode(**modes: bool) -> str:
    """The one mode that is set."""
    on = [k for k, v in modes.items() if v]
    if len(on) != 1:
        raise ValueError(f"set exactly one of {', '.join(modes)}")
    return on[0]
