"""Chat records for training, validation and inference, from functions with context.

Templates are parameters with {named} places; the defaults say in short what each record asks for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

NAME_TEMPLATE = """Infer the original name of the function that [MASK] stands for. Answer with the name only.

Environment:
{bin_info}

External callees: {callee_external}

Internal callees:
{callee_internal}

Callers:
{caller}

Code:
```C
{code}
```
"""
SUMMARY_TEMPLATE = """Describe in one paragraph what this function does, from inputs to purpose.

Code:
```C
{code}
```
"""
BLOCK_TEMPLATE = """Describe in one or two sentences what this code does.

Code:
```C
{code}
```
"""
CONTEXT_TEMPLATE = """Summarise in at most 150 words what this binary does.

Strings: {strings}
Libraries: {ldd}
File: {file}
"""
NEIGHBOURS = 5
LEAST_LINES = {"summary": 5, "name": 3, "single": 8}


def fill(template: str, places: dict[str, Column]) -> Column:
    """The template with its {named} places filled; a null place is empty."""
    parts = [F.coalesce(places[p[1:-1]], F.lit("")) if p.startswith("{") else F.lit(p) for p in re.split("(" + "|".join(rf"\{{{k}\}}" for k in places) + ")", template) if p]
    return F.concat(*parts)


def described(neighbours: Column, label: str, numbered: bool) -> Column:
    """Lines for the first NEIGHBOURS entries that have text; numbered: by place in the whole list."""
    line = lambda x, i: F.struct((x["kind"] == "code").alias("ok"), F.concat(F.lit(f"{label} "), (i + 1).cast("string") if numbered else x["name"], F.lit(": "), x["text"]).alias("line"))
    kept = F.filter(F.transform(neighbours, line), lambda x: x["ok"] & x["line"].isNotNull())
    return F.array_join(F.transform(F.slice(kept, 1, NEIGHBOURS), lambda x: x["line"]), "\n")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def name_records(samples: DataFrame, template: str = NAME_TEMPLATE, least: int = LEAST_LINES["name"], answered: bool = True) -> DataFrame:
    """(func_name, messages): prompt and, if answered, the sentence with the name. Short functions fall out."""
    code = T.strip_comments(F.col("input"))
    prompt = fill(template, {
        "bin_info": F.col("bin_info"), "callee_external": F.array_join("callee_external", ", "), "callee_internal": described(F.col("callee_internal"), "callee", False),
        "caller": described(F.col("caller"), "caller", True), "code": code,
    })
    turns = [message("user", prompt)] + [message("assistant", T.answer_sentence(F.col("func_name")))] * answered
    return samples.filter(F.col("input").isNotNull() & (T.non_blank_lines(code) > least)).select("func_name", F.array(*turns).alias("messages"))


def summary_records(samples: DataFrame, template: str = SUMMARY_TEMPLATE, least: int = LEAST_LINES["summary"]) -> DataFrame:
    """(func_name, messages) of functions with a summary (input, output); the name's first place is masked."""
    long = T.non_blank_lines(T.strip_comments(F.col("input"))) > least
    prompt = fill(template, {"code": T.mask_first(F.col("input"), F.col("func_name"))})
    return samples.filter(F.col("input").isNotNull() & long).select("func_name", F.array(message("user", prompt), message("assistant", F.col("output"))).alias("messages"))


def block_records(samples: DataFrame, template: str = BLOCK_TEMPLATE) -> DataFrame:
    """(func_name, messages): a record per entry of ``history`` (map of input and output)."""
    x = samples.select("func_name", F.explode("history").alias("block", "h"))
    return x.select("func_name", F.array(message("user", fill(template, {"code": F.col("h.input")})), message("assistant", F.col("h.output"))).alias("messages"))


def filled(samples: DataFrame, *results: str) -> DataFrame:
    """Samples of which any result was filled in."""
    return samples.filter(F.coalesce(*results).isNotNull())


def training_set(summaries: DataFrame, blocks: DataFrame | None, names: DataFrame) -> DataFrame:
    """(part, func_name, messages): summaries first, then block and name records."""
    parts = [(0, summaries), (1, blocks), (2, names)]
    out = None
    for k, p in parts:
        if p is not None:
            p = p.select(F.lit(k).alias("part"), "func_name", "messages")
            out = p if out is None else out.unionByName(p)
    return out


def context_prompts(facts: DataFrame, template: str = CONTEXT_TEMPLATE) -> DataFrame:
    """(bin_name, prompt) of binary facts: first and last strings, libraries, and the file report without its last field."""
    strings = F.array_join(T.head_and_tail(F.col("strings_out")), "\n")
    return facts.select("bin_name", fill(template, {"strings": strings, "ldd": F.col("ldd_output"), "file": T.without_last_field(F.col("file_output"))}).alias("prompt"))
