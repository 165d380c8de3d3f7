"""The line sanitiser: an ordered cascade of filters, then first-wins deduplication and composition, per document.

Everything happens inside the row, by array functions, so a document's lines are neither exploded nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T


PATH, VALID, URL = 0, 1, 2


def line_kind(s: Column) -> Column:
    """PATH, VALID or URL; null for a line that the cascade drops."""
    dropped = T.is_denied(s) | T.is_placeholder(s) | T.has_sequence(s)
    kept = F.when(T.quality(s) >= T.GIBBERISH, F.when(T.is_path(s), PATH).otherwise(VALID))
    return F.when(dropped, F.lit(None)).when(T.is_url(s), URL).otherwise(kept)


def classified(lines: Column) -> Column:
    """Array of (s, k): each distinct non-blank line with its kind. A line's kind depends on the line alone, so keeping
    each distinct line once is first-wins."""
    distinct = F.array_distinct(F.filter(F.transform(lines, T.strip), lambda s: s != ""))
    return F.transform(distinct, lambda s: F.struct(s.alias("s"), line_kind(s).alias("k")))


def composed(classes: Column) -> Column:
    """Paths (sorted), valid lines in order, then URLs (sorted) if there is room."""
    of = lambda k: F.transform(F.filter(classes, lambda x: x["k"] == k), lambda x: x["s"])
    kept = F.size(F.filter(classes, lambda x: x["k"] < URL))
    urls = F.when(kept < T.ROOM_FOR_URLS, F.sort_array(of(URL))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.sort_array(of(PATH)), of(VALID), urls)


def sanitize(rows: DataFrame, text_col: str, out: str = "strings_out") -> DataFrame:
    """Adds ``out``; a null text gives an empty array. Lines are classified in a projection of their own, once each."""
    classes = classified(T.lines(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.withColumn("_classes", classes).withColumn(out, composed(F.col("_classes"))).drop("_classes")


def binary_facts(raw: DataFrame) -> DataFrame:
    """(bin_name, file_output, ldd_output, strings_out) of raw tool outputs (bin_name, file_out, ldd_out, strings)."""
    report = F.array_join(T.distinct_lines(T.clean_file_report(F.coalesce("file_out", F.lit("")))), "\n")
    libraries = F.array_join(T.distinct_lines(F.coalesce("ldd_out", F.lit(""))), "\n")
    x = raw.select("bin_name", report.alias("file_output"), libraries.alias("ldd_output"), classified(F.coalesce("strings", F.array().cast("array<string>"))).alias("_classes"))
    return x.select("bin_name", "file_output", "ldd_output", composed(F.col("_classes")).alias("strings_out"))
