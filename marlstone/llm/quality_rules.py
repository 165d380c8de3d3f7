"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores, beside the measurements, one bit per failed rule. A policy is a
named, versioned mask over those bits; ``apply_policy`` turns the ledger into verdicts without touching the texts
again, and ``ablation`` counts, for each rule of a policy, what it alone decides, by aggregating equal bit sets first.

Windows are told apart by 64 bits of hash: two different windows of one text count as one with a probability near 2^-64.

* null text: no words, all measurements 0 (it fails ``few_words``); empty text: the same;
* very long text: arrays of its words and windows stay in its row; all steps are linear or n log n;
* null id: judged as any other; ties and repeated rows: each row is judged alone; empty table: an empty ledger;
* extra columns: only id and text are read, so clashing names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.rows import col

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements; a null counts as no failure."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are never renumbered; a changed rule gets a new bit, so old ledgers keep their meaning.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    Rule(3, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(4, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(5, "upper_case", "n_letters >= 50 and 100 * n_upper > 60 * n_letters"),
    Rule(6, "exclamation", "n_words >= 20 and 100 * n_exclaim > 40 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
FULL = Policy("full", 1, tuple(r.name for r in RULES))


def mask(policy: Policy) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in policy.rules)


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and ``failed_bits`` (one bit per rule of RULES)."""
    t = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    t = t.withColumn("windows", F.expr(f"transform(sequence(1, greatest(size(words) - {WINDOW - 1}, 1)), i -> xxhash64(slice(words, i, {WINDOW})))"))
    t = t.withColumn("n_words", F.size("words").cast("long"))
    lines = "filter(split(text, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    m = t.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _length_without(F.col("text"), SYMBOLS).alias("n_symbols"),
        _length_without(F.col("text"), "[^!]+").alias("n_exclaim"),
        _length_without(F.col("text"), r"[^\p{Lu}]+").alias("n_upper"),
        _length_without(F.col("text"), r"[^\p{L}]+").alias("n_letters"),
        F.expr(lines).alias("lines"),
        F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.col("windows")).alias("windows"),
    )
    m = m.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Start positions of repeated windows: neighbours in (hash, position) order that share a hash.
    m = m.withColumn("s", F.expr("array_sort(transform(windows, (h, i) -> struct(h, i)))"))
    m = m.withColumn("p", F.expr("array_sort(transform(filter(transform(s, (x, k) -> struct(x.i as i, (k > 0 and s[greatest(k - 1, 0)].h = x.h) or coalesce(get(s, k + 1).h = x.h, false) as twice)), y -> y.twice), y -> y.i))"))
    m = m.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x), 0L)"))
    m = m.drop("s", "p", "windows", "lines")
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
    return m.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """``column``: no rule of the policy failed."""
    return rows.withColumn(column, F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that it alone rejects, rows kept without it.

    Equal bit sets are counted first, so what follows handles at most 2^rules rows.
    """
    m = mask(policy)
    sets = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    wanted = [r for r in RULES if r.name in policy.rules]
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in wanted]))
    x = sets.select("bits", "n", rule.alias("r"))
    b = F.col("bits")
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(b.bitwiseAND(F.col("r.b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(b == F.col("r.b"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(b.bitwiseAND(F.lit(m).cast("long") - F.col("r.b")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
