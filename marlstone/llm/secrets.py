"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds (assign, access, hex) stand by themselves. Weak kinds are common in clean text and are reported only if
complementary parts stand within ``SCOPE`` characters in the same document: a 40-character key beside an access
identifier, an endpoint beside both an access identifier and a reported secret (assign, hex, or a key so linked).

Nothing is reported where no strong kind stands, so texts without any of their beginnings are not searched further.
Spans come from what a pattern leaves between its matches: the running sum of gap and match lengths, in code points.
The interval join is a sweep: spans of a document in order of start carry the furthest end of each complementary part
so far and the nearest start of one to come, so no pairs are made and the work is n log n in a document's spans.
Keys are linked before endpoints, whose evidence they are.

* null text: as empty text, no spans; very long text: its spans become rows, nothing grows with their square;
* ties: spans by start, then by kind as listed, then by end; repeated rows: each row is scanned alone;
* null id: scanned as any other; empty table: empty result;
* extra columns: only id and text are read (``redacted`` hands on the rest), so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.plans.rows import col, packed, unpacked
from marlstone.plans.storage import cut

SCOPE = 500


@dataclass(frozen=True)
class Kind:
    """``keep``: what a match m with group ``group`` g must meet; matches that fail it still use up their text."""

    name: str
    pattern: str
    keep: Callable[[Column, Column], Column] = lambda m, g: F.lit(True)
    group: int = 0


def _mixed(m: Column, _: Column) -> Column:
    return (F.length(m) == 40) & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & ~m.endswith("=")


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m, g: F.length(g) >= 6, 2),
    Kind("access", "AKIA[A-Z0-9]{16,}"),
    Kind("hex", "[0-9a-f]{24,}"),
    Kind("key", "[A-Za-z0-9+/]{40,}=*", _mixed),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"),
)
STRONG = 3
#: What a match of a strong kind holds, in lower case; hex has a pattern of its own.
BEGINNINGS = ("password", "passwd", "secret", "token", "apikey", "api_key", "akia")


def worth_searching(text: Column) -> Column:
    """Whether a strong kind may stand in the text; tested by plain search, which is far cheaper than the patterns."""
    low = F.lower(text)
    out = F.rlike(text, F.lit("[0-9a-f]{24}"))
    for b in BEGINNINGS:
        out = F.contains(low, F.lit(b)) | out
    return F.coalesce(out, F.lit(False))


def _matches(text: Column, k: int, kind: Kind) -> Column:
    """Array of (k, i, gap, len, ok) for all matches, failing ones too: positions are sums over them. Null: no match."""
    p = F.lit(kind.pattern)
    m = F.regexp_extract_all(text, p, F.lit(0))
    group = F.regexp_extract_all(text, p, F.lit(kind.group)) if kind.group else m
    zipped = F.arrays_zip(m.alias("m"), F.split(text, kind.pattern, -1).alias("gap"), group.alias("g"))
    # The piece after the last match has no match of its own.
    rows = F.transform(
        F.slice(zipped, F.lit(1), F.size(m)),
        lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), kind.keep(x["m"], x["g"]).alias("ok")),
    )
    return F.when(F.rlike(text, p), rows)


def _found(text: Column) -> Column:
    none = F.array().cast("array<struct<k:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(worth_searching(text), F.concat(*[F.coalesce(_matches(text, k, kind), none) for k, kind in enumerate(KINDS)]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, row (a number of the row), k, kind, start, end of all reported spans; one row of nulls for a document without."""
    t = docs.select(col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    x = t.select("doc_id", "row", F.explode_outer(_found(F.col("text"))).alias("f")).select("doc_id", "row", "f.*")
    row = ["doc_id", "row"]
    upto = W.partitionBy(*row, "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("len"))
    x = x.withColumn("end", F.when(F.col("ok"), F.col("end"))).withColumn("start", F.when(F.col("ok"), F.col("start")))
    order = W.partitionBy(*row).orderBy(F.col("start").asc_nulls_last(), "k", "end")
    past, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)

    def near(part: Column) -> Column:
        return (F.coalesce(F.max(F.when(part, F.col("end"))).over(past) >= F.col("start") - scope, F.lit(False))) | (F.coalesce(F.min(F.when(part, F.col("start"))).over(ahead) <= F.col("end") + scope, F.lit(False)))

    x = x.withColumn("by_access", near(F.col("k") == 1))
    x = x.withColumn("by_secret", near(F.col("k").isin(0, 2) | ((F.col("k") == 3) & F.col("by_access"))))
    linked = (F.col("k") < STRONG) | ((F.col("k") == 3) & F.col("by_access")) | ((F.col("k") == 4) & F.col("by_access") & F.col("by_secret"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    out = {c: F.when(F.col("ok") & linked, F.col(c)).alias(c) for c in ("k", "start", "end")}
    return x.select(*row, out["k"], F.when(F.col("ok") & linked, names[F.col("k")]).alias("kind"), out["start"], out["end"])


def found(docs: DataFrame, **options) -> DataFrame:
    """doc_id, row and ``found``: the document's spans (start, k, end, kind) in order."""
    s = spans(docs, **options)
    one = F.when(F.col("k").isNotNull(), F.struct("start", "k", "end", "kind"))
    return s.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(one)).alias("found"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""
    f = found(docs, **options)
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return f.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda x: x["k"] < STRONG)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with the text of each reported span replaced by its kind in brackets (overlapping spans: one mark).

    Only rows in which a secret may stand leave their place; the others pass as they are. Rows are matched by id and
    text fingerprint. A column ``n_chars`` follows the text.
    """
    text, columns = F.coalesce(col(text_col), F.lit("")), docs.columns
    rest, some = docs.filter(~worth_searching(text)), docs.filter(worth_searching(text))
    keyed = some.select(packed(docs), col(text_col).alias("text"), col(id_col).isNull().alias("no_id"), F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("fp"))
    keyed = cut(keyed, "secrets")  # few rows, which are read twice
    key = ["no_id", "id", "fp"]
    f = found(keyed.select(F.struct(*key).alias("key"), "text"), id_col="key").filter(F.size("found") > 0)
    f = f.groupBy("doc_id").agg(F.first("found").alias("found")).select("doc_id.*", "found")
    x = keyed.join(f, key, "left")
    # Pieces: the text up to each span from the furthest end before it, and the span's mark unless it overlaps.
    step = """aggregate(found, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> named_struct(
        'at', greatest(a.at, x.end),
        'out', if(x.start < a.at, a.out, concat(a.out, array(substring(text, a.at + 1, x.start - a.at), concat('[', x.kind, ']'))))),
        a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    x = x.withColumn("text", F.when(F.col("found").isNotNull(), F.expr(step)).otherwise(F.col("text")))
    new = {text_col: F.col("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("found").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return unpacked(x, columns, **new).unionByName(rest)
