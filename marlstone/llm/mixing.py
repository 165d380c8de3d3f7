"""Mixing sources to target weights by a low-discrepancy slot schedule.

Each source's documents are shuffled (by a digest of id and text) into one stream of words that repeats at most
``max_repeats`` times and is cut into blocks of ``block`` words. Slot t of the mix takes golden-ratio point
frac((t + 1/2) phi), which the cumulative target weights map to a source; the k-th slot of a source takes its block k.
A source that the schedule leaves short gets its last slots at the end, and its last block is cut at its quota, so
every source gives floor(target) words. Slots beyond a source's last block stay empty.

Targets share the total by weight (sources by code point, null last, weights repeating); none exceeds
``max_repeats`` times its source's size, and what is above goes to the others by weight.

Nothing is gathered by source: streams are laid out per (source, range of digests), and only sums of those ranges are
ordered within a source. Rows that are equal in id, source and text are laid out as one unit, which is counted before it
is dealt out, and its copies are told apart later, ``COPIES`` in a task. The table of sources (one row each) is ordered in
one task, which spills if it must.

* null or word-less text: size 0, takes no part, taken 0, no slot; null source: a source of its own, last;
* null or shared ids: told apart by their texts; very long text: it stretches over several blocks;
* ties and repeated rows: ordered by digest; equal rows are interchangeable, so the result is the same in each run;
* empty table: empty result; extra columns: only id, text and source are read (``mixed_documents`` hands on the rest),
  so clashing names do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.plans.rows import col, packed, unpacked
from marlstone.plans.storage import cut

WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
WEIGHTS = (5, 2, 1)
BLOCK = 4096
MAX_REPEATS = 3
CELLS = 1024  #: cells of the unit interval by which slots meet sources
CHUNK = 1024  #: slots that are ranked together
COPIES = 1024  #: copies of a unit that are laid out together
FILE_WORDS = 4_000_000  #: words of the mix that a task writes, about


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (skey, source, source_size): water-filling in closed form.

    In ascending order of cap by weight, a source is capped while its share of what the capped ones before it leave
    exceeds its cap; the rest share the remainder by weight.
    """
    n = len(weights)
    table = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(table, ((F.col("i") - 1) % n + 1).cast("int")).cast("long")).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.select("*", F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("all_w"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_b"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_b"))
    s = s.withColumn("capped", ((F.col("total") - F.col("cap_b")) * F.col("w")).cast("double") > (F.col("cap") * (F.col("all_w") - F.col("w_b"))).cast("double"))
    s = s.select("*", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)).alias("cap_s"), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(every), F.lit(0)).alias("free_w"))
    share = ((F.col("total") - F.col("cap_s")) * F.col("w")).cast("double") / F.col("free_w").cast("double")
    return s.select("skey", "source", "source_size", "w", "i", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _slots(sources: DataFrame, total_slots: int, block: int) -> DataFrame:
    """(skey, block) and ``slot``, its place in the mix. ``sources`` has skey, i, target, need (blocks)."""
    spark = sources.sparkSession
    w = W.orderBy("i")
    span = sources.filter("need > 0").select("skey", "need", F.sum("target").over(w).alias("hi"), "i")
    span = span.withColumn("hi", F.col("hi") / F.max("hi").over(W.partitionBy())).withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    cells = span.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    last = F.col("i") == F.max("i").over(W.partitionBy())
    cells = cells.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi"))).select("skey", "need", "lo", "hi", "cell")
    points = spark.range(total_slots).withColumn("u", ((F.col("id") + 0.5) * PHI) % 1.0)
    points = points.withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)))
    drawn = points.join(cells, "cell").filter("u >= lo and u < hi").select("skey", "need", F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("skey", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(ahead.select("skey", "chunk", "ahead"), ["skey", "chunk"]).withColumn("block", F.col("ahead") + F.col("r")).filter("block < need").select("skey", "block", "slot")
    had = counts.groupBy("skey").agg(F.sum("n").alias("had"))
    short = sources.filter("need > 0").join(had, "skey", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need")
    short = short.withColumn("ahead", F.sum(F.col("need") - F.col("had")).over(w) - F.col("need"))  # leftovers before, less had
    short = short.select("skey", "ahead", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("block"))
    return ranked.unionByName(short.select("skey", "block", (F.lit(total_slots) + F.col("ahead") + F.col("block")).cast("long").alias("slot")))


def _copies(units: DataFrame) -> DataFrame:
    """A row per copy ``j`` of each unit; a unit of many copies is dealt out in chunks."""
    few = units.filter(F.col("m") <= COPIES).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    many = units.filter(F.col("m") > COPIES)
    if many.isEmpty():
        return few
    chunks = many.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COPIES)))).repartition("skey", "bucket", "rn", "c")
    many = chunks.withColumn("j", F.explode(F.sequence(F.col("c") * COPIES, F.least(F.col("m"), (F.col("c") + 1) * COPIES) - 1))).drop("c")
    return few.unionByName(many)


def pieces(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, max_repeats: int = MAX_REPEATS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: a row per document and block that it lies in (one row with null slot for a document not taken).

    doc_id, source, skey, size, fp (digest of the text), m (rows of the unit), source_size, target, the row's place
    (bucket, rn, j), slot, block, epoch, lo (place in its source's stream), n_words.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    base = docs.select(
        col(id_col).alias("doc_id"), col(source_col).alias("source"), F.coalesce(F.concat(F.lit("s"), col(source_col)), F.lit("n")).alias("skey"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("fp"),
    )
    units = base.groupBy(*base.columns).agg(F.count("*").alias("m"))
    units = cut(units.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "fp"))), "mix")
    n_buckets = min(65536, max(64, units.count() // 200))
    units = units.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(1 << 32)).cast("int"))
    sums = cut(units.groupBy("skey", "source", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("n")), "mix-sums")
    src = targets(sums.groupBy("skey", "source").agg(F.sum("n").alias("source_size")), weights, max_repeats)
    src = cut(src.withColumn("quota", F.floor("target").cast("long")).withColumn("need", F.ceil(F.col("quota") / block).cast("long")), "mix-sources")
    total = src.agg(F.sum("need")).first()[0] or 0
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.drop("source", "n").join(src.select("skey", "source_size", "target", "quota"), "skey")
    w = W.partitionBy("skey", "bucket").orderBy("h", "doc_id", "fp")
    placed = units.join(starts, ["skey", "bucket"]).withColumn("rn", F.row_number().over(w))
    placed = placed.withColumn("at", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = _copies(cut(placed.drop("h", "start"), "mix-placed")).withColumn("at", F.col("at") + F.col("j") * F.col("size"))
    epoch = F.expr(f"filter(transform(sequence(0L, {max_repeats - 1}L), e -> struct(e as epoch, e * source_size + at as lo, least(e * source_size + at + size, quota) as hi)), x -> x.lo < x.hi)")
    x = x.withColumn("e", F.explode_outer(epoch))
    x = x.withColumn("block", F.explode_outer(F.when(F.col("e").isNotNull(), F.sequence(F.floor(F.col("e.lo") / block), F.floor((F.col("e.hi") - 1) / block)))))
    x = x.withColumn("n_words", F.least(F.col("e.hi"), (F.col("block") + 1) * block) - F.greatest(F.col("e.lo"), F.col("block") * block))
    # Documents that lie in no block meet no slot: their key only spreads them.
    x = x.withColumn("key", F.when(F.col("block").isNotNull(), F.col("block")).otherwise(-1 - F.col("bucket") * 4096 - (F.col("rn") + F.col("j")) % 4096))
    x = x.join(_slots(src, total, block).withColumnRenamed("block", "key"), ["skey", "key"], "left")
    return x.select("doc_id", "source", "skey", "size", "fp", "m", "source_size", "target", "bucket", "rn", "j", "slot", "block", F.col("e.epoch").alias("epoch"), F.col("e.lo").alias("lo"), F.when(F.col("slot").isNotNull(), F.col("n_words")).alias("n_words"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target and, of each row, ``taken`` (words the mix takes, repeats counted),
    ``first_slot`` (of the mix, where it first stands; null if not taken) and ``n_slots`` (that hold some of it)."""
    p = pieces(docs, **options)
    row = p.groupBy("skey", "bucket", "rn", "j", "source", "doc_id", "size", "source_size", "target")
    return row.agg(F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots")).drop("skey", "bucket", "rn", "j")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``, in the order of the schedule: partitions follow each other, and rows within them.

    A document stands where its first word does, as often as it is taken: whole, or cut after its source's last word. Of
    rows that are equal in id, source and text, any one's other columns stand for all. A column ``n_chars`` follows the text.
    """
    key = ["id", "skey", "fp"]
    p = pieces(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("slot is not null")
    p = p.withColumn("id", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")))
    turns = p.groupBy(*key, "bucket", "rn", "j", "epoch", "m", "size", "lo").agg(F.sum("n_words").alias("words"), F.min_by("slot", "block").alias("slot"))
    turns = cut(turns.select(*key, "m", "size", "words", "slot", "lo", F.floor(F.col("j") / COPIES).alias("chunk")), "mix-turns")
    end = (turns.agg(F.max("slot")).first()[0] or 0) + 1
    id_ = F.coalesce(F.concat(F.lit("i"), col(id_col).cast("string")), F.lit("n"))
    skey = F.coalesce(F.concat(F.lit("s"), col(source_col)), F.lit("n"))
    own = docs.select(packed(docs), id_.alias("id"), skey.alias("skey"), F.md5(F.coalesce(col(text_col), F.lit(""))).alias("fp"))
    own = own.groupBy(*key).agg(F.first("row").alias("row"))
    x = own.join(turns.filter(F.col("m") <= COPIES).drop("chunk"), key)
    many = turns.filter(F.col("m") > COPIES)
    if not many.isEmpty():
        chunks = many.select(*key, "m").distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / COPIES)))).drop("m")
        x = x.unionByName(own.join(chunks, key).join(many, [*key, "chunk"]).drop("chunk"))
    text = F.col("row").getField(text_col)
    some = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), 1, F.col("words").cast("int")), "")
    x = x.select("row", "slot", "lo", "skey", F.when(F.col("words") < F.col("size"), some).otherwise(text).alias("text"))
    n_files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), end * options.get("block", BLOCK) // FILE_WORDS)
    x = x.repartitionById(n_files, F.floor(F.col("slot") * n_files / F.lit(end)).cast("int")).sortWithinPartitions("slot", "skey", "lo")
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(x, docs.columns, **new)
