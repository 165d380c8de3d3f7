"""Queries of what stands at the engine's edges: scans, dumps, sinks, streams, tools and models. Files are written to the
shared folder, read back by the library's readers, and deleted with the scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import code as C
from marlstone.functions import ingest
from marlstone.functions import similarity as S
from marlstone.functions import text as T
from marlstone.operators import align, chatrecords, dedup, graph, models, scoring
from marlstone.plans.storage import Folder
from marlstone.queries import BINARY, QUERIES, _code, _functions, _inlined_sources, _name_lists, _t, query
from marlstone.sources import dumps, files, processes, sinks
from marlstone.streaming import incremental

__all__ = ["QUERIES"]


def _path(spark: SparkSession, label: str) -> str:
    return Folder(spark, label).path


# Scans


def _written(spark, d, value, by=("region", "nation")) -> str:
    """A file for each nation, below its region's folder, that holds the text ``value`` makes of its suppliers' records."""
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    record = F.to_json(F.struct(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")))
    s = s.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.struct("s_suppkey", F.concat(F.lit('"'), "s_name", F.lit('":'), record).alias("pair"), record.alias("record")).alias("r"))
    s = s.groupBy("region", "nation").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    path = _path(spark, "files")
    s.select(*by, value.alias("value")).write.partitionBy(*by).text(path)
    return path


def _joined(field: str, before: str, after: str):
    return F.concat(F.lit(before), F.array_join(F.transform("rs", lambda r: r[field]), ","), F.lit(after))


def _nation():
    return F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")


_RECORD = "struct<k:bigint,balance:double>"


@query
def json_dict_scan(spark, d):
    """Files of one JSON object, below a folder tree; a folder that is not there is passed over."""
    path = _written(spark, d, _joined("pair", "{", "}"))
    docs = files.documents(spark, [path, path + "-absent"], "*.txt")
    return files.records(docs, _RECORD).select(_nation(), "pos", "key", "k", "balance")


@query
def json_array_scan(spark, d):
    """Files of a JSON array of objects with a single key."""
    path = _written(spark, d, F.concat(F.lit("["), F.array_join(F.transform("rs", lambda r: F.concat(F.lit("{"), r["pair"], F.lit("}"))), ",\n"), F.lit("]")))
    return files.record_lists(files.documents(spark, path, "*.txt"), _RECORD).select(_nation(), "pos", "key", "k", "balance")


@query
def json_record_scan(spark, d):
    """Files of a JSON array of records."""
    path = _written(spark, d, _joined("record", "[", "]"))
    return files.arrays(files.documents(spark, path, "*.txt"), _RECORD).select(_nation(), "pos", "k", "balance")


@query
def tolerant_load(spark, d):
    """Every fifth file is cut short: it gives no rows, and is named."""
    whole = _joined("pair", "{", "}")
    path = _written(spark, d, F.when(F.col("nation") % 5 == 0, F.substring(whole, 1, 9)).otherwise(whole))
    docs = files.documents(spark, path, "*.txt")
    n = files.records(docs, _RECORD).groupBy("path").agg(F.count("*").alias("n"))
    bad = files.malformed(docs, _RECORD).withColumn("malformed", F.lit(True))
    x = docs.select("path").join(n, "path", "left").join(bad, "path", "left")
    return x.select(_nation(), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("malformed", F.lit(False)).alias("malformed"))


@query
def relative_paths(spark, d):
    path = _written(spark, d, F.lit("{}"))
    below = ingest.relative_path(F.regexp_replace("path", "^[a-z]+:/+", "/"), path.removeprefix("file://"))
    return files.documents(spark, path, "*.txt").select(F.regexp_replace(below, "/[^/]*$", "").alias("folder"))


@query
def score_lines(spark, d):
    """Lines of truth and prediction, written and read."""
    path = _path(spark, "lines")
    sinks.write_pairs(_t(spark, d, "part").select(T.name_words(F.col("p_name")).alias("truth"), T.name_words(F.col("p_type")).alias("prediction")), path)
    return files.score_lines(spark, path)


@query
def prompt_template(spark, d):
    """A prompt file filled for each nation."""
    path = _path(spark, "prompt")
    spark.createDataFrame([("Name: {name}\nKey: {key}",)], "value string").coalesce(1).write.text(path)
    text = files.template(spark, path)
    return _t(spark, d, "nation").select("n_nationkey", chatrecords.fill(text, {"name": F.col("n_name"), "key": F.col("n_nationkey").cast("string")}).alias("prompt"))


@query
def process_outputs(spark, d):
    """Outputs of tools: one that answers, one that takes too long, one that is not there, one that fails."""
    commands = {"said": "printf %s {path}", "late": "sleep 9", "absent": "/absent/tool {path}", "failed": "false"}
    return processes.outputs(_t(spark, d, "region"), "r_name", commands, timeout=0.5)


# Dumps


def _dumped(spark, d, value) -> DataFrame:
    """Orders as functions in JSON dumps of ten binaries a status, as (path, first, value)."""
    f = _functions(spark, d).withColumn("binary", (F.col("o_custkey") % 10).cast("string"))
    place = F.concat_ws("/", "arch", "opt", "project", F.concat("binary", F.lit(".json")))
    f = f.select(place.alias("place"), "o_orderkey", value.alias("pair"))
    # A line per record, so that no task holds a binary; the first opens the object, the last closes it.
    w = W.partitionBy("place").orderBy("o_orderkey")
    opens, ends = F.row_number().over(w) == 1, F.lead("o_orderkey").over(w).isNull()
    f = f.select("place", "o_orderkey", F.concat(F.when(opens, "{").otherwise(","), "pair", F.when(ends, "}").otherwise("")).alias("value"))
    path = _path(spark, "dump")
    f.sortWithinPartitions("place", "o_orderkey").select("place", "value").write.partitionBy("place").text(path)
    docs = files.objects(spark, path, "*.txt")
    # A folder's name stands for the dump's own path.
    return docs.select(F.url_decode(F.regexp_extract("path", "place=([^/]+)/", 1)).alias("path"), "first", "value")


def _keyed(record):
    return F.concat(F.lit('"'), "func_name", F.lit('":'), F.to_json(record))


def _function_record():
    k = F.col("o_orderkey")
    types = F.array(*[F.lit(x) for x in ("foo_t **", "char *", "int", "pair_t")])
    flags = F.struct((k % 4 == 2).alias("is_enum"), (k % 4 == 3).alias("is_struct"), F.lit(False).alias("is_union"))
    variable = F.struct(F.get(types, (k % 4).cast("int")).alias("type"), F.array("start").alias("addresses"), flags.alias("agg"))
    argument = F.struct(F.get(types, ((k + 1) % 4).cast("int")).alias("type"), F.array().cast("array<string>").alias("addresses"), F.lit("RDI").alias("register"), F.lit(1).alias("count"))
    address = F.struct("start", (k + 9).cast("string").alias("end"))
    return F.struct("assembly", "decomp_code", F.create_map(F.lit("v"), variable).alias("variable_metadata"), F.create_map(F.lit("a"), argument).alias("args_metadata"), address.alias("function_address"))


@query
def function_dump(spark, d):
    f = dumps.functions(_dumped(spark, d, _keyed(_function_record())))
    return f.select("opt", "project", "bin_name", "func_name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.size("assembly").alias("n_assembly"), "decomp_code")


@query
def variable_dump(spark, d):
    """Variables and arguments with their types behind typedefs and pointers."""
    f = dumps.functions(_dumped(spark, d, _keyed(_function_record())))
    v = dumps.variables(f, F.when(F.col("type").startswith("foo_t"), F.lit("unsigned int")))
    return v.select("opt", "bin_name", "func_name", "kind", "name", "type", "is_enum", "is_struct", "register", "count")


def _call_nodes(spark, d):
    """Each order calls its successor and an external function that every third order is."""
    k = F.col("o_orderkey")
    name = lambda x: F.concat(F.lit("fn_"), x.cast("string"))
    node = F.struct(F.array(name(k - 1)).alias("caller"), F.array(name(k + 1)).alias("callee_internal"), F.array(F.lit("puts")).alias("callee_external"), F.when(k % 5 != 0, F.col("start")).alias("address"), (k % 3 == 0).alias("is_external"))
    return dumps.call_nodes(_dumped(spark, d, _keyed(node)))


@query
def call_graph_dump(spark, d):
    return _call_nodes(spark, d).select("opt", "bin_name", "func_name", "address", "is_external", F.array_join("callee_internal", ",").alias("callees"))


@query
def call_graph_edges(spark, d):
    return dumps.call_edges(_call_nodes(spark, d)).select("opt", "bin_name", "caller", "callee", "kind")


@query
def symbol_sets(spark, d):
    """External symbols and those that binaries define."""
    external, defined = graph.symbols(_call_nodes(spark, d), ["opt", "bin_name"])
    return external.withColumn("kind", F.lit("external")).unionByName(defined.withColumn("kind", F.lit("defined")))


@query
def display_ids(spark, d):
    """Edges by display id: external functions by name, others by address."""
    nodes = _call_nodes(spark, d).withColumn("address", F.when(F.col("address") != "unknown", F.col("address")))
    keys = ["opt", "bin_name"]
    ids = nodes.select(*keys, F.col("func_name").alias("name"), ingest.display_id(F.col("func_name"), F.col("address"), F.col("is_external")).alias("id"))
    calls = nodes.select(*keys, F.col("func_name").alias("caller"), F.explode("callee_internal").alias("callee"))
    return ingest.renamed_edges(graph.edges(calls, "caller", "callee", keys), ids, keys)


@query
def segment_filter(spark, d):
    """Functions by the segment they lie in."""
    names = F.array(*[F.lit(x) for x in ("LOAD", ".text", ".plt", "COMMON", ".data", "", ".plt.got")])
    x = _t(spark, d, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("segment"))
    return x.select("o_orderkey", ingest.is_code_segment(F.col("segment")).alias("is_code"), ingest.is_linkage_segment(F.col("segment")).alias("is_linkage"))


@query
def file_type_filter(spark, d):
    ends = F.array(*[F.lit(x) for x in ("", ".so", ".i64", ".ID0", ".nam", ".o")])
    x = _t(spark, d, "pages").select("page_id", F.concat(T.bin_name(F.regexp_replace("url", r"[?#].*$|\.", "")), F.get(ends, (F.col("page_id") % 6).cast("int"))).alias("path"))
    return x.select("page_id", ingest.is_binary_file(F.col("path")).alias("is_binary"))


@query
def aggregate_types(spark, d):
    texts = F.array(*[F.lit(x) for x in ("/foo\npair_t\nStructure pair_t {\nUnion", "/foo\nu_t\nUnion u_t {", "/foo\ncolour\nEnum, Count 3", "int")])
    x = _t(spark, d, "part").select("p_partkey", ingest.aggregate_flags(F.get(texts, (F.col("p_partkey") % 4).cast("int"))).alias("f"))
    return x.select("p_partkey", "f.*")


@query
def modes(spark, d):
    """Which settings of two exclusive modes are accepted."""
    rows = []
    for a in (False, True):
        for b in (False, True):
            try:
                rows.append((a, b, ingest.one_mode(dataset=a, prediction=b)))
            except ValueError as e:
                rows.append((a, b, str(e)))
    return spark.createDataFrame(rows, "dataset boolean, prediction boolean, mode string")


# Sinks


@query
def places_roundtrip(spark, d):
    """Functions in a folder per arch, opt, project and binary."""
    path = _path(spark, "places")
    sinks.write_places(_functions(spark, d).select("arch", "opt", "project", (F.col("o_custkey") % 8).cast("string").alias("binary"), "func_name", "decomp_code"), path)
    x = spark.read.schema("func_name string, decomp_code string, arch string, opt string, project string, binary string").parquet(path)
    return x.select("arch", "opt", "project", "binary", "func_name", "decomp_code")


@query
def splits_roundtrip(spark, d):
    path = _path(spark, "splits")
    sinks.write_splits(dedup.split(_t(spark, d, "documents"), "doc_id"), path)
    return spark.read.schema("doc_id bigint, split string").json(path)


@query
def records_roundtrip(spark, d):
    path = _path(spark, "records")
    x = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sinks.write_records(x.select("n_name", F.struct("r_regionkey", "r_name").alias("region")), path)
    return spark.read.schema("n_name string, region struct<r_regionkey:int,r_name:string>").json(path).select("n_name", "region.*")


@query
def append_new_rows(spark, d):
    """Rows appended in three overlapping runs."""
    path, x = _path(spark, "appended"), _t(spark, d, "customer").select("c_custkey", "c_name")
    for part in ("c_custkey % 3 = 0", "c_custkey % 2 = 0", "true"):
        sinks.append_new(x.filter(part), path, "c_custkey")
    return spark.read.parquet(path)


@query
def ordered_merge(spark, d):
    """Parts of records merged in order: a later part's record takes an earlier one's place."""
    path = _path(spark, "parts")
    x = _t(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("part"), "user_id", "event_id", "value")
    sinks.write_parts(dedup.last_by(x.withColumn("key", F.struct("part", "user_id")), "key", "event_id").drop("key"), path, "part")
    return sinks.merged_parts(spark, path, "user_id", "part", "user_id bigint, event_id bigint, value double")


@query
def dataset_registration(spark, d):
    return sinks.registration(spark, "names", "train.json")


# Streams


def _event_files(spark, d) -> DataFrame:
    """Events as a stream of several files."""
    path = _path(spark, "stream")
    events = _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.repartition(2, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_append(spark, d):
    """A stream appended batch by batch, and once more from the start: every key is written once."""
    path, marks = _path(spark, "streamed"), _path(spark, "marks")
    stream = _event_files(spark, d)
    for k in (1, 2):
        incremental.append_batches(stream, path, "user_id", ["event_id"], f"{marks}/{k}", buckets=4).awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def stream_first_seen(spark, d):
    """Keys of a stream, each let through once within the watermark."""
    path, marks = _path(spark, "seen"), _path(spark, "marks")
    seen = incremental.first_seen(_event_files(spark, d), "user_id", "ts", "3650 days").select("user_id")
    seen.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint").parquet(path)


# Models


@query
def judge_replies(spark, d):
    """Whether neighbours by key have like names; a blank name is an error."""
    p = _t(spark, d, "part").select("p_partkey", "p_name")
    guesses = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("guess"))
    x = p.join(guesses.hint("merge"), "p_partkey")  # names are not broadcast; the requests are dealt out with the rows
    return models.judged(x, "p_partkey", "p_name", "guess").select("id", "similarity", "similarity_score", "error")


@query
def verdict_parse(spark, d):
    words = F.array(*[F.lit(x) for x in ("True", "it is TRUE.", "false", "no", "")])
    return _t(spark, d, "part").select("p_partkey", T.verdict_of(F.get(words, (F.col("p_partkey") % 5).cast("int"))).alias("similar"))


@query
def predicted_names(spark, d):
    """Predictions from first turns; a conversation whose first turn is empty predicts nothing."""
    c = _t(spark, d, "conversations").withColumn("text", F.when(F.col("conv_id") % 6 != 0, F.col("text")).otherwise(F.lit("")))
    c = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    return models.predicted(c, "conv_id", "turns")


@query
def error_filter(spark, d):
    """Replies without an error, and all replies with empty text for those with one."""
    x = _t(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 != 0, F.col("text")).otherwise(F.lit("")).alias("text"))
    got = models.complete(x, "item_id", "text", models.digest_client)
    side = lambda r, kept: r.select(F.lit(kept).alias("keep_empty"), "id", T.clean_reply(F.col("reply")).alias("reply"))
    return side(models.answered(got), False).unionByName(side(models.answered(got, keep_empty=True), True))


@query
def filled_records(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return chatrecords.filled(x, "quality", "toxic").select("doc_id")


@query
def embedded_texts(spark, d):
    """Vectors of texts, each distinct text encoded once; a row per component that is not 0."""
    x = models.embed(_t(spark, d, "benchmark"), "text").select("item_id", F.posexplode("vec").alias("component", "value"))
    return x.filter("value <> 0").withColumn("value", F.round("value", 6))


# Samples and alignment


@query
def neighbor_inline_always(spark, d):
    """Neighbour lists replaced even where nothing is found."""
    line = F.transform("callee_internal", lambda x: F.concat_ws(":", x["kind"], x["name"], x["text"]))
    f = _inlined_sources(spark, d)
    x = graph.inline(f, ["p_brand"], "func_name", "code", "callee_internal", "func_name", skip=("0", "8"), replace_always=True)
    return x.select("p_brand", "func_name", F.array_join(line, ",").alias("callees"))


@query
def snippet_alignment(spark, d):
    """Line items as blocks of orders, with the counterparts that some have."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("part"))
    blocks = li.select("func", F.col("pos").alias("block"), "pos", F.concat(F.lit("does "), F.col("part").cast("string")).alias("output"))
    matches = li.filter("part % 3 <> 0").select("func", F.col("pos").alias("block"), F.floor(F.col("pos") / 2).alias("other_block"), F.concat(F.lit("code "), F.col("part").cast("string")).alias("other_code"))
    o = _t(spark, d, "orders")
    x = align.snippets(blocks, o.select(F.col("o_orderkey").alias("func"), F.col("o_orderpriority").alias("output")), matches, o.filter("o_totalprice > 50000").select(F.col("o_orderkey").alias("func"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("code")))
    return x.select("func", "input", "output", F.array_join(F.transform("history", lambda h: F.concat_ws("|", h["block"], h["input"], h["output"])), ";").alias("history"))


@query
def call_renamed_dedup(spark, d):
    """First function of each body, bodies that differ in the numbers of called functions alone being one."""
    k = F.col("o_orderkey")
    call = lambda n: F.concat(F.lit("FUN_00"), n.cast("string"))
    code = F.concat(F.lit("int f(int n)\n{\n  return "), call(k % 7), F.lit("(n) + "), call(k % 3), F.lit("(n) + "), (k % 5).cast("string"), F.lit(";\n}\n"))
    x = _t(spark, d, "orders").select("o_orderkey", code.alias("code"))
    return dedup.first_by(x.withColumn("code", C.rename_calls_udf("code")), "code", ["o_orderkey"])


@query
def split_replay(spark, d):
    """Saved splits of some documents, kept, and new splits of the others."""
    x = _t(spark, d, "documents")
    saved = x.filter("doc_id % 3 = 0").select("doc_id", F.lit("test").alias("split"))
    return dedup.replayed(x, "doc_id", saved)


@query
def throughput(spark, d):
    return scoring.throughput(_t(spark, d, "events"), "ts", "ts").select("n", F.round("seconds", 3).alias("seconds"), F.round("per_second", 6).alias("per_second"))


@query
def sample_sentences(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.sample_sentence(F.col("p_name")).alias("output"), T.answer_sentence(F.col("p_name")).alias("answer"))


# Code and names


@query
def block_count(spark, d):
    """Blocks of all functions, but the functions' own records."""
    x = _code(spark, d).select(F.explode(C.code_blocks_udf("code", F.lit("run"))).alias("b"))
    return x.agg(F.count_if(F.col("b.line_start").isNotNull()).alias("n_blocks"), F.count_if(F.col("b.line_start").isNull()).alias("n_functions"))


@query
def block_markers(spark, d):
    """Functions with markers around their blocks."""
    x = _code(spark, d).select("page_id", F.explode(C.code_blocks_udf("code", F.lit("run"))).alias("b")).filter("b.block_code is not null")
    return x.select("page_id", F.md5("b.block_code").alias("marked_md5"))


@query
def demangled_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", C.demangle_udf(F.concat(F.lit("call "), F.get(F.array(*[F.lit(m) for m in MANGLED]), (F.col("p_partkey") % len(MANGLED)).cast("int")), F.lit("!"))).alias("name"))


#: Mangled names, with what they say.
MANGLED = {
    "_ZN3foo3barEv": "foo::bar",
    "_ZNSt6vectorIiSaIiEE9push_backERKi": "std::vector<int, std::allocator<int> >::push_back",
    "_Z3maxIiET_S0_S0_": "int max<int>",
    "_ZN3FooC1Ev": "Foo::Foo",
    "_ZN3FooD1Ev": "Foo::~Foo",
    "_ZNK3FooeqERKS_": "Foo::operator==",
    "_ZN9__gnu_cxx13new_allocatorIcE10deallocateEPcm": "__gnu_cxx::new_allocator<char>::deallocate",
    "_ZNSs6appendEPKc": "std::string::append",
    "_ZSt4moveIRSsEONSt16remove_referenceIT_E4typeEOS2_": "std::remove_reference<std::string&>::type&& std::move<std::string&>",
    "_Z": None,
}


@query
def similar_words(spark, d):
    """The name cascade over all pairs of words that stand at the same place of neighbouring names, endings added."""
    x = _name_lists(spark, d).select("p_partkey", F.explode(F.arrays_zip("right", "guess")).alias("w"))
    ends = F.get(F.array(*[F.lit(e) for e in ("", "s", "ing", "_of", "er")]), (F.col("p_partkey") % 5).cast("int"))
    x = x.select("p_partkey", F.col("w.right").alias("right"), F.concat("w.guess", ends).alias("guess"))
    near = x.select("p_partkey", F.col("right"), F.concat("right", ends).alias("guess")).filter("p_partkey % 2 = 0")
    short = x.select("p_partkey", F.col("right"), F.regexp_replace("right", "[aeiou]", "").alias("guess"))
    x = x.unionByName(near).unionByName(short).select("right", "guess").distinct()
    return S.with_verdict(x, "right", "guess", "alike")


@query
def edges_by_binary(spark, d):
    """Equal names in two binaries are two nodes."""
    x = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("binary"), F.lit("main").alias("a"), F.col("l_linestatus").alias("b"))
    e = graph.edges(x, "a", "b", BINARY)
    return graph.closed(e, e.limit(0), BINARY).select("binary", "func", F.array_join("callee_internal", ",").alias("callees"), F.array_join("caller", ",").alias("callers"))
