"""Queries of the library's own operators over the stand-in tables; each name has its SQL in ``marlstone.oracles``.

``marlstone.edge_queries`` adds those that read, write, stream or ask a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import code as C
from marlstone.functions import similarity as S
from marlstone.functions import text as T
from marlstone.operators import align, chatrecords, dedup, graph, models, pairing, sanitize, scoring

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d):
    """(doc_id, pos, line) of all documents."""
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return x.select("doc_id", "pos", T.strip(F.col("line")).alias("line")).filter("line <> ''")


# Text


@query
def sanitize_lines(spark, d):
    x = sanitize.sanitize(_t(spark, d, "documents"), "text")
    return x.select("doc_id", F.size("strings_out").alias("n_lines"), F.array_join("strings_out", "\n").alias("strings_out"))


@query
def text_quality_score(spark, d):
    x = _lines(spark, d).select("doc_id", "pos", T.quality(F.col("line")).alias("q"))
    return x.select("doc_id", "pos", F.round("q", 6).alias("score"), (F.col("q") < T.GIBBERISH).alias("gibberish"))


@query
def ordered_line_dedup(spark, d):
    x = T.distinct_lines(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(x).alias("n_lines"), F.array_join(x, "\n").alias("lines"))


@query
def placeholder_filter(spark, d):
    return _lines(spark, d).select("doc_id", "pos", T.is_placeholder(F.col("line")).alias("is_placeholder"))


@query
def literal_deny_filter(spark, d):
    words = _t(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    more = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("p_partkey"), F.element_at(F.array(*[F.lit(x) for x in T.LANGUAGES[:20]]), F.col("n_nationkey") % 20 + 1).alias("word"))
    return words.unionByName(more).select("p_partkey", "word", T.is_denied(F.col("word")).alias("denied"))


@query
def sequence_filter(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("x0123456789y")).otherwise(F.lit("0123"))).alias("line"))
    return x.select("doc_id", T.has_sequence(F.col("line")).alias("has_sequence"))


@query
def url_predicate(spark, d):
    return _t(spark, d, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"), T.is_url(F.col("html")).alias("html_is_url"))


@query
def path_predicate(spark, d):
    p = F.regexp_replace("url", r"^[a-z]+://[^/]+|[?#].*$", "")
    return _t(spark, d, "pages").select("page_id", T.is_path(p).alias("is_path"), T.is_path(F.concat(F.lit("src"), p, F.lit(".c"))).alias("file_is_path"))


@query
def binary_name(spark, d):
    p = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".json"))
    return _t(spark, d, "pages").select("page_id", T.bin_name(p).alias("bin_name"))


@query
def head_tail_sample(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    y = T.head_and_tail(F.col("w"))
    return x.select("doc_id", F.size(y).alias("n"), F.array_join(y, " ").alias("sample"))


@query
def strip_line_comments(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.strip_line_comments(F.regexp_replace("html", ">", ">\n"))).alias("code_md5"))


@query
def strip_all_comments(spark, d):
    code = F.concat(F.lit('int f() { /* a\nb */ return g("x // y"); } // z\n'), F.regexp_replace("html", ";", "; /* c */"))
    return _t(spark, d, "pages").select("page_id", F.md5(T.strip_comments(code)).alias("code_md5"))


@query
def strcmp_keyword(spark, d):
    code = F.concat(F.lit("if (!StrCmp(argv[1], \""), F.regexp_extract("url", r"//([a-zA-Z.]+)", 1), F.lit('")) run();'))
    return _t(spark, d, "pages").select("page_id", T.compared_literal(code).alias("keyword"), T.compared_literal(F.col("html")).alias("html_keyword"))


@query
def min_nonblank_lines(spark, d):
    n = T.non_blank_lines(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", n.alias("n_lines"), (n > 3).alias("is_name_sample"), (n > 5).alias("is_summary_sample"), (F.size(T.lines(F.col("text"))) >= C.LEAST_LINES).alias("has_blocks"))


@query
def line_slice(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.line_range(F.col("text"), 1, 3).alias("part"))


@query
def mask_and_unmask(spark, d):
    name = F.split_part("text", F.lit(" "), F.lit(2))
    x = _t(spark, d, "documents").select("doc_id", "text", name.alias("name")).select("doc_id", "name", T.mask_first(F.col("text"), F.col("name")).alias("masked"))
    return x.select("doc_id", F.md5("masked").alias("masked_md5"), F.md5(T.unmask(F.col("masked"), F.col("name"))).alias("unmasked_md5"))


@query
def file_report(spark, d):
    text = F.concat(F.lit("/bin/x: ELF 64-bit, x86-64, "), "text")
    return _t(spark, d, "documents").select("doc_id", F.md5(T.clean_file_report(text)).alias("report_md5"), F.md5(T.without_last_field(text)).alias("short_md5"))


@query
def import_labels(spark, d):
    x = _t(spark, d, "supplier")
    return x.select("s_suppkey", T.import_name(F.concat("s_name", F.lit("@@GLIBC_2.2"))).alias("name"), T.external_label(F.col("s_suppkey")).alias("label"))


# Deduplication and splits


@query
def first_wins_name_dedup(spark, d):
    return dedup.first_by(_t(spark, d, "documents"), "source", ["doc_id"]).select("source", "doc_id")


@query
def first_wins_body_dedup(spark, d):
    return dedup.first_by(_t(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query
def two_stage_dedup(spark, d):
    x = _t(spark, d, "documents").withColumn("name", F.concat_ws("_", "source", F.substring("text", 1, 3)))
    return dedup.two_stage(x, "name", "text", ["doc_id"], F.length("text") > 0).select("name", "doc_id")


@query
def last_wins_merge(spark, d):
    x = _t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return dedup.last_by(x, "user_id", "event_id")


@query
def deterministic_split(spark, d):
    return dedup.split(_t(spark, d, "documents"), "doc_id")


@query
def split_audit_counts(spark, d):
    return dedup.split(_t(spark, d, "documents"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query
def skip_existing(spark, d):
    done = _t(spark, d, "labels").select("doc_id").distinct()
    return _t(spark, d, "documents").join(done, "doc_id", "left_anti").select("doc_id")


@query
def union_corpora(spark, d):
    x = _t(spark, d, "documents")
    named = ("en", "de", "fr", "es")
    parts = [x.filter(F.col("lang") == lang) for lang in named] + [x.filter(F.col("lang").isNull() | ~F.col("lang").isin(*named))]
    return reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("part"), "doc_id", "lang") for k, p in enumerate(parts)])


# Pairing


@query
def sibling_semi_join(spark, d):
    o, c, l = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "lineitem")
    x = o.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("k")).withColumnRenamed("o_custkey", "c_custkey")
    y = pairing.complete_binaries(x, c.filter("c_acctbal > 0"), keys=["c_custkey"])
    return pairing.complete_binaries(y, l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), keys=["k"]).select("o_orderkey", "c_custkey")


def _functions(spark, d):
    """Orders as functions: customer is the binary, priority the name, order key the address."""
    o = _t(spark, d, "orders")
    base = {"arch": F.lit("x"), "opt": F.col("o_orderstatus"), "project": F.lit("p"), "binary": F.col("o_custkey").cast("string")}
    asm = F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("?? ??"))).otherwise(F.array_repeat(F.lit("nop"), (F.col("o_orderkey") % 9).cast("int")))
    name = F.concat(F.lit("fn_"), F.col("o_orderkey").cast("string"))
    code = F.concat(F.lit("int "), name, F.lit("(void) { return "), F.col("o_custkey").cast("string"), F.lit("; }"))
    return o.select(*[v.alias(k) for k, v in base.items()], name.alias("func_name"), asm.alias("assembly"), code.alias("decomp_code"), F.col("o_orderkey").cast("string").alias("start"), "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


def _paired(spark, d):
    f = _functions(spark, d)
    stripped = f.filter("opt <> 'P'").select(*pairing.KEYS, "start", F.concat(F.lit("FUN_"), "start").alias("func_name"), "assembly", F.replace("decomp_code", F.lit("fn_"), F.lit("FUN_")).alias("decomp_code"))
    near = lambda k: F.array(F.concat(F.lit("fn_"), (F.col("o_orderkey") + k).cast("string")))
    calls = f.filter("o_orderpriority <> '5-LOW'").select(*pairing.KEYS, "func_name", near(1).alias("caller"), near(2).alias("callee_internal"), F.array(F.lit("puts")).alias("callee_external"))
    s_calls = f.filter("o_totalprice > 100000").select(*pairing.KEYS, "start", F.array().cast("array<string>").alias("caller"), F.array().cast("array<string>").alias("callee_internal"), F.array(F.lit("_puts")).alias("callee_external"))
    return pairing.pair(f.drop("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), stripped, calls, s_calls)


@query
def function_pairs(spark, d):
    return _paired(spark, d).select(
        "opt", "binary", "func_name", F.col("unstripped.code").alias("code"), F.array_join("unstripped.caller", ",").alias("caller"), F.col("stripped.code").alias("stripped_code"),
        F.array_join("stripped.callee_external", ",").alias("stripped_external"), F.array_join("stripped.callee_internal", ",").alias("stripped_internal"), "stripped_function_name",
    )


@query
def prediction_pairs(spark, d):
    f = _functions(spark, d).withColumn("assembly", F.array_repeat(F.lit("nop"), (F.col("o_orderkey") % 20).cast("int")))
    calls = f.filter("o_orderpriority <> '5-LOW'").select("func_name", F.array("start").alias("caller"), F.array().cast("array<string>").alias("callee_internal"), F.array(F.lit("puts")).alias("callee_external"))
    return pairing.attach_calls(f, calls, ["func_name"]).select("func_name", F.array_join("caller", ",").alias("caller"), F.size("assembly").alias("n_assembly"))


@query
def context_attach(spark, d):
    s = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("bin_name"))
    c = _t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("bin_name"), F.col("c_name").alias("bin_info"))
    return pairing.attach_context(s, c)


@query
def context_missing_audit(spark, d):
    s = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("bin_name"))
    return pairing.without_context(s, _t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("bin_name")))


@query
def constant_context(spark, d):
    return pairing.attach_constant(_t(spark, d, "nation").select("n_nationkey", "n_name"), _t(spark, d, "region"), "r_regionkey")


@query
def skip_list_anti(spark, d):
    x = _t(spark, d, "part").withColumn("func_name", F.when(F.col("p_partkey") % 10 == 0, "main").when(F.col("p_partkey") % 10 == 1, "FUN_0010").otherwise(F.col("p_name")))
    return x.filter(pairing.not_skipped(F.col("func_name"))).select("p_partkey", "func_name")


@query
def assembly_window(spark, d):
    n = F.col("l_quantity").cast("int") * 30
    asm = F.when(F.col("l_linenumber") == 7, F.array(F.lit("?? ??"))).otherwise(F.array_repeat(F.lit("nop"), n))
    return _t(spark, d, "lineitem").filter(pairing.has_valid_assembly(asm)).select("l_orderkey", "l_linenumber", "l_quantity")


# Graphs

BINARY = ["binary"]


def _edges(spark, d):
    """Parts call suppliers; the line's status is the binary, so equal names stand in two binaries."""
    x = _t(spark, d, "lineitem").select(F.col("l_linestatus").alias("binary"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))
    return graph.edges(x, "a", "b", BINARY)


def _joined(c):
    return F.array_join(c, ",")


@query
def edge_extract_unique(spark, d):
    return graph.adjacency(_edges(spark, d), BINARY).select("binary", "func", _joined(F.col("callee_internal")).alias("callees"))


@query
def ordered_adjacency(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_linestatus").alias("binary"), F.col("l_suppkey").cast("string").alias("caller"), F.col("l_returnflag").alias("callee"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return graph.adjacency(x, BINARY, "at").select("binary", "func", _joined(F.col("callee_internal")).alias("callees"))


def _half_edges(spark, d):
    """Edges seen from the caller (not returned) and from the callee (returned)."""
    x = _t(spark, d, "lineitem").select(F.col("l_linestatus").alias("binary"), "l_returnflag", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))
    return graph.edges(x.filter("l_returnflag <> 'R'"), "a", "b", BINARY), graph.edges(x.filter("l_returnflag = 'R'"), "a", "b", BINARY)


@query
def edge_closure(spark, d):
    forward, backward = _half_edges(spark, d)
    external = _t(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return graph.closed(forward, backward, BINARY, external).select("binary", "func", _joined(F.col("callee_internal")).alias("callees"), _joined(F.col("caller")).alias("callers"))


@query
def forward_closure(spark, d):
    forward, backward = _half_edges(spark, d)
    return graph.closed(forward, backward, BINARY, two_way=False).select("binary", "func", _joined(F.col("callee_internal")).alias("callees"), _joined(F.col("caller")).alias("callers"))


@query
def external_classify(spark, d):
    external = _t(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return graph.classified(_edges(spark, d), external, BINARY)


def _inlined_sources(spark, d):
    p = _t(spark, d, "part")
    near = F.array(*[((F.col("p_partkey") * k + k) % 400).cast("string") for k in (1, 3, 7, 11, 13, 17, 19)])
    return p.select("p_brand", F.col("p_partkey").cast("string").alias("func_name"), F.col("p_name").alias("code"), near.alias("callee_internal"))


def _inlined(spark, d):
    return graph.inline(_inlined_sources(spark, d), ["p_brand"], "func_name", "code", "callee_internal", "func_name", skip=("0", "8"))


@query
def neighbor_inline(spark, d):
    line = F.transform("callee_internal", lambda x: F.concat_ws(":", x["kind"], x["name"], x["text"]))
    return _inlined(spark, d).select("p_brand", "func_name", F.array_join(line, ",").alias("callees"))


@query
def first_n_neighbors(spark, d):
    x = _inlined(spark, d)
    return x.select("p_brand", "func_name", chatrecords.described(F.col("callee_internal"), "callee", False).alias("callees"), chatrecords.described(F.col("callee_internal"), "caller", True).alias("callers"))


# Similarity and alignment


@query
def jaccard_tokens(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.split("text", r"\s+").alias("w"))
    return x.join(x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("b")), "doc_id").select("doc_id", F.round(S.jaccard(F.col("w"), F.col("b")), 9).alias("jaccard"))


def _blocks(spark, d, side, whole=False):
    """Vectors as blocks: ten of a row make a function, the label is the type; with whole, two of them are whole functions."""
    e = _t(spark, d, "embeddings")
    e = e.filter(F.col("vec_id") % 2 == side)
    key = F.when(F.col("vec_id") % 40 < 2, F.lit("open"))
    kind = F.concat(F.lit("t"), (F.col("label") % 3).cast("string"))
    kind = F.when(F.col("vec_id") % 20 >= 18, F.lit("full_function")).otherwise(kind) if whole else kind
    return e.select(
        F.floor(F.col("vec_id") / 20).alias("func"), kind.alias("type"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"),
        F.array(F.concat(F.lit("a"), (F.col("vec_id") % 3).cast("string")), F.concat(F.lit("b"), (F.col("vec_id") % 5).cast("string")), F.lit("c")).alias("paths"),
        F.col("embedding").alias("vec"), key.alias("keyword"),
    )


def _scored(spark, d, whole=False):
    x = align.scored_pairs(_blocks(spark, d, 0, whole), _blocks(spark, d, 1, whole), "func", "type")
    return x.withColumn("final_score", F.round("final_score", 6)).withColumn("semantic_score", F.round("semantic_score", 6)).withColumn("structure_score", F.round("structure_score", 6))


@query
def blended_scores(spark, d):
    return _scored(spark, d).select("func", "type", "left_id", "right_id", "structure_score", "semantic_score", "final_score")


@query
def argmax_candidate(spark, d):
    return align.best_candidate(_scored(spark, d), "left_id").select("left_id", "right_id", "final_score")


@query
def blended_alignment(spark, d):
    return align.greedy(_scored(spark, d, whole=True), "func").select("func", "left_id", "right_id", "final_score")


@query
def cosine_pairs(spark, d):
    e = _t(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


# Replies and names


def _replies(spark, d):
    k = F.get_json_object("props", "$.k")
    strict = F.concat(F.lit('{"code_description": "does '), k, F.lit('"}'))
    kinds = [strict, F.concat(F.lit("```json\n"), strict, F.lit("\n```")), F.concat(F.lit("Sure: "), strict, F.lit(" ok")), F.concat(F.lit('{"code_description": "cut '), k, F.lit("}")), F.concat(F.lit("plain "), k)]
    r = F.lit(None).cast("string")
    for i, x in enumerate(kinds):
        r = F.when(F.col("event_id") % 5 == i, x).otherwise(r)
    return _t(spark, d, "events").select("event_id", r.alias("reply"))


@query
def json_reply_extract(spark, d):
    x = _replies(spark, d)
    return x.select("event_id", T.json_reply(T.strip_fence(F.col("reply")), "code_description").alias("description"), T.json_reply(F.col("reply"), "code_description", drop_key=False).alias("with_key"))


@query
def json_name_extract(spark, d):
    x = _replies(spark, d).withColumn("reply", F.replace("reply", F.lit("code_description"), F.lit("new_name")))
    got = T.json_reply(T.strip_fence(F.col("reply")), "new_name", close_quote=False)
    return x.select("event_id", T.guarded_name(got, F.lit("orig"), 12).alias("new_name"))


def _answers(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    w, v = (F.regexp_replace(F.substring("text", *at), r"[^\p{L}]", "") for at in ((F.lit(1), half), (half + 1, F.length("text"))))
    kinds = [
        F.concat(F.lit("The function name is: "), w, F.lit("_"), v, F.lit(".\nbecause")), F.concat(F.lit('Name: "'), w, F.lit('" I think')), F.concat(F.lit("It is `ns::"), w, F.lit("`")),
        F.concat(w, F.lit("::"), v), F.concat(F.lit("call "), w, F.lit(" "), v), F.lit(""),
    ]
    r = F.lit(None).cast("string")
    for i, x in enumerate(kinds):
        r = F.when((F.col("conv_id") + F.col("turn")) % 6 == i, x).otherwise(r)
    return _t(spark, d, "conversations").select("conv_id", "turn", r.alias("answer"), "text")


@query
def prediction_parse(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.predicted_name(F.col("answer")).alias("predicted"))


@query
def truth_parse(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.truth_name(F.col("answer")).alias("truth"), T.clean_reply(F.concat(F.lit("assistant: "), "answer")).alias("reply"))


@query
def name_tokens(spark, d):
    x = F.concat("p_name", F.lit("_"), "p_brand", F.lit(" "), "p_type")
    return _t(spark, d, "part").select("p_partkey", T.name_words(x).alias("tokens"), F.size(T.words(F.col("p_name"))).alias("n_words"))


@query
def canonicalize_name(spark, d):
    x = F.concat(F.lit(" __"), F.replace("p_name", F.lit(" "), F.lit("___")), F.lit("_ "))
    return _t(spark, d, "part").select("p_partkey", T.canonical_name(x).alias("name"))


def _pairs_of_names(spark, d):
    """(p_partkey, a, b): the names of neighbours by key."""
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


@query
def edit_similarity(spark, d):
    x = _pairs_of_names(spark, d)
    return S.with_similarity(x, "a", "b").select("p_partkey", F.round("similarity", 9).alias("similarity"))


@query
def prefix_match(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.substring("p_name", 1, 3).alias("b"))
    return p.unionByName(_pairs_of_names(spark, d)).select("p_partkey", S.is_prefix(F.col("a"), F.col("b")).alias("is_prefix"))


@query
def abbreviation_match(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", F.regexp_replace("p_name", "[aeiou ]", "").alias("short"))
    return p.select("p_partkey", S.align_udf("p_name", "short").alias("m")).select("p_partkey", "m.score", "m.confidence", "m.n_places")


def _name_lists(spark, d):
    other = _t(spark, d, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), T.words(F.col("p_name")).alias("guess"))
    return _t(spark, d, "part").select("p_partkey", T.words(F.col("p_name")).alias("right")).join(other, "p_partkey")


@query
def token_counts(spark, d):
    return _name_lists(spark, d).select("p_partkey", scoring.exact_counts(F.col("right"), F.col("guess")).alias("c")).select("p_partkey", "c.*")


@query
def micro_prf1(spark, d):
    m = scoring.micro(_name_lists(spark, d).select(scoring.exact_counts(F.col("right"), F.col("guess")).alias("c")).select("c.*"))
    return m.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def similar_prf1(spark, d):
    m = scoring.micro(_name_lists(spark, d).select(S.counts_udf()("right", "guess").alias("c")).select("c.*"))
    return m.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def judge_agreement(spark, d):
    x = _t(spark, d, "labels")
    key = F.concat(F.lit("__"), F.floor(F.col("doc_id") / 7).cast("string"))
    side = lambda c, keep: x.filter(keep).select("doc_id", key.alias("ground_truth"), F.when(F.col(c) == 1, "True").otherwise("false").alias("similarity"))
    a = scoring.agreement(scoring.verdicts(side("quality", "quality = 1 or toxic = 0"), "doc_id"), scoring.verdicts(side("toxic", "quality = 0 or toxic = 0"), "doc_id"))
    return a.withColumn("ratio", F.round("ratio", 9))


@query
def similar_rate(spark, d):
    return scoring.rate(_t(spark, d, "labels"), F.col("quality") == 1).withColumn("rate", F.round("rate", 9))


@query
def vector_verdicts(spark, d):
    whole = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double") * 0.8)
    e = _t(spark, d, "embeddings").select("vec_id", scoring.vector_verdict(F.round(whole + F.element_at("embedding", 1).cast("double"), 6)).alias("v"))
    return e.select("vec_id", F.col("v.similarity").alias("similarity"), F.round("v.similarity_score", 4).alias("similarity_score"))


# Records and streams


@query
def chat_records(spark, d):
    c = _t(spark, d, "conversations")
    user, reply = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    x = user.join(reply, ["conv_id", "turn"]).withColumn("func_name", F.concat_ws("_", "conv_id", "turn"))
    s = chatrecords.summary_records(x, template="Code:\n{code}\n", least=1)
    n = x.select("func_name", "input", F.lit("info").alias("bin_info"), F.array(F.lit("puts"), F.lit("free")).alias("callee_external"), F.array(F.struct(F.lit("code").alias("kind"), F.lit("g").alias("name"), F.lit("adds").alias("text"))).alias("callee_internal"), F.array().cast("array<struct<kind:string,name:string,text:string>>").alias("caller"))
    names = chatrecords.name_records(n, template="{bin_info}|{callee_external}|{callee_internal}|{caller}|{code}", least=1)
    r = chatrecords.training_set(s, None, names)
    return r.select("part", "func_name", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").alias("record"))


@query
def context_prompts(spark, d):
    x = _t(spark, d, "documents").select(F.col("doc_id").alias("bin_name"), F.split("text", " ").alias("strings_out"), F.lit("libc").alias("ldd_output"), F.concat(F.lit("ELF, "), "lang", F.lit(", x")).alias("file_output"))
    return chatrecords.context_prompts(x, "{strings}|{ldd}|{file}").select("bin_name", F.md5("prompt").alias("prompt_md5"))


@query
def checkpoint_counts(spark, d):
    return _t(spark, d, "events").select(F.floor(F.col("event_id") / 1000).alias("batch"), "user_id").groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query
def completion_order(spark, d):
    x = _t(spark, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("arrived"), "user_id")
    return x


@query
def model_replies(spark, d):
    return models.complete(_t(spark, d, "benchmark").select("item_id", "text"), "item_id", "text").select("id", T.json_reply(F.col("reply"), "code_description").alias("description"))


# Code


_LOOP = "  for (i = 0; i < n; i++)\n  {\n    a = FUN_00@K(i);\n    b += a;\n\n    c = 1;\n    d = 2;\n  }\n"
_IF = "    if (m)\n    {\n      a = 1;\n      b = 2;\n      c = 3;\n      d = 4;\n    }\n"
_BODIES = (_LOOP, _LOOP * 2, "  while (n)\n  {\n" + _IF + "  }\n" + _LOOP, "  while (n)\n  {\n" + "    n -= FUN_7(n);\n" * 8 + _IF + "  }\n")
#: Four programs: a short one, two loops, a loop nearly covered by its only child, and one that is not.
PROGRAMS = tuple('int run_@K(int n)\n{\n' + body + '  log("@H (");\n  return FUN_9(b) + FUN_00@K(1);\n}\n' for body in _BODIES)


def _code(spark, d):
    """Each page's digest inside one of the programs, chosen by the page's length."""
    program = F.get(F.array(*[F.lit(p) for p in PROGRAMS]), F.length("html") % 4)
    return _t(spark, d, "pages").select("page_id", F.replace(F.replace(program, F.lit("@K"), F.col("page_id").cast("string")), F.lit("@H"), F.md5("html")).alias("code"))


@query
def mask_names(spark, d):
    return _code(spark, d).select("page_id", F.md5(C.mask_definitions_udf("code")).alias("masked_md5"), F.md5(T.mask_called_name(F.col("code"))).alias("first_md5"))


@query
def rename_calls(spark, d):
    return _code(spark, d).select("page_id", F.md5(C.rename_calls_udf("code")).alias("renamed_md5"))


@query
def code_blocks(spark, d):
    x = _code(spark, d).select("page_id", F.explode(C.code_blocks_udf("code", F.lit("run"))).alias("b"))
    return x.select("page_id", "b.block_id", "b.type", "b.line_start", "b.line_end", F.array_join("b.relation", ",").alias("relation"))


@query
def structure_paths(spark, d):
    return _code(spark, d).select("page_id", F.array_join(C.structure_paths_udf("code"), "\n").alias("paths"))
