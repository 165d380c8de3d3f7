import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import align, chatrecords, dedup, graph, models, pairing, sanitize, scoring
from marlstone.sources import files, schemas, sinks
from marlstone.streaming import incremental


def test_sanitize(spark):
    lines = ["", "  hello world ", "hello world", "Javanese", ".comment", "aaaa", "/usr/lib/a.so", "http://a.b/c", "x 0123456789", "12345678", "a;b;c;;;;"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "id int, text string")
    got = {r["id"]: r["strings_out"] for r in sanitize.sanitize(df, "text").collect()}
    assert got == {1: ["/usr/lib/a.so", "hello world", "http://a.b/c"], 2: []}
    many = "\n".join(f"line number {'x' * (i % 3 + 1)} {i}" for i in range(100)) + "\nhttp://a.b/c"
    assert len(sanitize.sanitize(spark.createDataFrame([(many,)], "text string"), "text").first()["strings_out"]) == 100


def test_binary_facts(spark):
    raw = spark.createDataFrame([("b", "/x/y: ELF, 64\n\n/x/y: ELF, 64", " libc\nlibc ", ["some words", "some words"])], "bin_name string, file_out string, ldd_out string, strings array<string>")
    r = sanitize.binary_facts(raw).first()
    assert (r["file_output"], r["ldd_output"], r["strings_out"]) == ("ELF, 64", "libc", ["some words"])


@pytest.mark.parametrize("seed", range(3))
def test_two_stage_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"n{rng.randrange(40)}", None if rng.random() < 0.1 else rng.choice(["", *[f"b{k}" for k in range(50)]])) for i in range(300)]
    names, bodies, want = set(), set(), []
    for i, n, b in rows:
        if n in names:
            continue
        names.add(n)
        if b == "" or (b is not None and b in bodies):
            continue
        bodies.add(b)
        want.append(i)
    df = spark.createDataFrame(rows, "i int, n string, b string")
    assert sorted(r["i"] for r in dedup.two_stage(df, "n", "b", ["i"], F.col("b").isNull() | (F.col("b") != "")).collect()) == want


def test_split_is_whole_and_stable(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("name"))
    a = {r["name"]: r["split"] for r in dedup.split(df, "name").collect()}
    assert a == {r["name"]: r["split"] for r in dedup.split(df.repartition(7), "name").collect()}
    assert [list(a.values()).count(x) for x in ("train", "test", "validation")] == [802, 100, 101]


def test_closure(spark):
    e = lambda *p: spark.createDataFrame([("x", *q) for q in p], "binary string, caller string, callee string")
    ext, keys = spark.createDataFrame([("puts",)], "symbol string"), ["binary"]
    got = {r["func"]: (r["callee_internal"], r["caller"]) for r in graph.closed(e(("a", "b"), ("a", "a")), e(("c", "b"), ("c", "puts")), keys, ext).collect()}
    assert got == {"a": (["a", "b"], ["a"]), "b": ([], ["a", "c"]), "c": (["b"], []), "puts": ([], ["c"])}
    one_way = {r["func"]: (r["callee_internal"], r["caller"]) for r in graph.closed(e(("a", "b")), e(("c", "b")), keys, two_way=False).collect()}
    assert one_way == {"a": (["b"], []), "b": ([], ["a", "c"])}


def test_equal_names_in_two_binaries(spark):
    e = graph.edges(spark.createDataFrame([("x", "main", "f"), ("y", "main", "g"), ("x", "main", "f")], "binary string, a string, b string"), "a", "b", ["binary"])
    assert sorted((r["binary"], r["func"], tuple(r["callee_internal"])) for r in graph.adjacency(e, ["binary"]).collect()) == [("x", "main", ("f",)), ("y", "main", ("g",))]
    own = spark.createDataFrame([("y", "g")], "binary string, symbol string")
    assert sorted(map(tuple, graph.classified(e, own, ["binary"]).collect())) == [("x", "main", "f", "internal"), ("y", "main", "g", "external")]


def test_replayed_splits(spark):
    names, saved = spark.range(50).select(F.col("id").alias("n")), spark.createDataFrame([(1, "test"), (2, "train"), (99, "train")], "n long, split string")
    got = {r["n"]: r["split"] for r in dedup.replayed(names, "n", saved).collect()}
    assert len(got) == 50 and got[1] == "test" and got[2] == "train" and 99 not in got


def test_snippets(spark):
    blocks = spark.createDataFrame([("f", "1", 0, "a"), ("f", "2", 1, "b"), ("f", "3", 2, "c"), ("g", "1", 0, "d")], "func string, block string, pos int, output string")
    matches = spark.createDataFrame([("f", "1", "9", "x"), ("f", "3", "9", "y"), ("g", "1", "1", "z")], "func string, block string, other_block string, other_code string")
    functions = spark.createDataFrame([("f", "F"), ("g", "G"), ("h", "H")], "func string, output string")
    got = {r["func"]: (r["input"], r["output"], [tuple(h) for h in r["history"]]) for r in align.snippets(blocks, functions, matches, spark.createDataFrame([("f", "cf"), ("h", "ch")], "func string, code string")).collect()}
    assert got == {"f": ("cf", "F", [("9", "y", "c")]), "h": ("ch", "H", [])}


def test_processes(spark):
    from marlstone.sources import processes

    paths = spark.createDataFrame([("a b; echo $x",), (None,)], "p string")
    r = processes.outputs(paths, "p", {"said": "printf %s {path}", "late": "sleep 5"}, timeout=0.3).collect()
    assert [(x["path"], x["said"], x["late"]) for x in r] == [("a b; echo $x", "a b; echo $x", processes.TOO_LONG)]


def test_inline_keeps_unmatched_lists(spark):
    f = spark.createDataFrame([("x", "f", "cf", ["main", "g", "nope", "h"]), ("x", "g", "cg", ["nope"]), ("x", "h", "ch", None)], "binary string, name string, code string, near array<string>")
    got = {r["name"]: [(n["kind"], n["name"], n["text"]) for n in r["near"]] for r in graph.inline(f, ["binary"], "name", "code", "near", "name", pairing.SKIP_INLINE).collect()}
    assert got == {"f": [("code", "g", "cg"), ("code", "h", "ch")], "g": [("name", "nope", None)], "h": []}


def test_pair_edges(spark):
    asm = ["nop"] * 5
    u = spark.createDataFrame([("a", "o", "p", "b", n, x, "code", s) for n, x, s in (("f1", asm, "1"), ("f2", asm[:4], "2"), ("f3", ["?? ??"], "3"), ("f4", asm, "4"), ("f5", asm, "5"))], "arch string, opt string, project string, binary string, func_name string, assembly array<string>, decomp_code string, start string")
    s = spark.createDataFrame([("a", "o", "p", "b", "1", "FUN_1", asm, "s1"), ("a", "o", "p", "b", "4", "FUN_4", ["?? ??"], "s4")], "arch string, opt string, project string, binary string, start string, func_name string, assembly array<string>, decomp_code string")
    c = spark.createDataFrame([("a", "o", "p", "b", n, ["x"], ["y"], ["z"]) for n in ("f1", "f4", "f5")], "arch string, opt string, project string, binary string, func_name string, caller array<string>, callee_internal array<string>, callee_external array<string>")
    sc = c.limit(0).withColumnRenamed("func_name", "start")
    got = {r["func_name"]: r for r in pairing.pair(u, s, c, sc).collect()}
    assert set(got) == {"f1", "f5"}
    assert got["f1"]["stripped"]["code"] == "s1" and got["f1"]["stripped"]["caller"] is None and got["f1"]["stripped_function_name"] == "FUN_1"
    assert got["f5"]["stripped"] is None


def test_greedy_is_one_to_one(spark):
    rows = [("f", "t", lid, lid, rid, rid, 0.0, 0.0, s) for lid, rid, s in ((1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.9), (2, 2, 0.3), (3, 1, 0.9), (3, 3, 0.29))]
    df = spark.createDataFrame(rows, "f string, k string, left_id int, left_pos int, right_id int, right_pos int, structure_score double, semantic_score double, final_score double")
    assert sorted((r["left_id"], r["right_id"]) for r in align.greedy(df, "f").collect()) == [(1, 1), (2, 2)]


def test_scores(spark):
    m = lambda rows: scoring.micro(spark.createDataFrame(rows, "tp long, fp long, fn long")).first().asDict()
    assert m([(1, 1, 2)])["precision"] == 0.5
    assert m([(0, 0, 3)])["f1"] == 0.0 and m([(0, 0, 3)])["precision"] == 0.0
    v = spark.createDataFrame([("A__b", "True", 0), ("a_b", "false", 1), (" ", "true", 2), (None, "true", 3)], "ground_truth string, similarity string, o int")
    assert [(r["key"], r["similar"]) for r in scoring.verdicts(v, order="o").collect()] == [("a_b", False)]
    none = scoring.agreement(scoring.verdicts(v.limit(0), "o"), scoring.verdicts(v.limit(0), "o")).first()
    assert none["n_common"] == 0 and none["ratio"] == 0.0
    x = spark.range(1).select(scoring.vector_verdict(F.lit(0.69999)).alias("v")).first()["v"]
    assert (x["similarity"], x["similarity_score"]) == (False, 0.7)


def test_chat_records_bounds(spark):
    def sample(n):
        return spark.createDataFrame([("Foo", "\n".join(f"x{i};" for i in range(n)), "info", ["puts"], [("code", f"g{i}", "t") for i in range(7)], [("name", "a", None), ("code", "b", "t")])], f"func_name string, input string, bin_info string, callee_external array<string>, callee_internal array<{schemas.NEIGHBOUR}>, caller array<{schemas.NEIGHBOUR}>")

    assert chatrecords.name_records(sample(3)).count() == 0
    r = chatrecords.name_records(sample(4)).first()["messages"]
    assert r[1]["content"] == "The function name is: foo."
    assert r[0]["content"].count("callee g") == 5 and "caller 2: t" in r[0]["content"]


def test_models(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, p string")
    assert models.complete(df, "id", "p").filter("error is null").count() == 2

    def broken():
        def client(prompts):
            raise RuntimeError("down")

        return client

    assert {r["error"] for r in models.complete(df, "id", "p", broken).collect()} == {"down"}
    v = {r["id"]: r["vec"] for r in models.embed(df, "p").collect()}
    assert len(v[1]) == 64 and v[2] is None


def test_files_round_trip(spark, tmp_path):
    d = tmp_path / "x86" / "O2" / "proj"
    d.mkdir(parents=True)
    (d / "bin.json").write_text('{"g": {"caller": ["a"], "address": "1"}, "f": {"caller": []}}')
    (d / "bad.json").write_text("{")
    docs = files.documents(spark, [str(tmp_path / "x86"), str(tmp_path / "missing")])
    rows = files.place_columns(files.records(docs, schemas.CALLS)).orderBy("pos").collect()
    assert [(r["key"], r["opt"], r["bin_name"]) for r in rows] == [("g", "O2", "proj/bin"), ("f", "O2", "proj/bin")]
    assert files.malformed(docs, schemas.CALLS).count() == 1
    assert files.documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "list.json").write_text('[{"f": {"code": "x"}}, {"g": {"code": "y"}}]')
    (tmp_path / "a b+c.json").write_text('{"f":\n {"caller": ["a"]}}')
    odd = files.records(files.documents(spark, str(tmp_path / "a b+c.json")), schemas.CALLS).first()
    assert odd["path"].endswith("/a b+c.json") and odd["caller"] == ["a"]
    assert [r["key"] for r in files.record_lists(files.documents(spark, str(tmp_path / "list.json")), schemas.SIDE).collect()] == ["f", "g"]
    (tmp_path / "s.txt").write_text("a b, a c,\n")
    assert files.score_lines(spark, str(tmp_path / "s.txt")).first()["prediction"] == " a c"
    (tmp_path / "bad.txt").write_text("a\n")
    with pytest.raises(Exception, match="no prediction"):
        files.score_lines(spark, str(tmp_path / "bad.txt")).collect()


def test_append_new_and_stream(spark, tmp_path):
    out, src = str(tmp_path / "out"), str(tmp_path / "src")
    sinks.append_new(spark.range(5), out, "id")
    sinks.append_new(spark.range(8), out, "id")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))
    wide = str(tmp_path / "wide")
    for n in (3, 40, 30):
        sinks.append_new(spark.range(n), wide, "id", buckets=5)
    assert sorted(r["id"] for r in spark.read.parquet(wide).collect()) == list(range(40))
    spark.range(6, 12).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    incremental.append_batches(stream, out, "id", ["id"], str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(12))
