from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import code as C
from marlstone.functions import similarity as S
from marlstone.functions import text as T

LOOP = "  for (i = 0; i < n; i++)\n  {\n    a = FUN_001(i);\n    b = 1;\n    c = 2;\n    d = 3;\n  }\n"
CODE = 'int run(int n)\n{\n  // FUN_7(x)\n  char *s = "FUN_8(y)";\n' + LOOP * 3 + "  return FUN_9(b) + FUN_001(2);\n}\n"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(spark, f, value):
    return one(spark, f(F.lit(value)))


def test_comments(spark):
    code = 'a = "x // y"; // z\n/* b\nc */ d("/*");\n'
    assert text(spark, T.strip_comments, code) == 'a = "x // y"; \n d("/*");\n'
    assert text(spark, T.strip_line_comments, "a; // b\n\n  \nc;") == "a; \nc;"


def test_fence_and_replies(spark):
    assert text(spark, T.strip_fence, "```json\n{}\n```") == "{}"
    assert text(spark, T.strip_fence, "json plain son") == "plain"
    reply = lambda c: T.json_reply(c, "code_description")
    assert text(spark, reply, '{"code_description": "adds"}') == "adds"
    assert text(spark, reply, 'Sure {"code_description": "adds"} ok') == "adds"
    assert text(spark, reply, '{"code_description": "adds}').strip() == '"adds"'
    assert text(spark, reply, "nothing") == "nothing"


def test_names(spark):
    assert text(spark, T.predicted_name, 'The name is: "a.b"') == "a"
    assert text(spark, T.predicted_name, "name: `get_x`. Because\nmore") == "get_x"
    assert text(spark, T.predicted_name, "") == ""
    assert text(spark, T.truth_name, "The function name is: Foo_Bar.") == "Foo_Bar"
    assert text(spark, T.canonical_name, " __a__b_ ") == "_a_b_"
    assert text(spark, T.name_words, "Curl_os400_getsockname") == "curl os getsockname"
    assert one(spark, T.guarded_name(F.lit("x" * 61), F.lit("orig"))) == "orig"
    assert one(spark, T.guarded_name(F.lit("x"), F.lit(""))) == " "
    assert one(spark, T.mask_first(F.lit("f(); f();"), F.lit("f"))) == "[MASK](); f();"


def test_quality_and_predicates(spark):
    assert text(spark, T.quality, "  ") == 1.0
    assert text(spark, T.quality, "abc") == 1.0
    assert text(spark, T.quality, "a;;;") < 0.3
    assert text(spark, T.is_placeholder, "aaaa") and text(spark, T.is_placeholder, "12 34") and not text(spark, T.is_placeholder, "été ab")
    assert text(spark, T.is_url, "HTTP://a.b/c") and not text(spark, T.is_url, "see http://a.b")
    assert text(spark, T.is_path, "/usr/lib/x.so") and text(spark, T.is_path, "main.c") and not text(spark, T.is_path, "main c")


def test_damerau_levenshtein():
    assert S.damerau_levenshtein("ca", "abc") == 2
    assert S.damerau_levenshtein("abcd", "acbd") == 1
    assert S.edit_similarity("", "") == 1.0


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=100, deadline=None)
def test_distance_is_symmetric_and_bounded(a, b):
    d = S.damerau_levenshtein(a, b)
    assert d == S.damerau_levenshtein(b, a)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert (d == 0) == (a == b)


def test_cascade():
    c = S.Cascade()
    assert c.similar("", "") and not c.similar("a", "")
    assert c.similar("recieve", "receive")
    assert c.similar("configuration", "cnfig")  # abbreviation
    assert c.similar("initialise", "init")  # prefix
    assert not c.similar("open", "close")
    assert c.counts(["send", "configuration"], ["send", "cnfig"]) == (2, 0, 0)
    assert c.counts(["the", "x"], ["for", "x"]) == (1, 1, 1)
    assert c.counts(["a", "a"], ["a", "a"]) == (2, 0, 0)
    assert c.counts([""], [""]) == (1, 0, 0)


def test_alignment():
    m = S.align("message", "msg")  # "g" costs as much as it brings: the first best cell is at "s"
    assert (m.score, m.confidence, m.places) == (3.0, 0.5, ((2, 1), (0, 0)))
    assert S.align("configuration", "cnfig").score == 9.0
    assert S.align("", "").confidence == 0.0


def test_masking_and_renaming():
    assert C.mask_definitions(CODE).startswith("int [MASK](int n)")
    assert C.mask_definitions("if (x) { f(); }") == "if (x) { f(); }"
    assert C.mask_definitions(None) is None
    out = C.rename_calls(CODE)
    assert "a = FUN_0(i)" in out and "FUN_1(b) + FUN_0(2)" in out and "// FUN_7(x)" in out and '"FUN_8(y)"' in out
    assert C.rename_calls("x = FUN_3;") == "x = FUN_3;"
    assert C.mask_first_call("int f(int g(void))\nh(") == "int [MASK](int g(void))\nh("


def test_blocks():
    got = C.blocks(CODE, "run")
    assert [b["type"] for b in got] == ["for_statement"] * 3 + ["function_definition"]
    assert [(b["line_start"], b["line_end"]) for b in got[:3]] == [(4, 11), (11, 18), (18, 25)]
    assert [b["block_id"] for b in got] == ["3", "2", "1", "run"]  # numbers fall to 1
    assert got[-1]["relation"] == ["3", "2", "1"] and got[-1]["block_code"].count("block 2") == 2
    assert [b["type"] for b in C.blocks("int f()\n{\n}\n", "f")] == ["full_function"]
    assert C.blocks(None, "f")[0]["type"] == "full_function"


def test_close_children_merge():
    inner = "      for (;;)\n      {\n" + "        x++;\n" * 12 + "      }\n"
    code = "void f()\n{\n  while (a)\n  {\n    if (b)\n    {\n" + inner + "    }\n  }\n}\n"
    assert [b["type"] for b in C.blocks(code, "f")[:-1]] == ["while_statement", "for_statement"]


def test_structure_paths():
    assert "translation_unit>function_definition>compound_statement>for_statement>compound_statement>expression_statement" in C.structure_paths(CODE)
    assert C.structure_paths("") == [] and C.structure_paths(None) == []


def test_demangle():
    assert C.demangle("_ZN3foo3barEv") == "foo::bar"
    assert C.demangle("x _Z3addii y") == "add"
    assert C.demangle("plain") == "plain"
    assert C.demangle("_ZStlsISt11char_traitsIcEERSt13basic_ostreamIcT_ES5_PKc") == "std::basic_ostream<char, std::char_traits<char> >& std::operator<< <std::char_traits<char> >"
    assert C.demangle("_Z3fooILi3EEvv") == "void foo<3>" and C.demangle("_ZN1AcviEv") == "A::operator int"
    assert C.demangle("_Z1gv and _Z99x") == "g" and C.demangle(None) is None


def test_udtf(spark):
    got = C.CodeBlocks(F.lit(CODE), F.lit("run")).collect()
    assert [r["block_id"] for r in got] == ["3", "2", "1", "run"]


def test_numbers_by_level():
    """Within a top-level block: itself, then each level from its last node; deeper levels later."""
    pad = "        x++;\n" * 6
    leaf = "      if (c)\n      {\n" + pad + "      }\n"
    code = "void f()\n{\n  while (a)\n  {\n    for (;;)\n    {\n" + pad + leaf + leaf + "    }\n" + leaf + "  }\n  while (z)\n  {\n" + pad + "  }\n}\n"
    got = {b["block_id"]: (b["type"], b["line_start"], b["relation"]) for b in C.blocks(code, "f")}
    assert got["f"][2] == ["6", "1"] and got["6"] == ("while_statement", 2, ["4", "5"])
    assert got["5"][:2] == ("if_statement", 31) and got["4"][:2] == ("for_statement", 4) and got["4"][2] == ["2", "3"]
    assert got["3"][1] > got["2"][1] and got["1"][0] == "while_statement"


def test_deep_code():
    n = 3000
    code = "int f()\n{\n" + "if (a)\n{\n" * n + "x = 1;\n" + "}\n" * n + "}\n"
    assert len(C.structure_paths(code)) == 1 and C.blocks(code, "f")[-1]["type"] == "function_definition"
    assert len(C.structure_paths("int f()\n{\n" + "if (a) ; else " * n + ";\n}\n")) > n


def test_many_definitions_in_linear_time():
    code = "".join(f"int f{i}(int a) {{ return g(a[{i}]); }}\n" for i in range(20_000))
    assert C.mask_definitions(code).count("[MASK]") == 20_000


def test_long_literals_paths_and_spaces(spark):
    """Patterns that would take a stack frame or a second look for each character of a long run."""
    n = 1_000_000
    rows = [('x = "' + "a" * n + '"; // c', "y"), ("/" + "a/" * (n // 2) + "b", "p"), ("a" + " " * n + "b", "s"), ("\\" * n, "b")]
    df = spark.createDataFrame(rows, "t string, k string")
    got = {r["k"]: r for r in df.select("k", F.length(T.strip_comments(F.col("t"))).alias("c"), T.is_path(F.col("t")).alias("p"), F.length(T.strip(F.col("t"))).alias("s")).collect()}
    assert got["y"]["c"] == n + 8 and got["p"]["p"] and not got["s"]["p"] and got["s"]["s"] == n + 2
    ends = spark.createDataFrame([("  a b \n",), ("\u00a0x\t",), ("   ",), ("",)], "t string")
    assert [r[0] for r in ends.select(T.strip(F.col("t"))).collect()] == ["a b", "x", "", ""]