import pytest
from pyspark.sql import functions as F

from marlstone.functions import ingest as I


def test_predicates(spark):
    df = spark.createDataFrame([("a/b.I64", "LOAD"), ("a/b", ".text"), ("a.d/x.so", ".plt"), (".idb", "COMMON")], "path string, seg string")
    rows = df.select(I.is_binary_file(F.col("path")).alias("b"), I.is_code_segment(F.col("seg")).alias("c"), I.is_linkage_segment(F.col("seg")).alias("p")).collect()
    assert [r["b"] for r in rows] == [False, True, True, True]
    assert [r["c"] for r in rows] == [True, True, False, True] and [r["p"] for r in rows] == [False, False, True, False]


def test_ids_and_types(spark):
    df = spark.createDataFrame([("puts", "0x1", True), ("f", "0x2", None), ("g", None, False)], "name string, address string, ext boolean")
    assert [r[0] for r in df.select(I.display_id(F.col("name"), F.col("address"), F.col("ext"))).collect()] == ["puts", "0x2", "EXT_g"]
    edges = spark.createDataFrame([("a", "f", "puts"), ("a", "f", "h"), ("b", "f", "h")], "binary string, caller string, callee string")
    ids = spark.createDataFrame([("a", "f", "0x2"), ("a", "puts", "puts"), ("b", "h", "0x9")], "binary string, name string, id string")
    assert sorted(map(tuple, I.renamed_edges(edges, ids, ["binary"]).collect())) == [("a", "0x2", "h"), ("a", "0x2", "puts"), ("b", "f", "0x9")]
    t = spark.createDataFrame([("foo_t **", "int"), ("char *", None), ("int", "int")], "n string, b string")
    assert [r[0] for r in t.select(I.type_label(F.col("n"), F.col("b"))).collect()] == ["int *", "char *", "int"]


def test_one_mode():
    assert I.one_mode(dataset=True, prediction=False) == "dataset"
    with pytest.raises(ValueError, match="exactly one"):
        I.one_mode(dataset=True, prediction=True)
