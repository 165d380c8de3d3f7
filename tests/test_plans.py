import os

from pyspark.sql import functions as F

from marlstone.plans import rows, sampling, storage


def test_scope_deletes_cuts(spark):
    with storage.scope():
        c = storage.Cut(spark.range(5), "five")
        at = c.path.removeprefix("file://")
        assert os.path.isdir(at) and c.df.count() == 5
        d = storage.Cut(spark.range(2), "two")
        d.drop()
        assert not os.path.isdir(d.path.removeprefix("file://"))
    assert not os.path.isdir(at)


def test_hash_sample_is_the_plain_one(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(40)
    got = [r["id"] for r in sampling.hash_sample(df, 50, ["id"], ["id"]).collect()]
    want = [r["id"] for r in df.orderBy(sampling.place("id"), "id").limit(50).collect()]
    assert got == want
    assert sampling.hash_sample(df, 50, ["k"], ["id"]).count() == 50
    assert sampling.hash_sample(df.limit(0), 50, ["id"]).count() == 0 and sampling.hash_sample(df.limit(3), 50, ["id"]).count() == 3


def test_rows_with_awkward_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], ["row", "a.b", "x `y`"])
    p = df.select(rows.packed(df), rows.col("a.b").alias("t"))
    out = rows.unpacked(p, df.columns, **{"a.b": F.upper("t")})
    assert out.columns == df.columns and tuple(out.first()) == (1, "A", 2.0)
