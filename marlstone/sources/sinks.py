"""Writes: partitioned tables, chat records, metric lines, and appends that skip what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.dedup import last_by
from marlstone.sources import schemas
from marlstone.sources.files import PLACE, _existing


def write_places(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A folder per arch, opt, project and binary; equal names in different places never meet."""
    df.write.partitionBy(*[p for p in PLACE if p in df.columns]).format(form).save(path)


def write_splits(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.partitionBy("split").format(form).save(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.json(path)


def write_pairs(df: DataFrame, path: str, truth: str = "truth", prediction: str = "prediction") -> None:
    """Lines "truth, prediction," for the scorer."""
    df.select(F.concat(F.col(truth), F.lit(", "), F.col(prediction), F.lit(",")).alias("value")).write.text(path)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """JSON lines that tell their part, by whose values ``merged_parts`` takes them. Files follow the rows' partitions: a
    folder per value would make a file per value and task, and their number, not the rows, would set the time."""
    df.withColumn(part, F.col(part).cast("bigint")).write.json(path)


def merged_parts(spark: SparkSession, path: str, key: str, part: str, schema: str) -> DataFrame:
    """The rows of all parts by key, those of later parts in place of earlier ones; the files' own order plays no part.

    Lines tell their part, or lie in a folder named for it."""
    rows = spark.read.schema(f"{schema}, `{part}` bigint").json(path)
    return last_by(rows, key, part).drop(part)


def registration(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(dataset, section, name, value): what an external trainer is told of the chat records at path."""
    rows = [(name, "", "file_name", path), (name, "", "formatting", schemas.CHAT_DATASET["formatting"])]
    rows += [(name, section, k, v) for section in ("columns", "tags") for k, v in schemas.CHAT_DATASET[section].items()]
    return spark.createDataFrame(rows, "dataset string, section string, name string, value string")


def append_new(df: DataFrame, path: str, key: str, buckets: int = 0) -> None:
    """Append rows whose key the table at path does not have; a rerun adds nothing.

    Of the table its key column is read, and with ``buckets`` (the same in each run) only that of the folders in which the
    rows' keys may lie: the table then has a partition column ``key_bucket``, and the work follows the rows, not the table.
    """
    spark = df.sparkSession
    if buckets:
        df = df.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if _existing(spark, [path]):
        table = spark.read.parquet(path)
        if buckets:
            table = table.filter(F.col("key_bucket").isin([r[0] for r in df.select("key_bucket").distinct().collect()]))
        df = df.join(table.select(key).distinct(), key, "left_anti")
    writer = df.write.mode("append")
    (writer.partitionBy("key_bucket") if buckets else writer).parquet(path)
