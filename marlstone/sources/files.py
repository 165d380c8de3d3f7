"""Scans of JSON documents and text, through Spark's readers only, so any store that Spark knows will do."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ["arch", "opt", "project", "binary"]


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    conf, found = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).globStatus(at):
            found.append(p)
    return found


def place_columns(df: DataFrame, path: str = "path", depth: int = 4) -> DataFrame:
    """Adds arch, opt, project, binary and bin_name from the last parts of a path."""
    parts = F.split(F.regexp_replace(path, r"\.json$", ""), "/")
    for k, name in enumerate(PLACE[-depth:]):
        df = df.withColumn(name, F.element_at(parts, k - depth))
    return df.withColumn("bin_name", F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))


def documents(spark: SparkSession, paths: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(path, value): each file's whole text, found recursively; paths that do not exist are skipped."""
    there = _existing(spark, [paths] if isinstance(paths, str) else paths)
    if not there:
        return spark.createDataFrame([], "path string, value string")
    return _reader(spark, pattern).text(there, wholetext=True).select(_path().alias("path"), "value")


def _reader(spark: SparkSession, pattern: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def _path():
    # The metadata's path is a URI, in which a plus is itself.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


#: Characters of blocks that a file is read in, and of the objects it is cut into.
BLOCK, OBJECT = 1 << 18, 1 << 19
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\],]', re.DOTALL)


def _glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (path, size, start, n, value) of the pieces between closing braces that a task reads in their order."""
    at, n, held, length = None, 0, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [at[0]], "size": [at[1]], "start": [at[2]], "n": [n], "value": [b"".join(held)]}, _BLOCKS)

    for b in batches:
        for *key, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != key or length > BLOCK:
                if held:
                    yield block()
                n, held, length = (n + 1 if at == key else 0), [], 0
                at = key
            held += (value, b"}")
            length += len(value) + 1
    if held:
        yield block()


_BLOCKS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("value", pa.binary())])
_OBJECTS = pa.schema([("path", pa.string()), ("first", pa.int64()), ("value", pa.string())])


class _Cutter:
    """Cuts one file's object, given block by block, into objects of some of its records. They wait in a file of the task
    until the last brace, as a malformed file gives none."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.got, self.bad = path, size, 0, False
        self.depth, self.text, self.begin, self.seek = 0, b"", 0, 0  # begin: of the records not yet put; seek: of what is not read
        self.first, self.closed_at = 0, None
        self.spool, self.index = tempfile.SpooledTemporaryFile(max_size=16 << 20), []

    def put(self, end: int) -> None:
        """Keep the records up to ``end`` as an object."""
        value = b"{" + self.text[self.begin : end] + b"}"
        try:
            n = len(json.loads(value.decode("utf-8", "replace"), strict=False, object_pairs_hook=list))
        except (ValueError, RecursionError):
            self.bad = True
            return
        self.bad = not n and self.first > 0  # nothing behind a comma
        if n:
            self.index.append((self.first, len(value)))
            self.spool.write(value)
        self.first += n

    def take(self, block: bytes) -> None:
        before, self.got = self.got, self.got + len(block)
        if self.bad or self.closed_at is not None:
            return
        self.text, self.seek, self.begin = self.text[self.begin :] + block, self.seek - self.begin, 0
        after = before + len(block) - len(self.text)  # where in the file the text begins
        for m in _TOKEN.finditer(self.text, self.seek):
            t, self.seek = m.group(), m.start()
            if t == b'"':
                return  # a string that goes on in the next block
            if self.depth == 0 and (t != b"{" or self.text[: self.seek].strip()):
                self.bad = True
                return
            self.seek = m.end()
            if t in (b"{", b"["):
                self.depth += 1
                if self.depth == 1:
                    self.begin = self.seek
            elif t in (b"}", b"]"):
                self.depth -= 1
                if self.depth == 0:
                    self.closed_at = after + self.seek
                    self.put(m.start())
                    return
            elif t == b"," and self.depth == 1 and m.start() - self.begin > OBJECT:
                self.put(m.start())
                self.begin = self.seek
                if self.bad:
                    return

    def objects(self) -> Iterator[pa.RecordBatch]:
        """The last brace of a text that ends without one is none of the file's."""
        if not self.bad and self.closed_at is not None and self.closed_at <= self.size:
            self.spool.seek(0)
            for first, length in self.index:
                yield pa.RecordBatch.from_pydict({"path": [self.path], "first": [first], "value": [self.spool.read(length).decode("utf-8", "replace")]}, _OBJECTS)
        self.spool.close()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for b in batches:
        for k in range(len(b)):
            path, size, value = (b.column(c)[k].as_py() for c in ("path", "size", "value"))
            if cutter is None or cutter.path != path:
                if cutter:
                    yield from cutter.objects()
                cutter = _Cutter(path, size)
            cutter.take(value)
    if cutter:
        yield from cutter.objects()


def objects(spark: SparkSession, paths: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(path, first, value): files that are one JSON object of keyed records, each as objects of half a million characters
    or so, and the place of their first record, for ``records``. A malformed file gives no rows.

    No task holds more of a file than a block, an object and a record, however large the file and however its JSON is laid out: it is
    read in pieces that end with a brace, in parallel, and cut in one pass by one task.
    """
    there = _existing(spark, [paths] if isinstance(paths, str) else paths)
    if not there:
        return spark.createDataFrame([], "path string, first bigint, value string")
    meta = F.col("_metadata")
    pieces = _reader(spark, pattern).option("lineSep", "}").text(there)
    pieces = pieces.select(_path().alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("value"))
    blocks = pieces.mapInArrow(_glued, "path string, size bigint, start bigint, n bigint, value binary")
    blocks = blocks.repartition("path").sortWithinPartitions("path", "start", "n")
    return blocks.mapInArrow(_cut, "path string, first bigint, value string")


def records(docs: DataFrame, value: str) -> DataFrame:
    """(path, pos, key, value fields) of files that are one JSON object of keyed records; a malformed file gives no rows.
    docs: of ``documents``, or of ``objects`` where files may be large."""
    first = F.col("first") if "first" in docs.columns else F.lit(0)
    m = docs.select("path", first.alias("first"), F.from_json("value", f"map<string,{value}>", {"mode": "PERMISSIVE"}).alias("m"))
    return m.select("path", "first", F.posexplode("m").alias("pos", "key", "v")).select("path", (F.col("first") + F.col("pos")).cast("int").alias("pos"), "key", "v.*")


def record_lists(docs: DataFrame, value: str) -> DataFrame:
    """(path, pos, key, value fields) of files that are a JSON array of keyed records."""
    m = docs.select("path", F.posexplode(F.from_json("value", f"array<map<string,{value}>>")).alias("pos", "m"))
    return m.select("path", "pos", F.explode("m").alias("key", "v")).select("path", "pos", "key", "v.*")


def arrays(docs: DataFrame, value: str) -> DataFrame:
    """(path, pos, value fields) of files that are a JSON array of records."""
    return docs.select("path", F.posexplode(F.from_json("value", f"array<{value}>")).alias("pos", "v")).select("path", "pos", "v.*")


def malformed(docs: DataFrame, value: str) -> DataFrame:
    """Paths of files that hold no JSON object of such records."""
    return docs.filter(F.from_json("value", f"map<string,{value}>").isNull() | (F.size(F.map_keys(F.from_json("value", f"map<string,{value}>"))) <= 0)).select("path")


def score_lines(spark: SparkSession, path: str) -> DataFrame:
    """(truth, prediction) of comma-separated lines; a line without a prediction fails the query."""
    f = F.split("value", ",")
    x = spark.read.text(path).filter("value <> ''").select(f[0].alias("truth"), F.get(f, F.lit(1)).alias("prediction"))
    return x.select("truth", F.when(F.length("prediction") > 0, F.col("prediction")).otherwise(F.raise_error(F.concat(F.lit("no prediction for "), "truth"))).alias("prediction"))


def template(spark: SparkSession, path: str) -> str:
    """A prompt file's text; fails if there is none."""
    return spark.read.text(path, wholetext=True).first()[0]
