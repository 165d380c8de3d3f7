"""Token-ID output: best-fit-decreasing packing into rows of a fixed context.

A document's ids, closed by an end id, are cut losslessly into pieces of at most ``context``. Pieces are packed by
best fit in order of decreasing length: a segment tree over remaining capacities finds the fullest row that still
takes a piece. Packing is done over buffers of ``BUFFER`` ids within each task: a buffer leaves at most one row half
empty, so more would gain nothing, and no document crosses the network.

A packed row has its ids as a matrix row of ``context`` little-endian unsigned integers of ``id_bytes`` bytes (2 for
vocabularies of up to 65,536 ids, end and pad included, else 4), padded at the end, the cumulative segment lengths, and,
for each segment, the document, its offset there, and the place where positions restart at 0. An id that the vocabulary
does not have ends the job with an error.

* null or empty text: the end id alone; very long text: as many pieces as it needs; ties: by order of arrival;
* repeated rows: each is packed; null id: packed, with a null id in doc_ids; empty table: empty result;
* extra columns: only id and text are read, so clashing names do not matter.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bpe
from marlstone.llm.batches import bound_batches, slices
from marlstone.plans.rows import col

CONTEXT = 8192
BUFFER = 16_000_000

SCHEMA = "shard int, row int, n_tokens int, id_bytes int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, offsets array<bigint>"


class ByteIds:
    """UTF-8 bytes as ids."""

    size = 256  #: ids below ``size`` are the vocabulary's; the end id is ``size``, the pad id follows it

    def encoder(self) -> Callable[[str], np.ndarray]:
        """A function from a text to its ids, made in each task."""
        return lambda text: np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


class BpeIds:
    """Ids of a byte-level BPE vocabulary: those of ``bpe.encode_ids``, by the tiktoken library. Texts over ``bpe.RUN``
    characters take ``bpe``'s own replay, which holds them in runs, and gives the same ids."""

    def __init__(self, ranks_path: str, pattern: str):
        self.data, self.pattern = bpe.load_file(ranks_path), pattern
        self.size = 1 + max(bpe.read_ranks(self.data).values())

    def encoder(self) -> Callable[[str], np.ndarray]:
        ranks = bpe.read_ranks(self.data)
        library = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        compiled = regex.compile(self.pattern)
        own = functools.cache(lambda: bpe.WordCache(bpe.MergeReplay(ranks), lambda ids: ids))

        def encode(text: str) -> np.ndarray:
            if len(text) <= bpe.RUN:
                return np.array(library.encode_ordinary(text), np.int64)
            (found,) = bpe.encoded(own(), compiled, [text])
            return np.concatenate([np.fromiter(chain.from_iterable(run), np.int64) for run in found])

        return encode


class Capacities:
    """Rows by remaining capacity, in a segment tree: ``best(n)`` takes out a row of the least capacity >= n."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        at = self.base + need
        if not self.count[at]:
            # Up to the first right sibling that holds a row, then down its left side.
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.base
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: list[int], context: int) -> list[list[int]]:
    """Rows as lists of piece numbers; every piece is at most ``context`` long."""
    rows: list[list[int]] = []
    free = Capacities(context)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = free.best(lengths[i])
        if got is None:
            rows.append([i])
            row, left = len(rows) - 1, context - lengths[i]
        else:
            row, left = got[0], got[1] - lengths[i]
            rows[row].append(i)
        if left:
            free.put(row, left)
    return rows


def pack(docs: DataFrame, vocabulary=None, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows (SCHEMA) of all documents; ``vocabulary`` (default: ByteIds()) has ``size`` and ``encoder()``."""
    vocabulary = ByteIds() if vocabulary is None else vocabulary
    size = vocabulary.size
    width = 2 if size + 2 <= 1 << 16 else 4
    bound_batches(docs.sparkSession)
    src = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches):
        shard, done, encode = TaskContext.get().partitionId(), 0, vocabulary.encoder()
        pieces: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def ids_of(text: str) -> np.ndarray:
            ids = encode(text)
            if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < size:
                raise ValueError(f"an id beyond the {size} of the vocabulary")
            return np.append(ids, size).astype(f"<u{width}")

        def flush(done):
            rows = best_fit_decreasing([len(p[2]) for p in pieces], context)
            for a in range(0, len(rows), 256):
                out: dict[str, list] = {k: [] for k in ("shard", "row", "n_tokens", "id_bytes", "ids", "cu_seqlens", "resets", "doc_ids", "offsets")}
                for k, row in enumerate(rows[a : a + 256], start=done + a):
                    ids = np.full(context, size + 1, f"<u{width}")
                    ends = np.cumsum([0] + [len(pieces[i][2]) for i in row])
                    for i, b, e in zip(row, ends, ends[1:], strict=False):
                        ids[b:e] = pieces[i][2]
                    for name, value in (("shard", shard), ("row", k), ("n_tokens", int(ends[-1])), ("id_bytes", width), ("ids", ids.tobytes()), ("cu_seqlens", ends.tolist()), ("resets", ends[:-1].tolist()), ("doc_ids", [pieces[i][0] for i in row]), ("offsets", [pieces[i][1] for i in row])):
                        out[name].append(value)
                types = {"shard": pa.int32(), "row": pa.int32(), "n_tokens": pa.int32(), "id_bytes": pa.int32(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "resets": pa.list_(pa.int32()), "doc_ids": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], names=list(out))

        def count(rows):
            nonlocal done
            for b in rows:
                yield b
                done += len(b)

        for batch in slices(batches):
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text)
                for a in range(0, len(ids), context):
                    pieces.append((d, a, ids[a : a + context]))
                held += len(ids)
                if held >= BUFFER:
                    yield from count(flush(done))
                    pieces, held = [], 0
        if pieces:
            yield from count(flush(done))

    return src.mapInArrow(run, SCHEMA)


def positions(row) -> np.ndarray:
    """Position ids of a packed row's tokens: they restart at 0 with each segment."""
    return np.concatenate([np.arange(b - a) for a, b in zip(row["cu_seqlens"], row["cu_seqlens"][1:], strict=False)])


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a file per shard."""
    packed.write.mode("errorifexists").parquet(path)
