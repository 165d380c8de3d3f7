"""Byte-level BPE encoding and decoding by merge replay.

``MergeReplay`` holds a block of distinct pre-tokens as one chain of symbols and an inverted index from mergeable
pair to the positions where it stands. Merges are applied over the whole block in rank order; each one touches only
its two neighbours, whose new pairs enter the index. Words never influence each other, so replaying the corpus block
by block gives the ids that one replay over all words would give, and no shuffle is needed. The other way, one replay
over the corpus's distinct words and a join of their ids back to each text, shuffles every occurrence of every word with
its place, 20 bytes or more for the 4 bytes of text that a word has on the check tables (27 million words in 0.1 GB),
and sorts them, to save encoding words that a task has met before, which its cache of ``KNOWN`` words saves already.

``encode`` adds to any table with a text column: ``ids`` and ``decoded`` digests or the ids themselves.

* null text: as empty text (no ids, digests of the empty string);
* very long text: pre-tokens are taken in runs of ``RUN`` and digests are fed run by run, so memory stays bounded;
  one very long pre-token is replayed in O(n log n);
* repeated rows and ties: each row is encoded alone; equal texts give equal ids;
* empty table: an empty result of the same schema;
* extra columns: only the named ones are read, so clashing names do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import bound_batches, slices
from marlstone.plans.rows import col

RUN = 200_000  #: pre-tokens of a text that are held at once
BLOCK = 4_000_000  #: characters of text whose new words are replayed together
KNOWN = 300_000  #: words whose ids a task remembers


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a tiktoken rank file's contents."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_file(path: str) -> bytes:
    """The rank file's bytes, read once on the driver; its size bounds what is broadcast."""
    with open(path, "rb") as f:
        return f.read()


class MergeReplay:
    """Ids of whole blocks of words under one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None and (c := ranks.get(token[k:])) is not None:
                    pairs[a << 32 | c] = r
        #: All mergeable pairs, as sorted keys with the rank of what they merge into.
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def replay(self, words: Iterable[bytes]) -> list[list[int]]:
        words = list(words)
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(w)) is not None else None if w else [] for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if todo:
            for i, ids in zip(todo, self._replay_block([words[i] for i in todo]), strict=True):
                out[i] = ids
        return out

    def _replay_block(self, words: list[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(n, -1, np.int64)  # of the pair that starts at each place; -1: none
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._ranks_of(symbol[inner], symbol[inner + 1])
        # The inverted index: places of each rank's pairs. Merges add to ``late``.
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        cuts = np.flatnonzero(np.append(True, np.diff(rank[places]) != 0)) if len(places) else places
        index = dict(zip(rank[places[cuts]].tolist(), np.split(places, cuts[1:]), strict=True)) if len(places) else {}
        late: dict[int, list[int]] = {}
        order = list(index)
        heapq.heapify(order)
        again: set[int] = set()
        while order:
            r = heapq.heappop(order)
            at = index.pop(r, None)
            if r in late:
                new = np.array(late.pop(r), np.int64)
                at = np.unique(new if at is None else np.concatenate([at, new]))
            at = at[rank[at] == r]
            if not len(at):
                continue
            to = after[at]
            if (to[:-1] == at[1:]).any():
                # Overlapping pairs: the leftmost of a run goes first.
                taken, last = [], -1
                for p, q in zip(at.tolist(), to.tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                at = np.array(taken, np.int64)
                to = after[at]
            symbol[at] = r
            symbol[to] = -1
            rank[to] = -1
            rank[at] = -1
            beyond = after[to]
            after[at] = beyond
            right = beyond >= 0
            before[beyond[right]] = at[right]
            prior = before[at]
            left = prior >= 0
            start = np.concatenate([prior[left], at[right]])
            if not len(start):
                continue
            new = self._ranks_of(symbol[start], symbol[after[start]])
            rank[start] = new
            good = new >= 0
            for p, x in zip(start[good].tolist(), new[good].tolist(), strict=True):
                if x <= r:
                    again.add(int(word[p]))  # merged out of order; such a word is done alone
                elif x in late:
                    late[x].append(p)
                else:
                    late[x] = [p]
                    if x not in index:
                        heapq.heappush(order, x)
        alive = np.flatnonzero(symbol >= 0)
        ids = symbol[alive].tolist()
        stops = np.cumsum(np.bincount(word[alive], minlength=len(words))).tolist()
        out = [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for w in again:
            out[w] = self._replay_word(words[w])
        return out

    def _replay_word(self, word: bytes) -> list[int]:
        """One word, pair by pair in order of rank and place, for tables where a merge can make a pair of lower rank."""
        symbol = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, p) for p in range(n - 1) if (r := self.pairs.get(symbol[p] << 32 | symbol[p + 1], -1)) >= 0]
        heapq.heapify(queue)
        while queue:
            r, p = heapq.heappop(queue)
            q = after[p]
            if symbol[p] < 0 or q < 0 or self.pairs.get(symbol[p] << 32 | symbol[q], -1) != r:
                continue
            symbol[p], symbol[q] = r, -1
            after[p] = after[q]
            if after[p] >= 0:
                before[after[p]] = p
            for x, y in ((before[p], p), (p, after[p])):
                if x >= 0 and y >= 0 and (new := self.pairs.get(symbol[x] << 32 | symbol[y], -1)) >= 0:
                    heapq.heappush(queue, (new, x))
        return [x for x in symbol if x >= 0]


class WordCache:
    """Rendered ids of words, filled block by block; ``render`` turns a word's ids into what callers join."""

    def __init__(self, replay: MergeReplay, render):
        self.replay, self.render, self.known = replay, render, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN and self.known:
            self.known.clear()
            new = list(words)
        ids = self.replay.replay(w.encode("utf-8", "surrogatepass") for w in new)
        self.known.update(zip(new, map(self.render, ids), strict=True))


def runs(pattern, text: str) -> Iterator[list[str]]:
    """The text's pre-tokens, in runs of bounded length."""
    if len(text) <= RUN:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while run := list(islice(found, RUN)):
        yield run


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about BLOCK characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(cache: WordCache, pattern, texts: list[str]) -> Iterator[Iterator[list]]:
    """For each text, its runs of rendered words."""
    for block in blocks(texts):
        short = [pattern.findall(t) if len(t) <= RUN else None for t in block]
        cache.learn(set(chain.from_iterable(x for x in short if x is not None)))
        for t, words in zip(block, short, strict=True):
            yield rendered(cache, pattern, t, words)


def rendered(cache: WordCache, pattern, text: str, words: list[str] | None) -> Iterator[list]:
    for run in [words] if words is not None else runs(pattern, text):
        try:
            yield list(map(cache.known.__getitem__, run))
        except KeyError:  # a later block's words may have emptied the cache
            cache.learn(set(run))
            yield list(map(cache.known.__getitem__, run))


def digests(text_runs: Iterator[list[str]], by_decimal: dict[str, bytes]) -> tuple[int, str, str]:
    """Number of ids, digest of the comma-joined ids, digest of the bytes they decode to."""
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for run in text_runs:
        if not run:
            continue
        joined = ",".join(run)
        ids.update((("," if n else "") + joined).encode())
        each = joined.split(",")
        decoded.update(b"".join(map(by_decimal.__getitem__, each)))
        n += len(each)
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row; decoding reads the ids, not the text."""
    spark = docs.sparkSession
    bound_batches(spark)
    file = spark.sparkContext.broadcast(load_file(ranks_path))
    src = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType

    def run(batches):
        replay = MergeReplay(read_ranks(file.value))
        cache = WordCache(replay, lambda ids: ",".join(map(str, ids)))
        by_decimal = {str(i): b for i, b in replay.vocab.items()}
        compiled = regex.compile(pattern)
        for batch in slices(batches):
            got = [digests(x, by_decimal) for x in encoded(cache, compiled, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return src.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids array<int>`` of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    file = spark.sparkContext.broadcast(load_file(ranks_path))
    src = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches):
        cache = WordCache(MergeReplay(read_ranks(file.value)), lambda ids: ids)
        compiled = regex.compile(pattern)
        for batch in slices(batches):
            got = [list(chain.from_iterable(chain.from_iterable(x))) for x in encoded(cache, compiled, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded_rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text that ``ids`` stand for (bytes that are no UTF-8 become U+FFFD); null ids: empty text."""
    spark = encoded_rows.sparkSession
    bound_batches(spark)
    file = spark.sparkContext.broadcast(load_file(ranks_path))
    src = encoded_rows.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids"))

    def run(batches):
        vocab = {i: b for b, i in read_ranks(file.value).items()}
        for batch in slices(batches):
            texts = [b"".join(map(vocab.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
