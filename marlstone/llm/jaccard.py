"""Exact Jaccard join of documents on word shingles, with signature trees.

1. Shingles. Each text becomes the set of 64-bit ids of its word shingles. A first pass finds shingles that stand in
   many documents of some task (at most ``HEAVY`` are kept; they only set an order, so no result depends on them).
2. Prefix filter. In the order (heavy last, then by id, which puts shingles of long words first) two sets with Jaccard >= t share one of the first
   n - ceil(t n) + 1 elements of each. Documents are dealt out by those elements; equal sets count once per task.
3. Groups. The members of an element's list are put into the group of the list's smallest class; every linking pair
   meets in such a group. Groups over ``GROUP`` members are cut into parts that meet pairwise, so no task holds more
   than two parts; members are dealt out by (group, part, part) straight from where they are read, never by group.
4. Signature trees. A group's members, ordered by size band and first shingle, are the leaves of a tree whose nodes
   hold OR-combined bitmaps, size ranges and the largest number of shingles that share bits. A dual traversal of the
   tree with itself skips node pairs whose sizes are too far apart or whose largest possible overlap is too small.
   Members that still may link form candidate sets; a set found in several groups is kept once. Only bitmaps move here.
5. Verification. The texts of a candidate set come together; the same traversal, now with exact intersections at the
   leaves, returns links that join components and skips what is joined already.
6. Components of these links. A node is a class of equal sets, known by 128 bits of hash, never by an id: rows that
   share an id, or have none, are nodes of their own sets.

* null, empty or word-less text: empty set, linked with nothing; fewer words than a shingle: the sequence is the one
  shingle; very long text: one sorted array of hashes, in the task that holds its row anyway;
* ties and repeated rows: equal sets form a class; rows that share a doc_id are told apart by their sets;
* null doc_id: the row links as any other, but lends no id: a component's id is its smallest doc_id that is not null,
  and null if it has none; a row that is linked with nothing has its own doc_id, null or not;
* empty table: empty result; extra columns: only id and text are read, so clashing names do not matter.

Ids hold 56 bits of a hash of the shingle's words; two different shingles of one comparison are taken for one with a
probability near 2^-56, two sets for one class with a probability near 2^-64 where groups are made and 2^-128 else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import bound_batches, slices
from marlstone.llm.components import components
from marlstone.plans.rows import col, packed, unpacked
from marlstone.plans.storage import Cut, cut

SHINGLE = 5
NUM, DEN = 3, 4  #: link when DEN * intersection >= NUM * union
HEAVY = 1 << 18
GROUP = 1024
CUT_GROUPS = 1 << 18  #: groups of several parts up to which the number of their parts is broadcast
LEAF = 16
POSTINGS = 1_000_000  #: rows of a task that groups element lists
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, as far as texts have needed them."""

    base = 0x9E3779B97F4A7C15
    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            n = max(n, 2 * len(cls.up), 1 << 16)
            cls.up, cls.down = (cls._row(m, n) for m in (cls.base, pow(cls.base, -1, 1 << 64)))

    @staticmethod
    def _row(m: int, n: int) -> np.ndarray:
        row = np.full(n, m, np.uint64)
        row[0] = 1
        return row.cumprod(dtype=np.uint64)


_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20  #: bytes of a text whose words are hashed at once


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of each word: a polynomial over random numbers of its bytes, from differences of running sums."""
    hashes, lengths, at = [], [], 0
    every = np.frombuffer(raw, np.uint8)
    while at < len(every):
        stop = at + CHUNK
        if stop < len(every):  # to the next space, so that no word is cut
            while stop < len(every) and not _SPACE[every[stop]]:
                stop += 1
        b = every[at:stop]
        at = stop
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8)))
        first, end = edges[::2], edges[1::2]
        Powers.reach(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * Powers.up[: len(b)], out=sums[1:])
        hashes.append((sums[end] - sums[first]) * Powers.down[first])
        lengths.append(end - first)
    if len(hashes) == 1:
        return hashes[0], lengths[0]
    return (np.concatenate(hashes), np.concatenate(lengths)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Ids of all shingles, repeats included: 8 bits that fall with the length of the shingle's words, then 56 of hash.

    Shingles of long words are seldom shared by chance, so they come first in the order of ids. bytes.lower knows
    ASCII only, as wanted.
    """
    with np.errstate(over="ignore"):
        w, lengths = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
        if not len(w):
            return w
        if len(w) < k:
            h, total = np.array([len(w)], np.uint64), np.array([lengths.sum()])
            for i in range(len(w)):
                h = _mix(h * _MULT[0] + w[i : i + 1])
        else:
            n = len(w) - k + 1
            h, total = w[:n] * _MULT[0], lengths[:n].copy()
            for i in range(1, k):
                h += w[i : i + n] * _MULT[i]
                total += lengths[i : i + n]
            h = _mix(h)
    return (255 - np.minimum(total, 255)).astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)


def shingle_set(text: str | None) -> np.ndarray:
    s = np.sort(raw_shingles(text))
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    return s[fresh]


def heavy_shingles(docs: DataFrame, keep: int = HEAVY, hold: int = 2_000_000) -> np.ndarray:
    """Shingles that stand in the most documents, as far as single tasks can tell: all above the least power of two
    that leaves at most ``keep``."""

    def count(batches):
        held, size, n_docs = [], 0, 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            top = n >= max(16, n_docs // 250)
            return pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top].astype(np.int64))], names=["h", "n"])

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                s = shingle_set(t)
                held.append(s)
                size += len(s)
                n_docs += 1
                if size >= hold:
                    yield flush()
                    held, size, n_docs = [], 0, 0
        if held:
            yield flush()

    found = Cut(docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.length(F.bin(F.sum("n"))).alias("bits")), "heavy")
    least, left = 64, keep
    for r in found.df.groupBy("bits").agg(F.count("*").alias("n")).orderBy(F.col("bits").desc()).collect():
        if (left := left - r["n"]) < 0:
            break
        least = r["bits"]
    heavy = found.df.filter(F.col("bits") >= least).select("h").toArrow().column(0).to_numpy().view(np.uint64)
    found.drop()
    return np.sort(heavy)


def _prefix(s: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix's elements that are not heavy and those that are."""
    n = len(s)
    length = n - -(-NUM * n // DEN) + 1
    if len(heavy):
        at = np.searchsorted(heavy, s)
        is_heavy = heavy[np.minimum(at, len(heavy) - 1)] == s
        if is_heavy.any():
            light = s[~is_heavy][:length]
            return light, s[is_heavy][: length - len(light)]
    return s[:length], s[:0]


def _class(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for the set, as signed integers."""
    with np.errstate(over="ignore"):
        both = np.array([_mix(s).sum(dtype=np.uint64), _mix(s ^ _MULT[1]).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of a set's shingles, by their lowest bits: two to four times as many bits as shingles."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.uint64)


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer words: its parts, combined by OR, as the lowest bits name the places."""
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0) if len(b) > words else b


def _array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sets_table(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """doc_id, fp, n, class (c1, c2), signature (lead, bits) and prefix (light, heavy) of each row of (doc_id, fp, text);
    no signature and prefix where the task has met the class before."""
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        seen = set()
        for batch in slices(batches):
            n, classes, light, heavies, lead, bits = [], [], [], [], [], []
            for t in batch.column(2).to_pylist():
                s = shingle_set(t)
                c = _class(s)
                n.append(len(s))
                classes.append(c)
                if new := len(s) and c not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                a, b = _prefix(s, known.value) if new else (s[:0], s[:0])
                light.append(a)
                heavies.append(b)
                lead.append(int(s[:1].view(np.int64)[0]) if new else None)
                bits.append(bitmap(s).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([c[0] for c in classes], pa.int64()), pa.array([c[1] for c in classes], pa.int64()), pa.array(lead, pa.int64()), pa.array(bits, pa.binary()), _array(light), _array(heavies)],
                names=["doc_id", "fp", "n", "c1", "c2", "lead", "bits", "light", "heavy"],
            )

    return docs.select("doc_id", "fp", "text").mapInArrow(run, "doc_id bigint, fp bigint, n bigint, c1 bigint, c2 bigint, lead bigint, bits binary, light array<bigint>, heavy array<bigint>")


def _lists(batches) -> Iterator[pa.RecordBatch]:
    """From (element, class) rows sorted by element: (group, class), each pair of a run of elements once. Runs of
    about POSTINGS rows are held at once, and an element's list at least: not heavy, it is short beside a task's rows."""

    def of(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        hub = np.repeat(c[at], np.diff(np.append(at, len(h))))
        # A list of one class gives nothing but its own hub; in a longer one the hub is a member like the others.
        joins = np.repeat(np.maximum.reduceat(c, at) > c[at], np.diff(np.append(at, len(h))))
        pairs = np.unique(np.stack([hub[joins], c[joins]]), axis=1) if joins.any() else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["hub", "c1"])

    keys, classes, size = [], [], 0
    for b in batches:
        keys.append(b.column(0).to_numpy())
        classes.append(b.column(1).to_numpy())
        size += len(b)
        if size >= POSTINGS and len(b) and keys[0][0] != keys[-1][-1]:
            h, c = np.concatenate(keys), np.concatenate(classes)
            whole = np.flatnonzero(h != h[-1])[-1] + 1  # the last element's list may go on
            yield of(h[:whole], c[:whole])
            keys, classes, size = [h[whole:]], [c[whole:]], len(h) - whole
    if size:
        yield of(np.concatenate(keys), np.concatenate(classes))


@dataclass
class Member:
    id: int | tuple[int, int]
    size: int
    lead: int
    bits: np.ndarray
    part: int = 0
    set: np.ndarray | None = None


class Tree:
    """Signature tree over members whose bitmaps are folded to ``words`` words."""

    def __init__(self, members: list[Member], words: int):
        self.members = sorted(members, key=lambda m: (m.lead, m.size, m.id))
        maps = np.stack([folded(m.bits, words) for m in self.members])
        size = np.array([m.size for m in self.members], np.int64)
        spare = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: Levels from the leaves up: bitmaps, smallest and largest size, most shingles that share a bit with others.
        self.levels = [(maps, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, sp = self.levels[-1]
            cuts = np.arange(0, len(m), LEAF)
            self.levels.append((np.bitwise_or.reduceat(m, cuts, axis=0), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(sp, cuts)))


def _possible(a, i, b, j) -> np.ndarray:
    """Which node pairs (i, j) of levels a and b may hold a linking pair, by sizes and largest possible overlap."""
    (ma, la, ha, sa), (mb, lb, hb, sb) = a, b
    fit = (DEN * ha[i] >= NUM * lb[j]) & (DEN * hb[j] >= NUM * la[i])
    k = np.flatnonzero(fit)
    if not len(k):
        return k
    overlap = np.bitwise_count(ma[i[k]] & mb[j[k]]).sum(axis=1, dtype=np.int64) + np.minimum(sa[i[k]], sb[j[k]])
    overlap = np.minimum(overlap, np.minimum(ha[i[k]], hb[j[k]]))
    # |A n B| >= NUM / (NUM + DEN) * (|A| + |B|) at least for the smallest sizes of both nodes.
    return k[(NUM + DEN) * overlap >= NUM * (la[i[k]] + lb[j[k]])]


class Joined:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _linked(a: Member, b: Member) -> bool:
    """Exactly, if both sets are there; else all that the signatures let pass."""
    if a.set is None or b.set is None:
        return True
    both = len(np.intersect1d(a.set, b.set, assume_unique=True))
    return DEN * both >= NUM * (a.size + b.size - both)


def links(x: Tree, y: Tree, joined: Joined) -> Iterator[tuple[int, int]]:
    """Links between x and y (or within x, if y is x) that join components not joined before."""
    same = x is y
    stack = [(max(len(x.levels), len(y.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        keep = _possible(_level(x, k), i, _level(y, k), j)
        for p, q in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if k:
                cx, cy = _children(x, k, p), _children(y, k, q)
                if k == 1 and len({joined.find(t.members[c].id) for t, cs in ((x, cx), (y, cy)) for c in cs.tolist()}) == 1:
                    continue
                ci, cj = np.repeat(cx, len(cy)), np.tile(cy, len(cx))
                if same:
                    up = ci <= cj
                    ci, cj = ci[up], cj[up]
                stack.append((k - 1, ci, cj))
                continue
            a, b = x.members[p], y.members[q]
            if (same and p >= q) or joined.find(a.id) == joined.find(b.id):
                continue
            if _linked(a, b):
                joined.join(a.id, b.id)
                yield a.id, b.id


def _level(t: Tree, k: int):
    return t.levels[min(k, len(t.levels) - 1)]


def _children(t: Tree, k: int, node: int) -> np.ndarray:
    if k > len(t.levels) - 1:
        return np.array([node])
    return np.arange(node * LEAF, min((node + 1) * LEAF, len(t.levels[k - 1][0])))


def group_links(members: list[Member], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Joining links within (i = j) or between a group's parts i and j. Sizes are joined band by band, so that bitmaps
    fit their sets."""
    joined, out = Joined(), []
    bands: dict[int, list[Member]] = {}
    for m in members:
        bands.setdefault(m.size.bit_length(), []).append(m)
    for b in sorted(bands):
        # Sizes of linking sets differ by a third at most, so they lie in the same band or in neighbours.
        rows = (bands[b], bands.get(b + 1, []))
        if len(rows[0]) + len(rows[1]) < 2:
            continue
        words = min(len(m.bits) for own in rows for m in own)
        trees: dict[tuple[int, int], Tree | None] = {}
        for which, own in enumerate(rows):
            for part in {i, j}:
                mine = [m for m in own if m.part == part]
                trees[which, part] = Tree(mine, words) if mine else None
        for p, q in [((0, i), (0, j)), ((0, i), (1, j))] + [((0, j), (1, i))] * (i != j):
            if trees[p] is not None and trees[q] is not None:
                out += links(trees[p], trees[q], joined)
    return out


def _runs(batches, width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with the same first ``width`` columns, which the rows are sorted by."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple[int, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.int64()) for k in range(len(names))], names=names)


def _candidates(batches) -> Iterator[pa.RecordBatch]:
    """From rows (hub, i, j, part, c1, n, lead, bits) sorted by (hub, i, j): candidate sets (group, c1)."""

    def found():
        for (_, i, j), rows in _runs(batches, 3):
            if len(rows) > 1:
                sets = Joined()
                for a, b in group_links([Member(c1, n, lead, np.frombuffer(bits, np.uint64), part) for part, c1, n, lead, bits in rows], i, j):
                    sets.join(a, b)
                of: dict[int, list[int]] = {}
                for _, c1, *_ in rows:
                    of.setdefault(sets.find(c1), []).append(c1)
                for members in of.values():
                    if len(members) > 1:
                        members.sort()
                        name = xxhash.xxh3_64_intdigest(np.array(members, np.int64).tobytes()) - (1 << 63)
                        yield from ((name, c) for c in members)

    yield from _batches(found(), ["g", "c1"])


def _verified(batches) -> Iterator[pa.RecordBatch]:
    """From rows (g, text) sorted by g: joining links between classes."""

    def found():
        for _, rows in _runs(batches, 1):
            members = []
            for (text,) in rows:
                s = shingle_set(text)
                members.append(Member(_class(s), len(s), int(s[:1].view(np.int64)[0]), bitmap(s), 0, s))
            for a, b in group_links(members):
                yield (*a, *b)

    yield from _batches(found(), ["a1", "a2", "b1", "b2"])


#: What tells rows apart: the id (or that it is null) and a fingerprint of the text.
KEY = ["no_id", "id0", "fp"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> dict:
    id_, text = col(id_col).cast("long"), col(text_col)
    return {"no_id": id_.isNull(), "id0": F.coalesce(id_, F.lit(0)), "fp": F.xxhash64(F.coalesce(text, F.lit("")))}


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp, n, c1, c2), and the classes (c1, c2, component_id, keeper): ``keeper`` is the KEY of the
    component's first row, by doc_id (nulls last) and fingerprint."""
    spark = docs.sparkSession
    bound_batches(spark)
    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), *[c.alias(k) for k, c in _keyed(docs, id_col, text_col).items()])
    heavy = heavy_shingles(d)
    table = Cut(sets_table(d, heavy), "sets")
    small = cut(table.df.select("doc_id", "fp", "n", "c1", "c2"), "set-ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id0"), "fp"))
    classes = cut(small.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), first.alias("keeper")), "classes")
    n_postings = table.df.agg(F.sum(F.size("light"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(least, -(-n_postings // POSTINGS))
    light = table.df.filter(F.size("light") > 0).select(F.explode("light").alias("h"), "c1")
    pairs = light.repartition(width, "h").sortWithinPartitions("h").mapInArrow(_lists, "hub bigint, c1 bigint")
    if len(heavy):
        # A heavy element's list may hold much of the corpus: its smallest class is aggregated, and at most HEAVY rows are broadcast.
        dense = table.df.filter(F.size("heavy") > 0).select(F.explode("heavy").alias("h"), "c1")
        hubs = dense.groupBy("h").agg(F.min("c1").alias("hub"), F.max("c1").alias("most")).filter("hub < most").drop("most")
        pairs = pairs.unionByName(dense.join(F.broadcast(hubs), "h").select("hub", "c1"))
    groups = Cut(pairs.distinct(), "groups")
    # Equal classes of different tasks have equal signatures.
    marks = table.df.filter("bits is not null").groupBy("c1").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("bits").alias("bits"))
    big = groups.df.groupBy("hub").agg(F.count("*").alias("members")).filter(F.col("members") > GROUP)
    big = Cut(big.select("hub", F.ceil(F.col("members") / GROUP).cast("int").alias("parts")), "parts")
    parts = F.broadcast(big.df) if big.df.count() <= CUT_GROUPS else big.df
    m = groups.df.join(parts, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int"))
    pair = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, part) as i, greatest(x, part) as j))")
    m = m.withColumn("ij", F.explode(pair)).select("hub", "ij.i", "ij.j", "part", "c1").join(marks, "c1").select("hub", "i", "j", "part", "c1", "n", "lead", "bits")
    m = m.repartition(width, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    sets = Cut(m.mapInArrow(_candidates, "g bigint, c1 bigint").distinct(), "candidates")
    for x in (groups, big, table):
        x.drop()
    # One text per member; rows that are alike in id and text are combined before they are dealt out.
    wanted = sets.df.join(classes.select("c1", "keeper.*"), "c1").select("g", *KEY)
    texts = d.filter(F.col("text").isNotNull()).groupBy(*KEY).agg(F.first("text").alias("text"))
    x = wanted.join(texts, KEY).select("g", "text").repartition(width, "g").sortWithinPartitions("g")
    links = x.mapInArrow(_verified, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    found = components(links.select(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")).alias("a"), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b")))
    sets.drop()
    linked = classes.join(found.select("node.*", "component"), ["c1", "c2"])
    whole = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.min("keeper").alias("first"))
    linked = linked.select("c1", "c2", "component").join(whole, "component").drop("component").withColumn("linked", F.lit(True))
    of = classes.join(linked, ["c1", "c2"], "left")
    own = lambda c, else_: F.when(F.col("linked"), F.col(c)).otherwise(F.col(else_))
    return small, of.select("c1", "c2", own("component_id", "least").alias("component_id"), own("first", "keeper").alias("keeper"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows, classes = _classes(docs, id_col, text_col)
    out = rows.join(classes.drop("keeper"), ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their components: that of the smallest doc_id (nulls last; equal ids by
    fingerprint), once. Rows without words are linked with nothing: all of them stay."""
    rows, classes = _classes(docs, id_col, text_col)
    stay = classes.select("keeper.*").distinct()
    d = docs.select(packed(docs), F.col(f"`{text_col}`").alias("text"), *[c.alias(k) for k, c in _keyed(docs, id_col, text_col).items()])
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = d.filter(worded).groupBy(*KEY).agg(F.first("row").alias("row")).join(stay, KEY, "left_semi")
    return unpacked(kept.select("row").unionByName(d.filter(~worded).select("row")), docs.columns)
