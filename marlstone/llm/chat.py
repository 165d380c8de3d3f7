"""Transcript parsing: a hidden Markov model over lines recovers roles, and turns are rendered canonically.

A state is a role and whether the line begins or continues a turn. A line is seen as the role that its speaker marker
names (or none, or an unknown one), whether a blank line stands before it, whether it ends in a question mark, and a
class of its length. Transition and emission probabilities are counted, with add-one smoothing, on a bounded sample of
labelled conversations (``SAMPLE``, by hash of id and text), where they lie: only counts come to the driver. Every
transcript is decoded by Viterbi over all its lines.

* null or empty transcript: no turns, empty rendering; very long transcript: linear in its lines;
* ties: the state listed first; repeated transcripts: each is parsed;
* turns of a conversation: in order of ``turn``, null last, then by role and text; equal rows of it count once, other rows
  of the same turn are turns of their own; null text: a dash; unknown roles count as ``other``;
* null conv_id: it ties nothing together, so each such row is a conversation of one turn, with a null id;
* empty table: empty result; extra columns: only the named ones are read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import bound_batches, slices
from marlstone.plans.rows import col
from marlstone.plans.sampling import hash_filter

ROLES = ("system", "user", "assistant", "other")
STATES = [(r, begins) for r in range(len(ROLES)) for begins in (True, False)]
SAMPLE = 2000
#: Speaker names of transcripts, by role.
SPEAKERS = {"system": ("system", "instruction"), "user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "agent", "a")}
_NAMES = {n: ROLES.index(r) for r, names in SPEAKERS.items() for n in names}
MARKER = re.compile(r"^\s{0,3}(?:#{1,4}\s*|\*\*|\[|<\|?)?([A-Za-z]{1,12})(?:\*\*|\]|\|?>)?\s*(?::\*\*|:|>|(?<=\])|(?<=\|>))[ \t]?")
NONE, UNKNOWN = len(ROLES), len(ROLES) + 1
SHAPES = (len(ROLES) + 2, 2, 2, 4)


def look(line: str, blank: bool) -> tuple[tuple[int, int, int, int], str]:
    """What is seen of a line, and its text without a known marker."""
    m = MARKER.match(line)
    role = NONE
    if m:
        role = _NAMES.get(m[1].lower(), UNKNOWN)
        if role != UNKNOWN:
            line = line[m.end() :]
    length = len(line)
    return (role, int(blank), int(line.rstrip().endswith("?")), 0 if length < 40 else 1 if length < 120 else 2 if length < 400 else 3), line


def lines_of(text: str) -> list[tuple[str, bool]]:
    """Lines that are not blank, and whether a blank one stands before each."""
    out, blank = [], True
    for line in text.split("\n"):
        if line.strip():
            out.append((line, blank))
            blank = False
        else:
            blank = True
    return out


SIZES = [len(STATES), len(STATES) ** 2, *(len(STATES) * k for k in SHAPES)]


def counted(labelled: list[tuple[tuple[int, int, int, int], int]], into: np.ndarray) -> None:
    """Add a transcript's (features, state) rows to counts of starts, steps and each feature's values, laid end to end."""
    n, last = len(STATES), None
    for features, s in labelled:
        into[s if last is None else n + last * n + s] += 1
        at = n + n * n
        for k, f in zip(SHAPES, features, strict=True):
            into[at + s * k + f] += 1
            at += n * k
        last = s


class Model:
    """Log probabilities: start (S), step (S, S), and seen (feature -> S x values)."""

    def __init__(self, start, step, seen):
        self.start, self.step, self.seen = start, step, seen

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        n = len(STATES)
        start, step, *seen = np.split(counts + 1.0, np.cumsum(SIZES)[:-1])
        step, seen = step.reshape(n, n), [t.reshape(n, k) for t, k in zip(seen, SHAPES, strict=True)]
        # A turn is begun by some line: its role cannot change on a line that continues.
        for a, (ra, _) in enumerate(STATES):
            for b, (rb, begins) in enumerate(STATES):
                if not begins and ra != rb:
                    step[a, b] = 1e-12
        start[[i for i, (_, begins) in enumerate(STATES) if not begins]] = 1e-12
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return cls(norm(start), norm(step), [norm(t) for t in seen])

    def decode(self, features: list[tuple[int, int, int, int]]) -> list[int]:
        """The likeliest states (Viterbi)."""
        if not features:
            return []
        f = np.array(features)
        e = sum(t[:, f[:, k]].T for k, t in enumerate(self.seen))
        score, back = self.start + e[0], np.empty((len(f), len(STATES)), np.int8)
        for i in range(1, len(f)):
            x = score[:, None] + self.step
            back[i] = x.argmax(axis=0)
            score = x.max(axis=0) + e[i]
        out = [int(score.argmax())]
        for i in range(len(f) - 1, 0, -1):
            out.append(int(back[i][out[-1]]))
        return out[::-1]


def parse(model: Model, text: str | None) -> list[tuple[str, str]]:
    """(role, text) of the transcript's turns."""
    seen = [look(line, blank) for line, blank in lines_of(text or "")]
    turns: list[tuple[str, list[str]]] = []
    for (_, line), s in zip(seen, model.decode([x[0] for x in seen]), strict=True):
        role, begins = STATES[s]
        if begins or not turns:
            turns.append((ROLES[role], []))
        turns[-1][1].append(line)
    return [(r, "\n".join(t)) for r, t in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: a role line, then the text, for each turn."""
    return "\n".join(f"<|{r}|>\n{t}" for r, t in turns)


def _written(h: int, turn: int, role: str, text: str) -> str:
    """A turn as a transcript may have it: one of several marker styles by conversation, and no marker on some turns."""
    if (h >> 8) % 4 == turn % 4 and turn:
        return text
    names = SPEAKERS.get(role, (role,))
    name = names[h % min(2, len(names))]
    return [f"{name.capitalize()}: {text}", f"[{name}] {text}", f"### {name.capitalize()}: {text}", f"**{name.capitalize()}:** {text}"][(h >> 4) % 4]


def _turns(value) -> list[tuple[str, str]]:
    return [(t["role"] if t["role"] in ROLES else "other", (t["text"] or "").strip() or "-") for t in value]


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, text): each conversation's turns in order, and the transcript they are written as."""
    bound_batches(conversations.sparkSession)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text").alias("t"))
    g = c.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    g = g.unionByName(c.filter("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    g = g.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches):
        for b in slices(batches):
            ids, turns = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = ["\n\n".join(_written(zlib.crc32(str(i).encode()), k, r, t) for k, (r, t) in enumerate(_turns(v))) for i, v in zip(ids, turns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["conv_id", "turns", "text"])

    return g.mapInArrow(run, "conv_id bigint, turns array<struct<role:string,text:string>>, text string")


def _labels(turns: list[tuple[str, str]], text: str) -> list[tuple[tuple[int, int, int, int], int]] | None:
    """States of the transcript's lines, from the turns it was written from."""
    seen, states = lines_of(text), []
    for role, t in turns:
        for k in range(len([x for x in t.split("\n") if x.strip()])):
            states.append(STATES.index((ROLES.index(role), k == 0)))
    if len(states) != len(seen):
        return None
    return [(look(line, blank)[0], s) for (line, blank), s in zip(seen, states, strict=True)]


def fit(written: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of about ``sample`` labelled transcripts (conv_id, turns, text), a written table of ``transcripts``."""

    def run(batches):
        counts = np.zeros(sum(SIZES), np.int64)
        for b in slices(batches):
            for turns, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counted(_labels(_turns(turns), text) or [], counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    some = hash_filter(written, sample, ["conv_id", "text"]).select("turns", "text")
    counts = np.zeros(sum(SIZES))
    for r in some.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return Model.of_counts(counts)


def format_transcripts(rows: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """id, n_turns, roles (comma-joined), text (canonical) and its sha256, of each transcript."""
    bound_batches(rows.sparkSession)
    src = rows.select(col(id_col).cast("long").alias("conv_id"), col(text_col).alias("text"))
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            parsed = [parse(known.value, t) for t in b.column(1).to_pylist()]
            texts = [render(p) for p in parsed]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(p) for p in parsed], pa.int32()), pa.array([",".join(r for r, _ in p) for p in parsed], pa.string()), pa.array(texts, pa.string()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())],
                names=["conv_id", "n_turns", "roles", "text", "text_sha256"],
            )

    return src.mapInArrow(run, "conv_id bigint, n_turns int, roles string, text string, text_sha256 string")
