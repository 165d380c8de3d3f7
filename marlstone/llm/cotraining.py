"""Quality classifier by co-training of a text-content view and a page-metadata view.

Both views are logistic regressions over their own features. They start from a bounded sample of labelled rows
(``LABELLED``, by hash of the id). Round by round, each view labels every unlabelled document of the corpus that it is
sure of (``SURE``) for the other one, which is fitted anew on the labelled rows and these. Pseudo-labels of a class weigh
as much as its labelled rows at most, however many there are, so the fit does not depend on the corpus's size. The
documents stay where they are: a Newton step sums gradients and curvatures over all of them, a few thousand numbers.

How sure a view is, is read off a fifth of the labelled rows that neither view is fitted on, anew in each round. Another
fifth is held back from all of this; on it each view's final scores are calibrated, and the calibrated log odds are
added, less the prior's. Labelled rows are never pseudo-labelled. All documents are scored.

* null text: as empty; null metadata: a value of its own; very long text: read once, linear;
* ties: equal rows get equal scores; repeated rows: each is scored; null id: scored, never labelled;
* repeated labels of an id count once, contradictory ones not at all; labels other than 0 and 1 are none;
* no usable labels (none, or of one class only): every score is the prior, and every document is kept;
* empty table: empty result; extra columns: only the named ones are read, so clashing names do not matter.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import bound_batches, slices
from marlstone.plans.sampling import hash_sample
from marlstone.plans.storage import Cut

LABELLED = 10_000
ROUNDS = 4
STEPS = 8  #: Newton steps of a round, from 0
STRIDE = 2.0  #: most that a Newton step changes a weight; beyond, steps on nearly separable rows overshoot
SETTLED = 1e-4  #: change of weights below which steps, and rounds, end
SURE = 0.97
RIDGE = 1.0
KEEP = 0.4  #: least score of a document that is kept
N_TEXT, N_LANG, N_SOURCE = 11, 8, 32
N_META = 2 + N_LANG + N_SOURCE
_NOT_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))
_NOT_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_NOT_LETTER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))


def text_features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * (N_TEXT - 1) + [1.0]
    letters = len(b.translate(None, _NOT_LETTER))
    lines = [x for x in b.split(b"\n") if x.strip()]
    again = sum(map(operator.eq, words, words[1:]))
    return [
        math.log1p(n), min(len(b) / n, 60.0), len(b.translate(None, _NOT_UPPER)) / max(letters, 1), b.count(b"!") / n,
        len(b.translate(None, _NOT_SYMBOL)) / n, len(b.translate(None, _NOT_DIGIT)) / len(b), len(set(words)) / n,
        (1 - len(set(words)) / n) * math.log1p(n), again / n, 1 - len(set(lines)) / len(lines), 0.0,
    ]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * N_META
    out[0], out[1] = math.log1p(max(n_chars or 0, 0)), float(n_chars is None)
    out[2 + zlib.crc32(str(lang).encode()) % N_LANG] = 1.0
    out[2 + N_LANG + zlib.crc32(str(source).encode()) % N_SOURCE] = 1.0
    return out


class Logistic:
    """Ridge-penalised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        self.w = np.zeros(x.shape[1] + 1)
        self.penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
        z = self.z(x)
        for _ in range(30):
            if np.abs(self.step(*slopes(z, y, self.w))).max() < 1e-8:
                break

    def z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(x), 1))])

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        """Newton step by the sums of ``slopes`` over the rows fitted on."""
        by = np.linalg.solve(curvature + np.diag(self.penalty), gradient + self.penalty * self.w)
        by = by * min(1.0, STRIDE / max(np.abs(by).max(), 1e-300))
        self.w = self.w - by
        return by

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.z(x) @ self.w, -30, 30)


def slopes(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z


class Teacher:
    """A view as it was at the start of a round, and how sure it is."""

    def __init__(self, model: Logistic, x: np.ndarray, y: np.ndarray):
        self.w, self.sureness = model.w, Logistic(model.odds(x)[:, None], y)

    def odds(self, z: np.ndarray) -> np.ndarray:
        return self.sureness.odds(np.clip(z @ self.w, -30, 30)[:, None])


def pseudo_slopes(views: list[Logistic], teachers: list[Teacher], x: list[np.ndarray]) -> list[np.ndarray]:
    """For each view and class: number, gradient and curvature of the rows that the other view is sure to be of it."""
    z = [m.z(a) for m, a in zip(views, x, strict=True)]
    sure, out = math.log(SURE / (1 - SURE)), []
    for k in (0, 1):
        odds = teachers[1 - k].odds(z[1 - k])
        for label, pick in ((0.0, odds <= -sure), (1.0, odds >= sure)):
            g, h = slopes(z[k][pick], np.full(int(pick.sum()), label), views[k].w)
            out.append(np.concatenate([[pick.sum()], g, h.ravel()]))
    return out


class CoTrained:
    """Both views, their calibrations, and the prior's log odds; without usable labels, the prior alone.

    ``corpus``: sums ``pseudo_slopes`` over all unlabelled rows, for views and teachers. None: no co-training.
    """

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, corpus: Callable[[list[Logistic], list[Teacher]], list[np.ndarray]] | None = None, rounds: int = ROUNDS):
        self.views: list[tuple[Logistic, Logistic]] | None = None
        share = float(y.mean()) if len(y) else 0.5
        self.prior = math.log((share + 1e-3) / (1 - share + 1e-3))
        part = np.arange(len(y)) % 5
        held, choose, rest = part == 4, part == 3, part < 3
        if min(min((y[p] == c).sum() for p in (held, choose, rest)) for c in (0, 1)) < 1:
            return
        views, goal = (text, meta), y[rest].astype(float)
        models = [Logistic(x[rest], goal) for x in views]
        own = [m.z(x[rest]) for m, x in zip(models, views, strict=True)]
        for _ in range(rounds if corpus else 0):
            teachers = [Teacher(m, x[choose], y[choose].astype(float)) for m, x in zip(models, views, strict=True)]
            for m in models:
                m.w = np.zeros_like(m.w)
            for _ in range(STEPS):
                sums, moved = corpus(models, teachers), 0.0
                for k, m in enumerate(models):
                    g, h = slopes(own[k], goal, m.w)
                    for c in (0, 1):
                        n, d = sums[2 * k + c][0], len(m.w)
                        weight = min(1.0, (goal == c).sum() / n) if n else 0.0
                        g = g + weight * sums[2 * k + c][1 : d + 1]
                        h = h + weight * sums[2 * k + c][d + 1 :].reshape(d, d)
                    moved = max(moved, np.abs(m.step(g, h)).max())
                if moved < SETTLED:
                    break
            if max(np.abs(m.w - t.w).max() for m, t in zip(models, teachers, strict=True)) < SETTLED:
                break
        self.views = [(m, Logistic(m.odds(x[held])[:, None], y[held].astype(float))) for m, x in zip(models, views, strict=True)]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        if self.views is None:
            p = np.full(len(text), 1 / (1 + math.exp(-self.prior)))
            return p, p, p
        odds = [c.odds(m.odds(x)[:, None]) for (m, c), x in zip(self.views, (text, meta), strict=True)]
        sigmoid = lambda o: 1 / (1 + np.exp(-np.clip(o, -30, 30)))
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds[0] + odds[1] - self.prior)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m): both views' features of every document."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches):
        for b in slices(batches):
            texts, langs, sources, chars = (c.to_pylist() for c in b.columns[1:])
            t = [text_features(x) for x in texts]
            m = [meta_features(*x) for x in zip(langs, sources, chars, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.float32()))], names=["doc_id", "t", "m"])

    return src.mapInArrow(run, "doc_id bigint, t array<float>, m array<float>")


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): one 0 or 1 for each id whose labels agree."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    return own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, t, m, y): features and label (null: none) of every document."""
    return features(docs).join(usable_labels(labels), "doc_id", "left")


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for name, n in (("t", N_TEXT), ("m", N_META))]


def corpus_sums(rows: DataFrame) -> Callable[[list[Logistic], list[Teacher]], list[np.ndarray]]:
    """Sums of ``pseudo_slopes`` over all rows of (t, m): one small array of each task, added by position."""
    context = rows.sparkSession.sparkContext
    lengths = [d * d + d + 1 for d in (N_TEXT + 1, N_META + 1) for _ in (0, 1)]

    def sums(views, teachers):
        known = context.broadcast((views, teachers))

        def run(batches):
            total = np.zeros(sum(lengths))
            for b in batches:
                if len(b):
                    total += np.concatenate(pseudo_slopes(*known.value, _views(b)))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "v"])

        out = np.zeros(sum(lengths))
        for r in rows.select("t", "m").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        known.destroy()
        return np.split(out, np.cumsum(lengths)[:-1])

    return sums


def fit(rows: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on at most ``labelled`` labelled rows and all others of ``rows``, a written table of ``labelled_features``."""
    got = hash_sample(rows.filter("y is not null"), labelled, ["doc_id"], ["doc_id", "t", "m"]).collect()
    matrix = lambda c, n: np.array([r[c] for r in got], np.float64).reshape(len(got), n)
    return CoTrained(matrix("t", N_TEXT), matrix("m", N_META), np.array([r["y"] for r in got], int), corpus_sums(rows.filter("y is null")), rounds)


def kept_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``keep``, all columns; texts are scored in place, so nothing is joined."""
    rows = Cut(labelled_features(docs, labels), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.df, **options))
    rows.drop()
    names = docs.columns
    at = [names.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches):
        for b in slices(batches):
            if model.value.views is None or not len(b):
                yield b
                continue
            texts, langs, sources, chars = (b.column(i).to_pylist() for i in at)
            t = np.array([text_features(x) for x in texts], np.float32).astype(np.float64)
            m = np.array([meta_features(*x) for x in zip(langs, sources, chars, strict=True)], np.float32).astype(np.float64)
            yield b.filter(pa.array(model.value.scores(t, m)[2] >= keep))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # any name may need quoting
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept of each document."""
    rows = Cut(labelled_features(docs, labels), "features").df
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, **options))

    def run(batches):
        for b in batches:
            a, c, both = model.value.scores(*_views(b))
            kept = both >= keep if model.value.views is not None else np.ones(len(both), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a), pa.array(c), pa.array(both), pa.array(kept)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return rows.select("doc_id", "t", "m").mapInArrow(run, "doc_id bigint, p_text double, p_meta double, score double, kept boolean")
