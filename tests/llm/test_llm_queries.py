"""The opN queries against SQL, or against plain versions where SQL cannot express them."""

import base64
import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from comparing import assert_same
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, cotraining, packing
from marlstone.llm.oracles import SQL
from marlstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], SF)


def test_bpe_as_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in QUERIES["op3_bpe_roundtrip"](spark, SF).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))


def test_packing_is_lossless(spark):
    vocabulary = packing.BpeIds(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = {i: b for b, i in bpe.read_ranks(vocabulary.data).items()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts, fill = {}, []
    for r in QUERIES["op2_packed_rows"](spark, SF).collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert r["id_bytes"] == 2 and len(ids) == packing.CONTEXT and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == vocabulary.size + 1).all()
        assert list(np.flatnonzero(packing.positions(r) == 0)) == r["resets"]
        fill.append(r["n_tokens"] / packing.CONTEXT)
        for d, at, a, b in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(d, []).append((at, ids[a:b]))
    assert set(parts) == set(texts)
    sha = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in QUERIES["op3_bpe_roundtrip"](spark, SF).collect()}
    for d, ps in parts.items():
        ids = np.concatenate([p for _, p in sorted(ps, key=lambda p: p[0])])
        assert ids[-1] == vocabulary.size and b"".join(map(ranks.__getitem__, ids[:-1].tolist())).decode() == texts[d]
        assert sha[d] == (len(ids) - 1, hashlib.sha256(",".join(map(str, ids[:-1].tolist())).encode()).hexdigest())
    assert len(fill) < 8 or sorted(fill)[len(fill) // 2] > 0.95


def brute_nearest(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        out[int(ids[q])] = ids[np.lexsort((ids, -s))[:20]].tolist()
    return out


def test_nearest_recall(spark):
    want, got = brute_nearest(spark, SF), {}
    for r in QUERIES["op6_nearest_vectors"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_chat_roles(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ",").alias("truth"))
    x = QUERIES["op7_chat_format"](spark, sf).join(truth, "conv_id")
    assert x.count() == truth.count()
    assert x.filter("roles = truth").count() >= 0.95 * truth.count()


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter("doc_id % 3 = 0")
    x = cotraining.score(docs, labels.filter("doc_id % 3 <> 0")).join(held, "doc_id")
    n = x.count()
    assert x.filter("kept = (quality = 1)").count() >= 0.93 * n
    assert x.filter("quality = 1 and kept").count() >= 0.97 * x.filter("quality = 1").count()


def plain_cotraining(text, meta, y, x_text, x_meta):
    """The same fit, written out: weighted logistic regression over all rows at once."""

    def z(x, m):
        return np.hstack([np.clip((x - m[0]) / m[1], -8, 8), np.ones((len(x), 1))])

    def newton(zs, ys, ws, w, steps):
        ridge = np.append(np.ones(zs.shape[1] - 1), 1e-6)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(zs @ w, -30, 30)))
            by = np.linalg.solve(zs.T @ (zs * (ws * p * (1 - p))[:, None]) + np.diag(ridge), zs.T @ (ws * (p - ys)) + ridge * w)
            w = w - by * min(1.0, 2 / max(np.abs(by).max(), 1e-300))
        return w

    part = np.arange(len(y)) % 5
    goal, views = y[part < 3].astype(float), []
    for own, rest in ((text, x_text), (meta, x_meta)):
        scale = (own[part < 3].mean(axis=0), np.maximum(own[part < 3].std(axis=0), 1e-9))
        a = z(own[part < 3], scale)
        views.append([a, z(rest, scale), newton(a, goal, np.ones(len(a)), np.zeros(a.shape[1]), 30), scale, own])

    def calibrated(w, scale, own, rows, of):
        """Log odds of rows ``of`` (standardised), calibrated on the labelled ``rows``."""
        o = np.clip(z(own[rows], scale) @ w, -30, 30)[:, None]
        m = (o.mean(axis=0), np.maximum(o.std(axis=0), 1e-9))
        return z(np.clip(of @ w, -30, 30)[:, None], m) @ newton(z(o, m), y[rows].astype(float), np.ones(len(o)), np.zeros(2), 30)

    for _ in range(cotraining.ROUNDS):
        odds = [calibrated(w, scale, own, part == 3, b) for _, b, w, scale, own in views]
        for k in (0, 1):
            o, sure = odds[1 - k], np.log(cotraining.SURE / (1 - cotraining.SURE))
            pick = np.abs(o) >= sure
            label = (o[pick] > 0).astype(float)
            weight = np.array([min(1.0, (goal == c).sum() / max((label == c).sum(), 1)) for c in label])
            a, b, w = views[k][:3]
            views[k][2] = newton(np.vstack([a, b[pick]]), np.concatenate([goal, label]), np.concatenate([np.ones(len(a)), weight]), w * 0, 30)
    return [calibrated(w, scale, own, part == 4, b) for _, b, w, scale, own in views]


def test_classifier_as_a_plain_fit(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = cotraining.labelled_features(docs, labels)
    got = cotraining.hash_sample(rows.filter("y is not null"), cotraining.LABELLED, ["doc_id"], ["doc_id", "t", "m"]).collect()
    rest = rows.filter("y is null").collect()
    m = lambda rs, c: np.array([r[c] for r in rs], float)
    text, meta = plain_cotraining(m(got, "t"), m(got, "m"), m(got, "y"), m(rest, "t"), m(rest, "m"))
    scores = {r["doc_id"]: r for r in cotraining.score(docs, labels).collect()}
    sigmoid = lambda o: 1 / (1 + np.exp(-o))
    for r, a, b in zip(rest, sigmoid(text), sigmoid(meta), strict=True):
        assert abs(scores[r["doc_id"]]["p_text"] - a) < 2e-3 and abs(scores[r["doc_id"]]["p_meta"] - b) < 2e-3


def test_views_teach_each_other(spark):
    """Labels cover one source of each quality; of the other sources the metadata view learns from the text view alone."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(4000):
        good = int(rng.random() < 0.5)
        source = f"{'good' if good else 'bad'}{int(rng.integers(5))}"
        words = [str(rng.choice(["alpha", "beta", "gamma", "delta"])) if good or rng.random() < 0.5 else "#$%&" for _ in range(60)]
        rows.append((i, " ".join(words), "en", source, None))
        if source[-1] == "0":
            labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    few = spark.createDataFrame(labels, "doc_id long, quality int")
    right = {}
    for rounds in (0, cotraining.ROUNDS):
        x = cotraining.score(docs, few, rounds=rounds).join(docs, "doc_id").filter("not source like '%0'")
        right[rounds] = [x.filter(f"({c} >= 0.5) = (source like 'good%')").count() / x.count() for c in ("p_text", "p_meta", "score")]
    assert right[0][1] < 0.7 and right[cotraining.ROUNDS][1] > 0.95 and right[cotraining.ROUNDS][2] >= right[0][2]


STYLES = {"angle": "{}> {}", "tag": "<|{}|> {}", "bold": "**{}:** {}", "hash": "## {}: {}"}


def test_chat_on_held_out_transcripts(spark):
    """Fitted on some conversations, tried on others, written with names and marks that no training transcript has."""
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.fit(chat.transcripts(c.filter("conv_id % 2 = 0")))
    rows, truth = [], {}
    for i, turns in [(r["conv_id"], r["turns"]) for r in chat.transcripts(c.filter("conv_id % 2 = 1")).collect()]:
        roles = [t["role"] if t["role"] in chat.ROLES else "other" for t in turns]
        names = {"user": "customer", "assistant": "bot", "system": "instruction"}
        style = list(STYLES.values())[i % len(STYLES)]
        rows.append((i, "\n\n".join(style.format(names.get(r, r), (t["text"] or "").strip() or "-") for r, t in zip(roles, turns, strict=True))))
        truth[i] = ",".join(roles)
    got = {r["conv_id"]: r["roles"] for r in chat.format_transcripts(spark.createDataFrame(rows, "conv_id long, text string"), model).collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.95 * len(truth)
    own = {r["conv_id"]: r["roles"] for r in chat.format_transcripts(chat.transcripts(c.filter("conv_id % 2 = 1")), model).collect()}
    assert sum(own[i] == t for i, t in truth.items()) >= 0.95 * len(truth)
