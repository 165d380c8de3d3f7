"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, chat, components, cotraining, jaccard, licenses, mixing, neighbours, packing, quality_rules, secrets

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
KEY = "AKIA" + "Q" * 16
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n\t ", "en", "b", 5), (4, LONG, "en", "a", len(LONG)), (5, "one two three", "de", "b", 13),
    (6, "one two three", "de", "b", 13), (6, "one two three", "de", "b", 13), (None, "no id here at all but some words", "en", "c", 30), (7, "Ünïcödé 😀 text\nline\nline", None, "c", None),
    (8, f"key {KEY} and password='hunter22' end", "en", "a", 40), (9, "Released under the MIT License.\n" + "good words stand here " * 10, "en", "a", 250),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("words", "size", "row", "bucket", "block", "h", "n", "c1", "target", "label", "start")
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")


def op(name, labels):
    return {
        "mix": lambda d: mixing.taken(d), "pack": lambda d: packing.pack(d), "bpe": lambda d: bpe.encode_digests(d, RANKS, public_tokenizers.PATTERN), "secrets": lambda d: secrets.digest(d),
        "licenses": lambda d: licenses.scan(d), "jaccard": lambda d: jaccard.jaccard_components(d), "quality": lambda d: quality_rules.ledger(d), "classifier": lambda d: cotraining.score(d, labels),
    }[name]


@pytest.mark.parametrize("name", ["mix", "bpe", "secrets", "licenses", "jaccard", "quality", "classifier"])
def test_one_row_each(docs, empty, labels, name):
    got = op(name, labels)(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert op(name, labels)(empty).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mix_shares(spark, docs):
    rows = mixing.taken(docs).collect()
    by: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), 0)
        by[r["source_size"], r["target"]] += r["taken"]
    for (size, target), taken in by.items():
        assert taken == math.floor(target) and target <= 3 * size
    # a holds nearly all words, so the others give three times theirs
    assert sorted(target / max(size, 1) for size, target in by)[-1] == 3.0
    assert sorted(map(repr, mixing.taken(docs.repartition(5)).collect())) == sorted(map(repr, rows))


def test_mix_hot_source_and_schedule(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    p = mixing.pieces(d, block=64).filter("slot is not null")
    got = {r["source"]: (r["n"], r["t"]) for r in p.groupBy("source").agg(F.sum("n_words").alias("n"), F.max("target").alias("t")).collect()}
    assert all(n == math.floor(t) for n, t in got.values()) and len(got) == 8
    # every prefix of the schedule is close to the target weights
    first = p.filter("slot < 200").groupBy("source").agg(F.countDistinct("slot").alias("n")).collect()
    total = sum(t for _, t in got.values())
    assert all(abs(r["n"] - 200 * got[r["source"]][1] / total) <= 4 for r in first)


def test_mixed_documents_have_the_words(spark, docs):
    plain = docs.select(*ROWS and ["doc_id", "text", "lang", "source", "n_chars"])
    mixed = mixing.mixed_documents(plain)
    assert mixed.columns == plain.columns
    n = mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert n == mixing.taken(plain).agg(F.sum("taken")).first()[0]


def test_bpe_edges(docs, spark):
    r = by_id(bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN))
    assert r[1]["n_tokens"] == 0 and r[1]["ids_sha256"] == r[2]["decoded_sha256"] == SHA("")
    assert r[4]["decoded_sha256"] == SHA(LONG) and r[7]["decoded_sha256"] == SHA(ROWS[8][1])
    ids = bpe.encode_ids(docs, RANKS, public_tokenizers.PATTERN)
    assert {x["doc_id"]: x["text"] for x in bpe.decode_ids(ids, RANKS).collect()}[4] == LONG


def test_bpe_runs_and_order_of_merges(monkeypatch):
    ranks = bpe.read_ranks(bpe.load_file(RANKS))
    replay = bpe.MergeReplay(ranks)
    words = [b"a" * 301, b"hello", "éé😀".encode(), b"", b"ababababab", b"  \n\n"]
    assert replay.replay(words) == [[ranks[w]] if w in ranks else replay._replay_word(w) for w in words]
    # a table in which a merge makes a pair of lower rank
    odd = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"xy": 270, b"ab": 310}
    m = bpe.MergeReplay(odd)
    assert m._replay_block([b"abcz", b"zabcabc"]) == [m._replay_word(b"abcz"), m._replay_word(b"zabcabc")] == [[260, 122], [122, 260, 260]]


def test_secret_spans(docs):
    r = by_id(secrets.digest(docs))
    text = ROWS[9][1]
    a, p = text.index(KEY), text.index("password")
    end = text.index("'", p + 10)
    assert r[8]["spans"] == f"access:{a}:{a + 20},assign:{p}:{end}"
    assert (r[8]["n_access"], r[8]["n_assign"], r[8]["n_hex"]) == (1, 1, 0)
    assert r[1]["base_sha256"] == SHA("") and r[1]["spans"] == ""


def test_weak_parts_need_partners(spark):
    key, far = "Ab1" + "x" * 37, "." * 1000
    t = [f"{key}", f"{KEY} {key}", f"{key} {far} {KEY}", "https://db.example.com/x", f"https://db.example.com {KEY} {key}", "secret=token: abcdefgh"]
    got = [r["spans"] for r in secrets.digest(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == "" and got[1] == "access:0:20,key:21:61" and got[2] == f"access:{1042}:{1062}" and got[3] == ""
    assert got[4].startswith("endpoint:0:22,access:") and got[5] == ""


def test_redaction(docs):
    r = {x["doc_id"]: x["text"] for x in secrets.redacted(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()}
    assert r[8] == "key [access] and [assign]' end" and r[4] == LONG and r[1] is None


def test_licenses(docs, spark):
    r = by_id(licenses.scan(docs))
    assert (r[9]["n_base"], r[9]["first_word"], r[9]["base_labels"], r[9]["labels"], r[9]["score"]) == (1, 3, "mit", "mit", 1.0)
    assert (r[1]["n_words"], r[1]["labels"], r[1]["score"]) == (0, "", 0.0)
    text = licenses.TEMPLATES[3][1]
    t = [text, " ".join(text.split()[:-1]), " ".join(text.split()[:20]), "Licensed under CC BY 4.0.", "licensed under cc-by-nc 4.0"]
    got = [r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "", "", "cc-by-nc"]


def test_wrapped_license_text(spark):
    text = "\n".join(licenses.TEMPLATES[3][1].split(" "))
    r = licenses.scan(spark.createDataFrame([(1, f"intro\n\n{text}\n\nmore")], "doc_id int, text string")).first()
    assert r["labels"] == "mit" and [(m["at"], m["containment"]) for m in r["matches"]] == [(1, 1.0)]


def test_license_blocks_cross_lines_and_are_bounded(spark):
    words = [f"w{i}" for i in range(5000)]
    for k, w in enumerate("licensed under cc by nc 4 0".split()):
        words[k * 700] = w
    near = "x licensed y under z cc by - nc ... 4\n\n0"
    t = ["licensed under the GNU\nAffero General Public License", " ".join(words), near, "\u212anow LICENSE mIt-License \u0130 mit", None]
    got = [(r["labels"], r["score"], r["n_words"], r["first_word"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0][:2] == ("agpl,gpl", 1.0) and got[1] == ("", 0.0, 5000, None) and got[2][:2] == ("cc-by-nc", 1.0) and got[3] == ("mit", 1.0, 6, 2) and got[4] == ("", 0.0, 0, None)


def plain_containment(text, template, theta=licenses.THETA):
    """The largest share of the template's words in any block, by counting every block."""
    w, ws = re.findall("[a-z0-9]+", text.lower()), licenses.template_words(template)
    n, own = licenses.SPREAD * len(ws), set(ws)
    most = max((len(own & set(w[i : i + n])) for i in range(len(w))), default=0)
    return most / len(own) if most >= math.ceil(theta * len(own) - 1e-9) else 0.0


def test_licenses_by_counting_blocks(spark):
    rng = np.random.default_rng(4)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)}) + ["x"] * 30
    texts = []
    for k in range(150):
        w = list(licenses.template_words(licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1]))
        for _ in range(int(rng.integers(0, 2 * len(w)))):
            w.insert(int(rng.integers(len(w) + 1)), str(rng.choice(vocabulary)))
        for _ in range(int(rng.integers(0, 3))):
            w.pop(int(rng.integers(len(w))))
        texts.append("\n".join(w))
    got = {r["doc_id"]: (set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))), r["base_labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for k, t in enumerate(texts):
        by = [(label, plain_containment(t, x)) for label, x in licenses.TEMPLATES]
        base = set(filter(None, got[k][1].split(",")))
        assert got[k][0] == {label for label, c in by if c} - base and got[k][2] == (1.0 if base else max(c for _, c in by))


def test_every_template_wrapped(spark):
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split(" ")
        rows.append((k, "intro\n\n" + " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :]) + "\n\nmore"))
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        assert licenses.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == 1.0


def test_quality(docs):
    r = by_id(quality_rules.ledger(docs))
    assert r[1]["n_words"] == 0 and r[1]["failed_bits"] == 1
    assert r[9]["n_repeat_words"] == 40 and r[7]["n_dup_lines"] == 1


def test_ablation_counts(docs):
    rows = quality_rules.ledger(docs)
    bits = [x["failed_bits"] for x in rows.collect()]
    for a in quality_rules.ablation(rows, quality_rules.FULL).collect():
        b = 1 << next(x.bit for x in quality_rules.RULES if x.name == a["rule"])
        assert (a["n_failed"], a["n_alone"], a["n_kept_without"]) == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))


def brute_components(texts):
    sets, out = {}, {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    for d in ids:
        out[d] = (len(sets[d]), find(d))
    return out


def variants(n_groups, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    passage = " ".join(rng.choice(words, 60))
    for g in range(n_groups):
        base = list(rng.choice(words, int(rng.integers(3, 250))))
        for _ in range(int(rng.integers(1, 8))):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 14))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            texts[k] = " ".join(t) + (" " + passage if g % 3 == 0 else "")
            k += 1
    return texts


@pytest.mark.parametrize(("seed", "group"), [(0, 1024), (1, 4)])
def test_jaccard_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    texts = variants(60, seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(texts)


def test_jaccard_large_groups(spark, monkeypatch):
    """Groups of many near copies, some that drift away from each other, and a passage that all share."""
    monkeypatch.setattr(jaccard, "GROUP", 8)
    rng = np.random.default_rng(9)
    words, texts = [f"word{i}" for i in range(300)], {}
    passage = [str(w) for w in rng.choice(words, 40)]
    for g in range(3):
        t = [str(w) for w in rng.choice(words, 90)]
        for _ in range(45):
            if g == 2:  # each a step from the one before
                t = list(t)
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
                own = t
            else:
                own = list(t)
                for _ in range(int(rng.integers(0, 3))):
                    own[int(rng.integers(len(own)))] = str(rng.choice(words))
            texts[len(texts)] = " ".join(passage + own)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(texts) and len({c for _, c in got.values()}) < 30


def test_word_hashes_across_chunks(monkeypatch):
    raw = ("ab cde  f\tghijklm " * 40 + "x" * 300).encode()
    whole = jaccard.word_hashes(raw)
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    parts = jaccard.word_hashes(raw)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == [len(w) for w in raw.split()] == parts[1].tolist()


@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=40), min_size=2, max_size=25))
@settings(max_examples=60, deadline=None)
def test_tree_loses_no_link(lists):
    sets = [np.unique(jaccard._mix(np.array(x, np.uint64))) for x in lists]
    members = [jaccard.Member(i, len(s), int(s[0] >> np.uint64(1)), jaccard.bitmap(s), 0, s) for i, s in enumerate(sets)]
    found = jaccard.Joined()
    for a, b in jaccard.group_links(members):
        found.join(a, b)
    want = jaccard.Joined()
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            if 4 * both >= 3 * (len(s) + len(sets[j]) - both):
                want.join(i, j)
    assert [found.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_jaccard_edges(docs):
    r = by_id(jaccard.jaccard_components(docs))
    assert (r[1]["n_shingles"], r[1]["component_id"]) == (0, 1) and (r[3]["n_shingles"], r[3]["component_id"]) == (0, 3)
    assert r[6]["component_id"] == 5 and r[5]["n_shingles"] == 1


def test_jaccard_null_and_shared_ids(spark):
    a, b, c = "alpha beta gamma delta eps zeta eta", "one two three four five six seven eight", "p q r s t u v w"
    rows = [(None, a), (5, a), (None, b), (9, b), (None, b), (7, "x y"), (7, c), (3, "x y"), (None, "lone words"), (None, "lone words"), (None, None), (None, " "), (7, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: repr(tuple(r))
    want = [(None, 3, 5), (5, 3, 5), (None, 4, 9), (9, 4, 9), (None, 4, 9), (7, 1, 3), (7, 4, 7), (3, 1, 3), (None, 1, None), (None, 1, None), (None, 0, None), (None, 0, None), (7, 4, 7)]
    assert sorted(jaccard.jaccard_components(d).collect(), key=key) == sorted(want, key=key)
    kept = sorted((tuple(r) for r in jaccard.representatives(d).collect()), key=repr)
    assert kept == sorted([(5, a), (9, b), (7, c), (3, "x y"), (None, "lone words"), (None, None), (None, " ")], key=repr)


def test_jaccard_lists_in_runs(monkeypatch):
    """Lists that are cut from sorted rows give the groups that all rows at once would give."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    h, c = np.sort(rng.integers(0, 40, 600)), rng.integers(0, 30, 600)
    batches = [pa.RecordBatch.from_arrays([pa.array(h[a : a + 17]), pa.array(c[a : a + 17])], names=["h", "c1"]) for a in range(0, 600, 17)]
    want = {(min(c[h == x]), y) for x in set(h.tolist()) for y in c[h == x] if min(c[h == x]) < max(c[h == x])}
    for most in (10, 100, 10_000):
        monkeypatch.setattr(jaccard, "POSTINGS", most)
        assert {(x, y) for b in jaccard._lists(iter(batches)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == want


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("id", F.lit("x"))
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == {0: [(1, 1, 1.0), (2, 8, 1.0), (3, 2, 0.5), (4, 20, -1.0)], 20: [(1, 2, -0.5), (2, 0, -1.0), (3, 1, -1.0), (4, 8, -1.0)]}
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).collect() == []


def test_nearest_with_many_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[:400] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    y, hits = x.astype(np.float64), 0
    for q, ids in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(ids) & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.95


def test_packing_search():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400).tolist()
    rows = packing.best_fit_decreasing(lengths, 100)
    assert sorted(i for r in rows for i in r) == list(range(400)) and all(sum(lengths[i] for i in r) <= 100 for r in rows)
    free: list[int] = []
    for n in sorted(lengths, reverse=True):  # plain best fit
        k = min((k for k, c in enumerate(free) if c >= n), key=lambda k: free[k], default=None)
        if k is None:
            free.append(100 - n)
        else:
            free[k] -= n
    assert len(rows) == len(free)


def test_packing_edges(docs, empty):
    rows = packing.pack(docs).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((r[1] or "").encode()) + 1 for r in ROWS)
    assert packing.pack(empty).collect() == []


def test_packing_width_follows_the_vocabulary(spark):
    class Some:
        def __init__(self, size):
            self.size = size

        def encoder(self):
            return lambda text: np.array([70_000, len(text)])

    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = packing.pack(d, Some(100_000), context=8).first()
    assert r["id_bytes"] == 4 and np.frombuffer(r["ids"], "<u4").tolist() == [70_000, 3, 100_000] + [100_001] * 5
    with pytest.raises(Exception, match="beyond the 60000"):
        packing.pack(d, Some(60_000)).collect()


def test_bounds_that_a_caller_has_set_stay(spark):
    from marlstone.llm import batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "777")
        batches.bound_batches(spark)
        assert spark.conf.get(key) == "777"
        spark.conf.unset(key)
        batches.bound_batches(spark)
        assert spark.conf.get(key) == str(batches.ROWS)
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def test_long_texts_have_the_same_ids(monkeypatch):
    vocabulary = packing.BpeIds(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"wörd{i}  x" for i in range(500)) + "\n" * 50
    short = vocabulary.encoder()(text)
    monkeypatch.setattr(bpe, "RUN", 100)
    assert vocabulary.encoder()(text).tolist() == short.tolist()
    monkeypatch.undo()
    assert len(vocabulary.encoder()("a" * 300_000 + " " * 300_000)) > 0


def test_chat_edges(spark):
    conv = spark.createDataFrame([(1, 0, "user", "Hi?"), (1, 1, "assistant", "Hello.\nYes."), (1, 1, "assistant", "Hello.\nYes."), (1, None, "user", None), (2, 0, "judge", "x"), (3, 0, "system", "Be kind."), (3, 1, "user", "Go"), (3, 2, "assistant", "Gone"), (None, 0, "user", "A?"), (None, 0, "user", "B?")], "conv_id long, turn int, role string, text string")
    conv = conv.withColumn("turns", F.lit(1)).withColumn("t", F.lit(1)).withColumn("late", F.lit("x"))
    w = chat.transcripts(conv)
    model = chat.fit(w)
    got = sorted((r["conv_id"] or 0, r["roles"], r["n_turns"]) for r in chat.format_transcripts(w, model).collect())
    assert [g[0] for g in got] == [0, 0, 1, 2, 3] and got[0][2] == got[1][2] == 1 and got[2][1] == "user,assistant,user" and got[4][1].startswith("system")
    raw = spark.createDataFrame([(1, None), (2, ""), (3, "User: a\nb\n\nAssistant: c"), (4, "x\n" * 5000)], "conv_id long, text string")
    r = {x["conv_id"]: x for x in chat.format_transcripts(raw, chat.fit(chat.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))).collect()}
    assert (r[1]["n_turns"], r[1]["text"], r[2]["n_turns"]) == (0, "", 0)
    assert r[3]["text"] == "<|user|>\na\nb\n<|assistant|>\nc"
    assert chat.format_transcripts(raw.limit(0), model).collect() == [] and chat.transcripts(conv.limit(0)).collect() == []
    assert chat.fit(chat.transcripts(conv.limit(0))).start.shape == (8,)


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    n = len(chat.STATES)
    logs = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1]))
    m = chat.Model(np.log(rng.dirichlet(np.ones(n))), logs(n, n), [logs(n, k) for k in chat.SHAPES])
    f = [tuple(int(rng.integers(k)) for k in chat.SHAPES) for _ in range(4)]
    value = lambda p: m.start[p[0]] + sum(m.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(t[s, x[k]] for s, x in zip(p, f, strict=True) for k, t in enumerate(m.seen))
    assert tuple(m.decode(f)) == max(product(range(n), repeat=4), key=value)


def test_classifier_without_usable_labels(docs, labels):
    r = cotraining.score(docs, labels).collect()
    assert all(x["kept"] for x in r) and len({x["score"] for x in r}) == 1


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_stage_edges(spark, docs, empty, tmp_path, labels, stage):
    """Null, empty and long texts, repeated rows, null ids, and columns with names that the stages use themselves."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = ("_fp", "_found", "_size", "_stays", "_own", "_text", "_id", "_n", "fp", "found", "id", "no_id", "id0", "keeper", "slot", "lo", "chunk", "row.x", "words", "m", "j", "at")
    wide = docs.select(*empty.columns)
    for n in names:
        wide = wide.withColumn(n, F.lit(n))
    wide = wide.withColumn("row", F.lit("row"))
    out = stage(spark, wide, str(tmp_path))
    assert out.columns == wide.columns and dict(out.dtypes) == dict(wide.dtypes)
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in (*names, "row"))
    assert stage(spark, empty, str(tmp_path)).collect() == []


def test_pipeline_stages_by_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = corpus_pipeline.quality_classifier(spark, docs, sf).cache()
    kept = {r["doc_id"] for r in cotraining.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    assert set(texts) == kept and 0 < len(kept) < docs.count()
    b = corpus_pipeline.ngram_jaccard_join(spark, a, sf).cache()
    comps = brute_components(texts)
    assert {r["doc_id"] for r in b.collect()} == {d for d, (n, c) in comps.items() if c == d}
    c = corpus_pipeline.secret_scans(spark, b, sf).cache()
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(b).collect()}
    for r in c.collect():
        t = texts[r["doc_id"]]
        for kind, s, e in reversed([x.split(":") for x in filter(None, spans[r["doc_id"]].split(","))]):
            t = f"{t[: int(s)]}[{kind}]{t[int(e) :]}"
        assert r["text"] == t and r["n_chars"] == len(t)
    m = corpus_pipeline.source_mix(spark, c, sf).cache()
    mixed = [r["text"] for r in m.collect()]
    assert sum(len(t.split()) for t in mixed) == mixing.taken(c).agg(F.sum("taken")).first()[0]
    e = corpus_pipeline.bpe_encoding(spark, m, sf)
    assert sorted(r["decoded_sha256"] for r in e.collect()) == sorted(map(SHA, mixed))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, e.collect()))


def recall(got, x, is_query):
    y = x.astype(np.float64)
    hits = asked = 0
    for q in filter(is_query, range(len(x))):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
        asked += 20
    return hits / asked


def test_nearest_recall_across_blocks(spark):
    """More distinct vectors than a block holds, so the graph and its search decide; production parameters."""
    rng = np.random.default_rng(7)
    gaussian = rng.normal(size=(1500, 24))
    centres = rng.normal(size=(30, 24)) * 3
    clustered = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 24)) * 0.3
    x = np.vstack([gaussian, clustered * rng.uniform(0.2, 3, (1500, 1)), np.repeat(gaussian[:1], 300, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert recall(got, x, lambda q: q % 20 == 0) >= 0.9


def test_nearest_with_unequal_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.0, 9.0]), (3, [5.0]), (20, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0)]
