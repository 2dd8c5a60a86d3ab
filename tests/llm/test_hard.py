"""Brute force, SQL and growth: what small tables and lucky hashes would not show."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import common, op2_quality, queries, word_table
from ledgerloom.llm import op1_token_planes as op1
from ledgerloom.llm import op3_bpe as op3
from ledgerloom.llm import op4_pivots as op4
from ledgerloom.llm import op5_substrings as op5
from ledgerloom.llm import op6_language as op6
from ledgerloom.llm import op7_minhash as op7
from ledgerloom.llm import op8_secrets as op8
from ledgerloom.llm import op9_caps as op9
from ledgerloom.llm import op10_mixing as op10

from . import cases
from .test_operators import grouped, vectors

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def mirrored(n: int) -> tuple[str, str]:
    """A word of a and b and its complement that many sums of powers of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_weak_hashes_confuse(spark):
    words = [w for n in (1024, 2048) for w in mirrored(n)]
    texts = [*words, *(f"{w} x y z w" for w in words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in op3.encode_rows(docs, PATH).collect()} == want
    table = op1.library_table(PATH)
    data, at = common.text_bytes(pa.array(texts))
    ids, first = table.encode(data, at)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == list(want.values())
    assert all(r["component_id"] == r["doc_id"] for r in op7.near_duplicates(docs).collect())


def test_words_are_told_apart_without_a_hash(spark, monkeypatch):
    monkeypatch.setattr(word_table, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    bpe = op3.Bpe(PATH)
    table = word_table.WordTable(bpe.merge, bpe.encode, word_table.lower_words([s.encode() for s in bpe.specials]))
    texts = [t or "" for _, t in cases.texts() if len(t or "") < 3000]
    for part in (texts[:20], texts[20:], texts):
        data, at = common.text_bytes(pa.array(part))
        ids, first = table.encode(data, at)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [bpe.encode(t).tolist() for t in part]


def test_hashes_and_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    for length in (8, 25, 64, 200):
        for lane in (0, 1):
            got = common.gram_hashes(data, length, lane)
            names = {data[i : i + length].tobytes(): h for i, h in enumerate(got.tolist())}
            assert len(got) == 5000 - length + 1 and len(set(got.tolist())) == len(names)
            assert all(names[data[i : i + length].tobytes()] == h for i, h in enumerate(got.tolist()))
    starts, size = rng.integers(0, 4000, 3000), rng.integers(0, 40, 3000)
    other = rng.integers(0, 4000, 3000)
    want = [data[a : a + n].tobytes() == data[b : b + n].tobytes() for a, b, n in zip(starts, other, size, strict=True)]
    assert common.same_spans(data, starts, data, other, size).tolist() == want
    hashes = common.span_hashes(data, starts, starts + size)
    assert len(set(hashes.tolist())) == len({data[a : a + n].tobytes() for a, n in zip(starts, size, strict=True)})


def test_shared_counts_need_both_hashes():
    sets = [np.array([1, 2, 3], np.uint64), np.array([1, 2, 4], np.uint64)]
    assert op7.shared_counts(sets)[0, 1] == 2
    assert op7.shared_counts(sets, [np.array([7, 8, 9], np.uint64), np.array([7, 5, 9], np.uint64)])[0, 1] == 1


@pytest.mark.parametrize(("rows", "values", "parts"), [(2, 2, 2), (40, 2, 40), (60, 3, 7), (300, 40, 300), (50, 1, 5), (30, 2, 1)])
def test_skip_merging_finds_every_pair(rows, values, parts):
    """Pairs of different parts that share MATCHES tokens, by hand; lists of few and of many rows, and rows that are alike."""
    rng = np.random.default_rng(rows)
    tokens = (rng.integers(0, values, (rows, op7.COORDINATES)) + 1000 * np.arange(op7.COORDINATES)).astype(np.uint64)
    tokens[rows // 2 :] = np.where(rng.random((rows - rows // 2, 1)) < 0.5, tokens[: rows - rows // 2], tokens[rows // 2 :])
    part = np.sort(rng.integers(0, parts, rows))
    queries = rng.permutation(rows)[: rows // 2 + 1]
    got = [pair for xs, ys in op7.collisions(tokens, part, queries, np.ones(rows, bool)) for pair in zip(xs.tolist(), ys.tolist(), strict=True)]
    want = {(x, y) for x in queries.tolist() for y in range(rows) if part[x] != part[y] and (tokens[x] == tokens[y]).sum() >= op7.MATCHES}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("few", [1, 5, 60])
def test_links_of_a_group_join_what_is_linked(few):
    """Components by a group's forest and by all pairs; classes that are retained are those with a fellow."""
    rng = np.random.default_rng(few)
    seeds = [rng.integers(0, 1 << 60, 60, dtype=np.uint64) for _ in range(few)]
    sets = []
    for i in range(120):
        s = seeds[i % few].copy()
        change = int(rng.integers(0, 14))
        s[:change] = rng.integers(0, 1 << 60, change, dtype=np.uint64)
        sets.append(np.sort(s))
    names = [b"%016d" % i for i in range(120)]
    parts = [names[i if i % 3 else 0] for i in range(120)]
    sigs = [r.tobytes() for r in op7.minima(np.concatenate(sets), np.arange(120) * 60)]
    met = [(a, b) for a in range(120) for b in range(120) if parts[a] != parts[b] and sum(x == y for x, y in zip(*(np.frombuffer(sigs[k], np.uint64) for k in (a, b)), strict=True)) >= op7.MATCHES]
    assert {n for n, _ in op7.retained(names, parts, sigs, [60] * 120)} == {names[a] for a, _ in met}

    def joined(links):
        label = {p: p for p in names}
        for a, b in links:
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return label

    inside = list(zip(names, parts, strict=True))
    near = [(names[a], names[b]) for a in range(120) for b in range(120) if parts[a] != parts[b] and len(both := np.intersect1d(sets[a], sets[b])) * 100 >= 75 * (120 - len(both))]
    found = op7.group_links(names, parts, [s.tobytes() + (s + np.uint64(1)).tobytes() for s in sets])
    assert joined(inside + found) == joined(inside + near)


def test_long_texts(spark):
    """Texts beyond a slice of bytes, and words beyond any table's."""
    rng = random.Random(9)
    long = cases.sentence(rng, cases.WORDS, 600_000)  # about 2.7 MB
    texts = [long, "é" * 3000 + " end", long + " token=abcdefgh1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    want = {i: sha(" ".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids)).encode()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_sha256"] for r in op3.encode_documents(docs, PATH).collect()} == want
    assert [r["n_tokens"] for r in op1.token_planes(spark, docs, PATH).orderBy("doc_id").collect()] == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert {r["doc_id"]: r["component_id"] for r in op7.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 0}
    assert {r["doc_id"]: r["n_assign"] for r in op8.scan(docs).collect()} == {0: 0, 1: 0, 2: 1}
    gone = {r["doc_id"]: r["n_removed"] for r in op5.digests(docs).collect()}
    assert gone[0] == len(long) and gone[1] > 5000 and gone[2] >= len(long)


def test_op2_scores_as_the_network_does(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in op2_quality.score(docs, labels).collect()}
    table = op2_quality.word_vectors(docs)
    net = op2_quality.fit(*op2_quality.labelled_features(docs, labels, table))
    for r in docs.collect():
        data, at = common.text_bytes(pa.array([r["text"]], pa.string()))
        slots, _ = op2_quality.word_slots(data, at)
        words = table[slots].astype(np.float64) if len(slots) else np.zeros((1, op2_quality.DIMS))
        x = np.concatenate([words.mean(0), np.sqrt(np.maximum(0, (words**2).mean(0) - words.mean(0) ** 2)), [np.log1p(len(slots))]])
        w1, b1, w2, b2 = net.weights
        logit = (np.maximum(0, (x - net.center) / net.scale @ w1 + b1) @ w2 + b2[0]) / net.temperature
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-logit))) < 1e-3


def test_op2_keeps_to_its_sample(spark, monkeypatch):
    monkeypatch.setattr(op2_quality, "TRAIN_ROWS", 10)
    docs = spark.createDataFrame([(i % 4, f"word{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(400)], "doc_id long, quality int")
    x, y = op2_quality.labelled_features(docs, labels, np.zeros((op2_quality.WORDS, op2_quality.DIMS), np.float32))
    assert len(x) == len(y) <= 10


def test_op4_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    data = [(int(i) * 50, rng.normal(size=6 if i % 3 else 4).tolist()) for i in range(40)]
    data += [(100, rng.normal(size=6).tolist()), (100, data[2][1]), (100, data[2][1]), (7, [1e300] * 6), (300, rng.normal(size=2).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").where("vec_id <> 7")
    rows = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in data if i != 7]
    want = Counter()
    for k, (q, a) in enumerate(rows):
        if q % 100 == 0:
            best = sorted((-int(a @ b), c) for j, (c, b) in enumerate(rows) if j != k and len(b) == len(a))[:10]
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(best))
    assert Counter(tuple(r) for r in op4.nearest(df).collect()) == want
    told = op4.nearest(df, evaluated=True)
    assert told.where("evaluated <= 0 or evaluated is null").count() == 0
    assert op4.whole(np.array([1e300, -1e300, 1.5])).tolist() == [2**63 - 1, -(2**63), 1536]


def test_op4_pool_is_drawn_before_it_is_ranked(spark, monkeypatch):
    """Few rows are ranked, a vector's copies among them as rarely as others, and all if there are few."""
    monkeypatch.setattr(op4, "POOL", 50)
    rows = spark.range(20_000).select(F.col("id").alias("row"), F.col("id").alias("vec_id"), F.when(F.col("id") < 20, 3).otherwise(4).cast("long").alias("dims"), F.when(F.col("id") % 2 == 0, F.lit(b"same")).otherwise(F.col("id").cast("string").cast("binary")).alias("v"))
    counts = rows.groupBy("dims").agg(F.count("*").alias("size"))
    got = op4._pool(rows, counts, 20_000).collect()
    assert sum(r["dims"] == 3 for r in got) == 20 and 45 <= sum(r["dims"] == 4 for r in got) <= 50
    assert 10 <= sum(bytes(r["v"]) == b"same" for r in got if r["dims"] == 4) <= 40


def test_op4_spares_products(spark):
    """Clustered vectors: most candidates are never multiplied."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 8)) * 10
    data = [(i, (centers[i % 40] + rng.normal(size=8)).tolist()) for i in range(12_000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    per = op4.nearest(df, step=1000, evaluated=True).select("query_id", "evaluated").distinct()
    assert per.agg(F.avg("evaluated")).first()[0] < 0.5 * 12_000


def test_op5_with_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(op5, "HOT", 50)
    monkeypatch.setattr(op5, "HOT_LEAST", 3)
    monkeypatch.setattr(op5, "STEPS", (25, 50, 100))
    rng = random.Random(2)
    passage = cases.sentence(rng, cases.WORDS, 80)
    texts = [f"{cases.sentence(rng, cases.WORDS, 30)} {passage} {cases.sentence(rng, cases.WORDS, 30)}" for _ in range(60)]
    texts += [cases.sentence(rng, cases.WORDS, 100) for _ in range(60)] + [passage] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert len(op5.hot_grams(docs)) > 0
    raw = [t.encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = Counter()
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want[i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))] += 1
    assert Counter(tuple(r) for r in op5.digests(docs).collect()) == want


def test_op5_compares_bytes(monkeypatch):
    data = np.frombuffer(b"".join(bytes([97 + k % 3]) * 100 + bytes(range(200)) for k in range(4)), np.uint8)
    right = op5._first_pointers(data)
    monkeypatch.setattr(op5, "gram_hashes", lambda d, n: np.zeros(len(d) - n + 1, np.uint64))
    same = lambda p: np.unique(p, return_index=True, return_inverse=True)[1:]
    assert (same(right)[0][same(right)[1]] == same(op5._first_pointers(data))[0][same(op5._first_pointers(data))[1]]).all()


def test_op6_posterior_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, cases.sentence(rng, cases.GERMAN if i % 3 == 0 else cases.WORDS, rng.randint(1, 60)), [None, "de", "en", "en", "xx"][rng.randrange(5)], f"h{i % 4}.{'com' if i % 2 else 'de'}") for i in range(120)]
    rows += [(200, "ok", "en", "h0.de"), (201, "", "en", "h0.de"), (202, None, None, None), (203, "zqx" * 30, None, "h9.com")]
    got = {r["doc_id"]: r for r in op6.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    names = sorted({said for _, _, said, _ in rows if said})
    grams = []
    for _, t, _, _ in rows:
        data, at = common.text_bytes(pa.array([t], pa.string()))
        grams.append(op6.trigrams(data, at)[0])
    counts = {s: np.zeros(op6.SLOTS) for s in names}
    for (_, _, said, _), g in zip(rows, grams, strict=True):
        if said:
            counts[said] += np.bincount(g, minlength=op6.SLOTS)
    mean = np.zeros((len(rows), len(names) + 1))
    for i, ((_, _, said, _), g) in enumerate(zip(rows, grams, strict=True)):
        for k, s in enumerate(names):
            own = counts[s] - (np.bincount(g, minlength=op6.SLOTS) if s == said else 0)
            if len(g):
                mean[i, k] = np.log((1 - op6.SPREAD) * op6.SLOTS * own[g] / max(1, own.sum()) + op6.SPREAD).mean()
    n = np.array([len(g) for g in grams])
    best = np.where(n > 0, mean.argmax(1), -1)
    told = [i for i, (_, _, said, _) in enumerate(rows) if said and n[i]]
    loss = op6.losses(mean[told], n[told], np.array([names.index(rows[i][2]) for i in told]))
    power = op6.EXPONENTS[int(np.round(loss, 6).argmin())]
    size = len(names) + 1
    tally = lambda keep: np.array([sum(1 for i in range(len(rows)) if best[i] == k and keep(rows[i])) for k in range(size)], float)
    every = tally(lambda r: True)
    base = (every + 1) / (every.sum() + size)
    for i, (doc, text, said, host) in enumerate(rows):
        letters = sum(c.isalpha() for c in text or "")
        suffix = (host or "").split(".")[-1] if "." in (host or "") else ""
        above = tally(lambda r: ((r[3] or "").split(".")[-1] if "." in (r[3] or "") else "") == suffix)
        own = tally(lambda r: (r[3] or "") == (host or ""))
        upper = (above + op6.SMOOTH * base) / (above.sum() + op6.SMOOTH)
        logs = mean[i] * n[i] ** power + np.log((own + op6.SMOOTH * upper) / (own.sum() + op6.SMOOTH))
        said_by = tally(lambda r: r[2] == said) if said else np.zeros(size)
        if said_by.any():
            logs = logs + np.log((said_by + 0.5) / (tally(lambda r: bool(r[2])) + 0.5 * size))
        p = np.exp(logs - logs.max())
        k = int(logs[:-1].argmax())
        r = got[doc]
        assert (r["lang"] is None) == (letters == 0)
        if letters:
            assert r["lang"] == names[k] and abs(r["confidence"] - p[k] / p.sum()) < 1e-9 and r["kept"] == (r["confidence"] >= op6.LEAST)


def test_op6_without_columns_and_with_equal_texts(spark):
    rows = [(i, cases.sentence(random.Random(i), cases.GERMAN if i % 2 else cases.WORDS, 40), "de" if i % 2 else "en", f"s{i % 2}") for i in range(40)]
    rows += [(1, rows[1][1], "de", "other"), (1, rows[1][1], "de", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert Counter((r["doc_id"], r["source"]) for r in op6.keep_identified(docs).collect()) == Counter((i, s) for i, _, _, s in rows)
    assert op6.keep_identified(docs.drop("source")).columns == ["doc_id", "text", "lang"]
    assert op6.keep_identified(docs.drop("lang")).count() == 0 and op6.keep_identified(docs.drop("source")).count() == len(rows)
    assert op10.mix(docs.drop("source")).count() == len(rows)


@pytest.mark.parametrize("limit", [2048, 4])
def test_op7_large_groups_of_parts(spark, monkeypatch, limit):
    """Groups with several kinds of near copies and bridges between them, cut into blocks or not."""
    monkeypatch.setattr(op7, "GROUP_SETS", limit)
    rng = random.Random(limit)
    base = cases.sentence(rng, cases.WORDS, 90).split()
    rows, kinds = [], [list(base), [*base[:60], *cases.sentence(rng, cases.GERMAN, 40).split()], [*base[:30], *cases.sentence(rng, cases.GERMAN, 70).split()]]
    for i in range(90):
        w = list(kinds[i % 3])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"odd{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    sets, top = grouped(rows)
    least: dict[int, int] = {}
    for (i, _), g in zip(rows, top, strict=True):
        least[g] = min(i, least.get(g, i))
    got = {r["doc_id"]: r["component_id"] for r in op7.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: least[g] for (i, _), g in zip(rows, top, strict=True)}


def test_op7_near_copies_grow_in_proportion(spark, monkeypatch):
    """Near copies of one text: rows that are dealt to blocks grow with their number, not with its square."""
    dealt = []
    plain = op7.links

    def counted(docs, one, placed):
        dealt.append(placed.count())
        return plain(docs, one, placed)

    monkeypatch.setattr(op7, "links", counted)
    rng = random.Random(4)
    base = cases.sentence(rng, cases.WORDS, 120).split()
    rows = []
    for i in range(20_000):
        w = list(base)
        w[rng.randrange(120)] = f"odd{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert op7.near_duplicates(docs).where("component_id = 0").count() == 20_000
    assert sum(dealt) < 4 * op7.PREFIX * 20_000 / 10


def test_op8_takes_linear_time():
    text = "é " + " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(300_000))  # 19.5 MB
    rows = pa.RecordBatch.from_pydict({"text": [text]})
    data, at = common.text_bytes(rows.column("text"))
    began = time.perf_counter()
    ((_, spans),) = list(op8.batch_spans(rows, data, at))
    assert time.perf_counter() - began < 60
    assert len(spans) == 300_000 and all(text[a:b] == text[a:b].strip() and b - a == 64 for a, b, _ in spans[::1000])


@pytest.mark.parametrize("rows", [10_000, 1_000_000, 100_000_000])
def test_op9_pairs_share_a_filter(rows):
    rng = np.random.default_rng(rows)
    code = op9.ProductCode(64, rows)
    a = rng.standard_normal((150, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((150, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.listed(a), code.listed(near), strict=True)]
    assert np.mean(shared) >= 0.99


def test_op9_vectors_of_extreme_sizes(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=6)
    data = [(0, (v * 1e200).tolist(), 1), (1, (v * 1e-200).tolist(), 1), (2, v.tolist(), 1), (3, (-v * 1e300).tolist(), 1), (4, [1e308] * 6, 1), (5, [1e-308] * 6, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op9.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_op10_placement_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op10, "BUCKET_ROWS", 9)
    rows = [(i % 7 if i % 5 == 0 else i, f"text {i}", f"s{0 if i % 3 else i % 11}") for i in range(400)] + [(None, "x", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("th", F.xxhash64("text").cast("string"))
    shares = {r["source"]: r["share"] for r in op10.source_shares(docs).collect()}
    got = op10.schedule(docs.drop("th"), shares, 4).collect()
    pools: dict[str, list] = {}
    for r in docs.collect():
        key = hashlib.md5(":".join(x for x in (None if r["doc_id"] is None else str(r["doc_id"]), r["th"]) if x is not None).encode()).hexdigest()
        pools.setdefault(r["source"] or "", []).append((key, r["doc_id"]))
    names = sorted(pools)
    blocks = [-(-len(pools[s]) // 4) for s in names]
    want = Counter()
    for slot, (s, k) in enumerate(op10.block_slots(op10.exact_weights([shares[s] for s in names]), blocks)):
        for place, (_, i) in enumerate(sorted(pools[names[s]], key=lambda x: x[0])[4 * k : 4 * k + 4]):
            want[i, names[s], k, slot, place] += 1
    assert Counter((r["doc_id"], r["pool"], r["block"], r["slot"], r["place"]) for r in got) == want


@pytest.mark.parametrize("kind", ["even", "skewed", "one slow", "many", "alike", "floats"])
def test_op10_any_range_of_the_schedule_by_itself(kind):
    """What every source had before any slot, and any range of slots, as in the schedule made from its start."""
    rng = random.Random(kind)
    for _ in range(12):
        n = {"many": 40, "one slow": 4}.get(kind, rng.randint(1, 7))
        weights = [rng.randint(1, 9) for _ in range(n)]
        blocks = [rng.randint(0, 60) for _ in range(n)]
        if kind == "skewed":
            weights = [rng.choice([1, 2, 50, 300]) for _ in range(n)]
        elif kind == "one slow":
            weights, blocks[0], blocks[1] = [1, *(rng.randint(100, 200) for _ in range(3))], 2, 150
        elif kind == "alike":
            weights = [3] * n
        elif kind == "floats":
            weights = op10.exact_weights([rng.random() ** 3 for _ in range(n)])
        whole = list(op10.block_slots(weights, blocks))
        assert len(whole) == sum(blocks)
        made, had = op10.Blocks(weights, blocks), Counter()
        for slot in range(len(whole) + 1):
            assert {s: k for s, k in made.before(slot).items() if k} == dict(had), (weights, blocks, slot)
            if slot < len(whole):
                had[whole[slot][0]] += 1
        cut = rng.randint(0, len(whole))
        assert list(op10.block_slots(weights, blocks, cut, cut + 9)) == whole[cut : cut + 9]


def test_op10_ranges_in_many_tasks(spark, monkeypatch):
    """The schedule does not depend on the ranges it is cut into; sources without a share come last."""
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) text", "concat('s', pow(id, 2) % 11 % 5) source")
    shares = {"s0.0": 1.5, "s1.0": 0.2, "s3.0": 7.25, "s4.0": 0.0}
    want = sorted(map(tuple, op10.schedule(docs, shares, 4).collect()))
    monkeypatch.setattr(op10, "RANGE_SLOTS", 50)
    monkeypatch.setattr(op10, "SOURCE_SLOTS", 1)
    assert sorted(map(tuple, op10.schedule(docs, shares, 4).collect())) == want
    assert len(want) == 3000


def test_op10_a_hot_id_spreads(spark):
    docs = spark.createDataFrame([(None if i % 2 else 1, f"t{i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    got = op10.schedule(docs, {"s": 1.0}, 8).collect()
    assert len({(r["slot"], r["place"]) for r in got}) == 3000


def test_pipeline_by_its_parts(spark):
    """run() gives what the brute-force versions of its stages give one after the other."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r["doc_id"]: r["lang"] for r in op6.identify(docs).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in found]
    sets, top = grouped(rows)
    first: dict[int, int] = {}
    for (i, _), g in zip(rows, top, strict=True):
        first[g] = min(i, first.get(g, i))
    left = {i: t for (i, t), s, g in zip(rows, sets, top, strict=True) if not s or first[g] == i}
    masked = {}
    for i, t in left.items():
        batch = pa.RecordBatch.from_pydict({"text": [t]})
        ((text, spans),) = list(op8.batch_spans(batch, *common.text_bytes(batch.column("text"))))
        masked[i] = op8.mask(text, spans)
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    want = {i: sha(" ".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids)).encode()) for i, t in masked.items()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want
    assert sorted(r["position"] for r in got) == list(range(len(want)))


def test_pipeline_of_nothing(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_joins_spread_hot_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)] + [(None, 5)], "k long, v long")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("size"), F.max("v").alias("m"))
    for how in ("left", "inner"):
        got = common.spread_join(rows, table.where("k <> 950"), ["k"], 1000, how)
        plain = rows.join(table.where("k <> 950").drop("size"), ["k"], how)
        assert Counter(map(tuple, got.select("k", "v", "m").collect())) == Counter(map(tuple, plain.select("k", "v", "m").collect()))


def test_vectors_helper(spark):
    assert vectors(spark)[0].count() == len(vectors(spark)[1])
