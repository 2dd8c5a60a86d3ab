"""Filter audit, periodic runs and packing against brute-force versions; cuts against the tokenizers library."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import common, op1_token_planes, op3_bpe, op11_audit, op12_runs, op13_packing

from . import cases

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


def audit_by_hand(rows, good, toxic):
    """rows: doc_id, part, text."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))

    def fails(i, t):
        w = SPLIT.findall(t)
        made = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        return {k for k, v in made.items() if v}

    told = [(p, fails(i, t), i in good, i in toxic) for i, p, t in rows]
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, failed, g, x in told:
            gone = False
            for step, letter in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                removed = letter in failed and not gone
                row[0] += not gone and not removed
                row[1] += removed
                row[2] += letter in failed and gone
                row[3] += failed == {letter}
                row[4] += removed and g
                row[5] += removed and x
                gone |= removed
    whole = Counter()
    for (part, order, step), row in out.items():
        whole[part, order[step - 1]] += row[1]
    return {k: (*row, whole[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_audit_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0, "x"), (0, 0, 1, "x"), (2, 1, 1, "y"), (5, 1, 0, "y"), (10, 1, 1, None), (None, 1, 1, "z"), (11, None, None, "z"), (60, 1, 0, "k"), (61, 0, 1, "k")], "doc_id long, quality int, toxic int, lang string")
    rows = [(r["doc_id"], r["lang"] or "", r["text"] or "") for r in docs.collect()]
    want = audit_by_hand(rows, {0, 2, 5, 10, 60}, {0, 2, 10, 61})
    got = op11_audit.audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert op11_audit.audit(docs.where("false"), labels).count() == 0
    bare = op11_audit.audit(docs.select("doc_id", "text"), labels.select("doc_id")).collect()
    assert len(bare) == 600 and sum(r["kept"] for r in bare if r["step"] == 5) % 120 == 0 and all(r["good_lost"] == 0 for r in bare)


def test_audit_masks(docs):
    """Boundaries of the conditions, and long texts, whose words are told apart by whole hashes."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join(words[:99]), " ".join(words[:80] + words[:20]), " ".join(words[:79] + words[:21]), "Ab" * 5 + "c" * 90, "A" * 10 + "é" * 90, "A" * 11 + "é" * 89, "", "\x0b \x0c", "é|", " ".join(words * 5000)]
    data, at = common.text_bytes(pa.array(texts))
    together = op11_audit.text_masks(data, at).tolist()
    assert together == [0, 1, 0, 2, 1, 1, 5, 1, 1, 9, 2]
    assert [int(op11_audit.text_masks(*common.text_bytes(pa.array([t])))[0]) for t in texts] == together


def test_audit_matrices():
    kept, removed, redundant, unique, shapley = op11_audit.matrices()
    assert kept.shape == removed.shape == redundant.shape == unique.shape == (32, 600) and shapley.shape == (32, 5)
    column = 5 * op11_audit.ORDERS.index("CABED") + 1  # filter A after C
    for mask in range(32):
        a, c = mask & 1, mask >> 2 & 1
        assert (kept[mask, column], removed[mask, column], redundant[mask, column], unique[mask, column]) == ((not a) & (not c), a & (not c), a & c, mask == 1)
    assert (shapley.sum(1) == [0] + [120] * 31).all()


def runs_by_hand(w):
    """start, length, period of all runs."""
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic(rng, n, letters):
    w = []
    while len(w) < n:
        if rng.random() < 0.4 and w:
            i = rng.randrange(len(w))
            w += w[i : i + rng.randrange(1, 30)]
        else:
            p = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
            m = rng.randrange(1, 30)
            w += (p * m)[:m]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = [periodic(rng, rng.choice([0, 1, 6, 40, 150]), rng.choice([1, 2, 3, 5])) if rng.random() < 0.7 else [rng.randrange(3) for _ in range(rng.choice([0, 5, 60]))] for _ in range(rng.randrange(1, 5))]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        a, b, q = op12_runs.runs(np.array([x for t in texts for x in t], np.int64), first)
        want = [(s + f, n, p) for t, f in zip(texts, first.tolist(), strict=False) for s, n, p in sorted(runs_by_hand(t), key=lambda r: (r[0], r[2]))]
        assert list(zip(a.tolist(), (b - a).tolist(), q.tolist(), strict=True)) == want


def test_longest_previous_factors():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(3)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        s = op12_runs.Suffixes(np.array([x for t in texts for x in t], np.int64), first)
        length, source = s.longest_previous()
        for t, f in zip(texts, first.tolist(), strict=False):
            for i in range(len(t)):
                match = lambda j, t=t, i=i: next(k for k in range(len(t) + 1) if i + k >= len(t) or t[j + k] != t[i + k])
                assert length[f + i] == max((match(j) for j in range(i)), default=0)
                if length[f + i]:
                    assert f <= source[f + i] < f + i and match(int(source[f + i]) - f) == length[f + i]


def runs_row(doc, text):
    w = SPLIT.findall(text)
    n, h = len(w), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(runs_by_hand(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *four, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_equals_brute_force(spark, docs):
    rng = random.Random(6)
    extra = [(1000 + i, " ".join(f"é{x}" for x in periodic(rng, 200, 4)) + "\n\t ", 1) for i in range(60)]
    both = docs.select("doc_id", "text", "k").unionByName(spark.createDataFrame(extra, "doc_id long, text string, k int"))
    want = Counter(runs_row(r["doc_id"], r["text"] or "") for r in both.collect())
    assert Counter(tuple(r) for r in op12_runs.find_runs(both).collect()) == want
    assert sum(1 for r in want if r[2] is not None) > 30 and op12_runs.find_runs(docs.where("false")).count() == 0


def test_runs_of_long_texts_and_collapsed_text(spark):
    rng = random.Random(3)
    long = cases.sentence(rng, cases.WORDS, 300_000)
    texts = [(1, "a b c " * 200_000 + "end"), (2, long), (3, "one " * 7 + "two"), (4, None), (5, long + " x y" * 10)]
    got = {r["doc_id"]: r for r in op12_runs.collapse(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["text"] == "a b c end" and [tuple(r) for r in got[1]["runs"]] == [(0, 600_000, 3)]
    assert got[3]["text"] == "one two" and got[4]["text"] == "" and got[5]["text"].endswith(" x y") and got[5]["text"].startswith(got[2]["text"])


def test_runs_do_not_trust_hashes(monkeypatch):
    data, at = common.text_bytes(pa.array(["ab cd ab xy ef ab"]))
    starts, ends, _ = common.word_spans(data, at)
    monkeypatch.setattr(op12_runs, "span_hashes", lambda d, s, e: (e - s).astype(np.uint64))
    n = op12_runs.word_numbers(data, starts, ends).tolist()
    assert n[0] == n[2] == n[5] and len(set(n)) == 4


STRANGE = ["'s", "'re", "'", "''", "'ll", "'S", " ", "  ", "\n", "\r\n", "\t", " ", " ", "　", "\x1c", "\x85", "a", "Straße", "É", "é", "1", "23", "٣", "½", "日本", "Σ", "ΑΣ", "İ", "ﬁ", "H̱", "̈", "$", "...", "<|", "<|endoftext|>", "<|startoftext|>", "\U0001f600", "", "՘", "￿", "don't", "l’été", "—", "Привет", "हिन्दी", "가", "한", "\U00010400"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cuts_equal_the_library(path):
    rng = random.Random(2)
    texts = ["".join(rng.choice(STRANGE) for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    tables = [op13_packing.byte_table(path)] if path == BYTE else [op1_token_planes.library_table(path), op3_bpe.loaded(path)[1]]
    for table in tables:
        for i in range(0, len(texts), 500):
            ids, first = table.encode(*common.text_bytes(pa.array(texts[i : i + 500])))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want[i : i + 500]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_character_is_cut_as_the_library_does(path):
    """Each character known to Python's tables, between letters, digits, blanks and apostrophes."""
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = ["".join(f"a{c}1{c}{c} {c}'s" for c in known[i : i + 100]) for i in range(0, len(known), 100)]
    texts = [t for k, t in enumerate(texts) if k < 400 or k % 20 == 0 or k > len(texts) - 50]
    table = op13_packing.byte_table(path) if path == BYTE else op1_token_planes.library_table(path)
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    ids, first = table.encode(*common.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def packed(rows, capacity):
    """Checks that bins have no gaps and hold `capacity` at most; returns their number."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        place = 0
        for offset, length in sorted(items):
            assert offset == place
            place += length
        assert place <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 60])
def test_packing_equals_the_library(spark, docs, capacity):
    tokenizer = library(BYTE)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        n = -(-len(ids) // capacity)
        cut = [0, *(len(ids) - capacity * k for k in range(n - 1, -1, -1))]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)))
    rows = op13_packing.pack_documents(docs, BYTE, capacity).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert packed(rows, capacity) <= 1.1 * total / capacity + 2
    assert op13_packing.pack_documents(docs.where("false"), BYTE).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    short = docs.where("coalesce(length(text), 0) < 400 and (text is null or not contains(text, '<|'))")
    tokenizer = library(BYTE)
    want = Counter(tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 50256]) for r in short.collect())
    got = [tuple(r["ids"]) for r in op13_packing.sequences(short, BYTE, end=50256).collect()]
    assert max(map(len, got)) <= 2048
    parts = Counter(tuple([*p, 50256]) for s in got for p in _split(s))
    assert want == parts


def _split(ids):
    out, part = [], []
    for x in ids:
        if x == 50256:
            out.append(part)
            part = []
        else:
            part.append(x)
    return out


@pytest.mark.parametrize(("group", "fan"), [(1 << 14, 16), (50, 2), (20, 4)])
@pytest.mark.parametrize("kind", ["short", "halves", "same", "large"])
def test_packing_in_rounds(spark, monkeypatch, group, fan, kind):
    """However many rounds, as few sequences as best fit over everything, but for the few of a round."""
    monkeypatch.setattr(op13_packing, "FAN", fan)
    rng = random.Random(group)
    draw = {"short": lambda: rng.randrange(1, 400), "halves": lambda: rng.choice([1100, 1300, 700, 300]), "same": lambda: 700, "large": lambda: rng.randrange(1025, 2049)}[kind]
    lengths = [draw() for _ in range(1500)] + [5, 2048]
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "item long, length long, note string").repartition(5)
    rows = op13_packing.pack(items, 2048, group).collect()
    assert Counter((r["item"], r["length"], r["note"]) for r in rows) == Counter((i, n, "x") for i, n in enumerate(lengths))
    alone = len(op13_packing.best_fit(np.array(lengths), 2048)[2])
    assert packed(rows, 2048) <= alone * 1.03 + -(-1500 // group)
    assert sorted(map(tuple, op13_packing.pack(items.repartition(2), 2048, group).collect())) == sorted(map(tuple, rows))


def test_rounds_merge_what_groups_leave(spark, monkeypatch):
    """Thirty groups leave a half-empty bin each; rounds put these together, beyond the broadcast's bound as well."""
    monkeypatch.setattr(op13_packing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(op13_packing, "FAN", 3)
    rng = random.Random(1)
    lengths = [rng.randrange(5, 30) for _ in range(1200)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = op13_packing.pack(items, 2048, 40).collect()
    assert packed(rows, 2048) <= 16
    with pytest.raises(ValueError):
        op13_packing.pack(items.withColumn("length", F.lit(0).cast("long")), 2048)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fill = op13_packing.best_fit(np.array([6, 5, 4, 3, 3, 2, 1]), 10)
    assert sorted(fill.tolist()) == [4, 10, 10] and bins[0] == bins[2] and offsets[2] == 6
    assert op13_packing.best_fit(np.zeros(0, np.int64), 10)[2].tolist() == []
    keep = op13_packing.passed_on(np.array([1500] * 5 + [400, 2040, 2048]), 2048, 3)
    assert keep.tolist() == [True, True, True, False, False, True, False, False]
