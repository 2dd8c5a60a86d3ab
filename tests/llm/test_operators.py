"""Each operator against a brute-force version on small hard tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import op1_token_planes as op1
from ledgerloom.llm import op2_quality as op2
from ledgerloom.llm import op3_bpe as op3
from ledgerloom.llm import op4_pivots as op4
from ledgerloom.llm import op5_substrings as op5
from ledgerloom.llm import op6_language as op6
from ledgerloom.llm import op7_minhash as op7
from ledgerloom.llm import op8_secrets as op8
from ledgerloom.llm import op9_caps as op9
from ledgerloom.llm import op10_mixing as op10
from ledgerloom.llm import queries
from ledgerloom.llm.common import shared_dir
from ledgerloom.llm.components import components

from . import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_op1_round_trip(spark, docs, rows, tokenizer):
    for kind, block in (("bit", 1 << 16), ("byte", 1000)):
        got = op1.read_planes(op1.write_planes(docs, PATH, 2, shared_dir(spark), kind, block)).collect()
        want = Counter()
        for i, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        place = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == place
            place += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_op1_planes(kind):
    for ids in ([0], [1], [5, 0, 7], list(range(70_000, 70_100)), [2**31]):
        a = np.array(ids, np.uint32)
        width = 32 if kind == "byte" else max(1, int(a.max()).bit_length())
        assert (op1.from_planes(op1.to_planes(a, width, kind), len(a), kind) == a).all()


def test_op2_learns_and_handles_hard_rows(spark, docs):
    good = [(1000 + i, cases.sentence(random.Random(i), cases.WORDS, 60)) for i in range(300)]
    bad = [(2000 + i, " ".join(w.upper() + "!!" for w in cases.sentence(random.Random(i), cases.WORDS, 60).split())) for i in range(300)]
    both = spark.createDataFrame([*good, *bad], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i, _ in [*good, *bad]] + [(None, 1, 0), (1, None, 0), (0, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op2.score(both, labels).collect()}
    held = [r for i, r in got.items() if i is not None and i >= 1000 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and all(r["held_out"] for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] < 2000) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert {r["score"] for r in op2.score(docs, labels.where("false")).collect()} == {0.5}


def test_op2_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in queries.op2_quality_query(spark, d).where("held_out").collect() if r["doc_id"] in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(pairs) > 0.9


def test_op3_equals_library(docs, rows, tokenizer):
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op3.encode_documents(docs, PATH).collect()) == want
    back = op3.decode_rows(op3.encode_rows(docs, PATH), PATH).where("doc_id = 14").first()["text"]
    text = next(t for i, t in rows if i == 14)
    assert back == tokenizer.decode(tokenizer.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 9))
    data = [(int(i), [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(300)]
    for i in range(60):  # near and equal ones
        v = x[i % 5] + (rng.normal(size=9) * 0.05 if i % 4 else 0)
        data.append((400 + i, [float(np.float32(c)) for c in v * (1 + i % 3)], i % 5 % 3))
    data += [(500, None, 1), (600, [], 1), (700, [0.0] * 9, 1), (800, [1.0, None] + [2.0] * 7, 1), (801, [float("nan")] * 9, 1), (802, [float("inf")] * 9, 1), (803, [1.0] * 4, 1), (None, data[0][1], 0), (5, data[7][1], 1), (5, data[7][1], None), (900, data[0][1], None)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit("x")).withColumn("v", F.lit(1)), data


@pytest.mark.parametrize("slab", [(1 << 13, 1 << 16), (20, 20)])
def test_op4_equals_brute_force(spark, monkeypatch, slab):
    monkeypatch.setattr(op4, "SLAB", slab)
    df, data = vectors(spark)
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in data if i is not None and v and None not in v and len(v) == 9 and np.isfinite(v).all()]
    want = set()
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-int(a @ b), c) for c, b in ok if c != q)[:10]
            want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert {tuple(r) for r in op4.nearest(df).collect()} == want
    assert op4.nearest(df.where("false")).count() == 0
    assert op4.nearest(df.where("vec_id in (0, 1, 2)")).count() == 2


@pytest.mark.parametrize("bucket", [512, 1])
def test_op5_equals_brute_force(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(op5, "BUCKET", bucket)
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want[i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha(kept)] += 1
    assert Counter(tuple(r) for r in op5.digests(docs).collect()) == want


def test_op6_finds_languages(spark, docs, rows):
    got = op6.identify(docs).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows if i is not None and i >= 20 and i < 50}
    for r in got:
        if r["doc_id"] in text:
            assert r["lang"] == ("de" if (r["doc_id"] - 20) % 3 == 0 else "en") and r["kept"]
    assert all(not r["kept"] and r["lang"] is None for r in got if r["doc_id"] in (5, 6, 7))
    kept = op6.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert op6.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_op6_evidence_is_fused(spark):
    rows = [(i, cases.sentence(random.Random(i), cases.GERMAN if i % 2 else cases.WORDS, 30), "de" if i % 2 else "en", "a.example.de" if i % 2 else "b.example.com") for i in range(80)]
    rows += [(100, "ok", "de", "a.example.de"), (101, "ok", "en", "b.example.com"), (102, "ok", "", "new.example.de"), (103, rows[1][1], "en", "b.example.com")]
    got = {r["doc_id"]: r["lang"] for r in op6.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[100], got[101], got[102], got[103]) == ("de", "en", "de", "de")


def test_op6_rejects_junk_and_undeclared_languages(spark):
    rng = random.Random(3)
    rows = [(i, cases.sentence(rng, cases.GERMAN if i % 2 else cases.WORDS, 60), "de" if i % 2 else "en", f"s{i % 4}") for i in range(120)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), rng.randbytes(120).hex(), base64.b64encode(rng.randbytes(150)).decode()]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"]
    rows += [(1000 + k, t, None, "s1") for k, t in enumerate(junk)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["lang"] for r in op6.identify(table).where("kept").collect()}
    assert kept == {i: said for i, _, said, _ in rows if i < 1000}
    assert {r["doc_id"] for r in op6.keep_identified(table).collect()} == set(kept)


def test_op6_knows_every_declared_language(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):  # languages with words of their own, all declared as often
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(25)]
        rows += [(k * 8 + i, cases.sentence(rng, words, 60), f"q{letters[k // 26]}{letters[k % 26]}", "s0") for i in range(8)]
    rows += [(9000, "".join(rng.choice(letters) for _ in range(300)), "zz", "s0")]  # a junk declaration on a junk text
    got = {r["doc_id"]: r for r in op6.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] and got[i]["lang"] == said for i, _, said, _ in rows if i < 9000)
    assert not got[9000]["kept"]


def test_op6_reads_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.example.de:80/a?b", '<html lang="de-AT"><script>var a="</p>";</script><p>der Hund</p>')], "page_id long, url string, html string")
    assert tuple(op6.page_documents(pages).first())[2:] == ("de", "x.example.de")
    assert "var" not in op6.page_documents(pages).first()["text"]
    found = op6.identify(op6.page_documents(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    assert found.where("lang = declared").count() > 0.95 * found.count()


def shingles(t: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def grouped(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                up[top(a)] = top(b)
    return sets, [top(a) for a in range(len(rows))]


@pytest.mark.parametrize("limit", [2048, 3])
def test_op7_equals_brute_force(docs, rows, monkeypatch, limit):
    monkeypatch.setattr(op7, "GROUP_SETS", limit)
    sets, top = grouped(rows)
    least: dict[int, int] = {}
    for (i, _), g in zip(rows, top, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, len(s), i if not s else least.get(g), (i == least.get(g)) if s else True) for (i, _), s, g in zip(rows, sets, top, strict=True))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op7.near_duplicates(docs).collect())
    assert got == want
    kept = op7.drop_near_duplicates(docs)
    full = {g for s, g in zip(sets, top, strict=True) if s}
    assert kept.columns == docs.columns
    assert kept.count() == len(full) + len({(i, t) for (i, t), s in zip(rows, sets, strict=True) if not s})


def test_op8_equals_plain_patterns(docs, rows):
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    want = Counter()
    for i, t in rows:
        spans = []
        for n, (kind, p) in enumerate(kinds.items()):
            for m in p.finditer(t or ""):
                if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                    spans.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
        shown = ",".join(s for _, _, s in sorted(spans))
        want[i, *(sum(n == k for _, n, _ in spans) for k in range(3)), sha(shown.encode())] += 1
    got = op8.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert sum(r["n_hex"] for r in got) >= 2 and sum(r["n_assign"] for r in got) >= 3


def test_op8_checksums_and_masks(spark, docs):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, bad = f"ghp_{body}{op8.checksum62(body)}", f"ghp_{body}000000"
    assert op8.keyword_spans(f"x {good} {bad}") == [(2, 2 + len(good), "github")]
    df = spark.createDataFrame([(1, f"é {good} end", 3)], "doc_id long, text string, n_chars long")
    assert tuple(op8.redact(df).first()) == (1, "é <github> end", len("é <github> end"))
    out = op8.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sum(r["n_access"] + r["n_hex"] for r in op8.scan(out).collect()) == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_op9_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op9, "BLOCK", block)
    df, data = vectors(spark)
    unit = []
    for _, v, label in data:
        x = np.array(v, np.float64) if v and None not in v else np.zeros(1)
        unit.append((label, x / np.linalg.norm(x)) if label is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    n, up = [0] * len(data), list(range(len(data)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            if unit[a] and unit[b] and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98:
                n[a] += 1
                n[b] += 1
                up[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _, _) in enumerate(data):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    want = Counter((i, n[k], least.get(top(k)) if unit[k] else i) for k, (i, _, _) in enumerate(data))
    got = op9.near_vectors(df).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_op10_deviates_by_less_than_a_block():
    for weights, blocks in (({"a": 1, "b": 1}, {"a": 3, "b": 9}), ({"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 400, **{f"s{i}": i for i in range(50)}}), ({"a": 333, "b": 334, "c": 7}, {"a": 10, "b": 2000, "c": 30})):
        taken = {}
        for s, lo, hi, start, period, slots in op10.phases(weights, blocks):
            for k in range(hi - lo):
                slot = start + k // len(slots) * period + slots[k % len(slots)]
                assert slot not in taken
                taken[slot] = s
        assert sorted(taken) == list(range(sum(blocks.values())))
        live, total = {s for s in weights if blocks[s]}, sum(w for s, w in weights.items() if blocks[s])
        done = Counter()
        for t in range(len(taken)):
            done[taken[t]] += 1
            if any(done[s] == blocks[s] for s in live):
                break
            assert all(abs(done[s] - (t + 1) * weights[s] / total) < 1 for s in live)


def test_op10_keeps_every_source_within_a_block():
    for weights, blocks in (([1] * 90, [5] * 90), ([50, 3, 2, 7, 1, 1], [400, 30, 0, 11, 60, 2]), ([333, 334, 7], [10, 2000, 30])):
        done, total = [0] * len(weights), sum(blocks)
        turns = sorted({Fraction(n, w) for n, w in zip(blocks, weights, strict=True)})
        level = i = 0
        for t, (s, k) in enumerate(op10.block_slots(weights, blocks), 1):
            assert k == done[s]
            done[s] += 1
            had = lambda v: sum(min(v * w, n) for w, n in zip(weights, blocks, strict=True))
            while i < len(turns) and had(turns[i]) <= t:
                level, i = turns[i], i + 1
            live = sum(w for w, n in zip(weights, blocks, strict=True) if level * w < n)
            v = level + Fraction(t - had(level), live) if live else level
            assert all(abs(d - min(v * w, n)) < 1 for d, w, n in zip(done, weights, blocks, strict=True))
        assert t == total and done == blocks


def test_op10_keeps_to_the_shares_that_were_asked_for():
    shares = [1 / 3, 2e-4, 1e-5, *(0.6 / i**1.3 for i in range(1, 61))]
    n = 200_000
    taken = np.array([s for s, _ in itertools.islice(op10.block_slots(op10.exact_weights(shares), [10 * n] * len(shares)), n)])
    for s, share in enumerate(shares):
        assert np.abs(np.cumsum(taken == s) - np.arange(1, n + 1) * (share / sum(shares))).max() < 1


def test_op10_has_a_target_for_every_source(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text", "concat('host', id % 150) as source")
    got = op10.schedule(docs, op10.source_shares(docs), 2).collect()
    assert len({r["pool"] for r in got}) == 150 and None not in {r["pool"] for r in got}
    for s in range(0, 1500, 150):  # equal sources: one block of each in every 150 slots
        assert len({r["pool"] for r in got if s <= r["slot"] < s + 150}) == 150
    given = {f"host{i}": 1.0 + i for i in range(100)}
    some = op10.schedule(docs, given, 2).collect()
    assert len(some) == 3000 and {r["pool"] for r in some} == {*given, None}
    none = op10.schedule(docs, {"host0": 0.0, "host1": 1.0}, 2).collect()
    assert min(r["slot"] for r in none if r["pool"] == "host0") == 1490


def test_op10_places_every_row(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(op10, "BUCKET_ROWS", 7)
    got = op10.schedule(docs, op10.source_shares(docs), 4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    for s in {r["slot"] for r in got}:
        part = [r for r in got if r["slot"] == s]
        assert len({r["pool"] for r in part}) == 1 and sorted(r["place"] for r in part) == list(range(len(part)))
    few = op10.schedule(docs, {"s0": 1.0}, 4).collect()
    assert len(few) == len(rows) and {r["pool"] for r in few} == {"s0", None}
    out = op10.mix(docs)
    assert out.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(rows)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(None, 1), (5, 5), (7, 6), (7, 6)]
    up: dict[int, int] = {}

    def top(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in pairs:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {a: top(a) for a in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark):
    e = cases.empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op1.token_planes(spark, e, PATH).count() == 0
    assert op2.score(e, labels).count() == 0
    assert op3.encode_documents(e, PATH).count() == 0
    assert op5.digests(e).count() == 0
    assert op6.identify(e).count() == op6.keep_identified(e).count() == 0
    assert op7.near_duplicates(e).count() == op7.drop_near_duplicates(e).count() == 0
    assert op8.scan(e).count() == op8.redact(e).count() == 0
    assert op9.near_vectors(vectors(spark)[0].where("false")).count() == 0
    assert op10.schedule(e, op10.source_shares(e)).count() == op10.mix(e).count() == 0
