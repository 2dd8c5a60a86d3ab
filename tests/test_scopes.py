"""Searches in registries, chained fills, scopes, streams of edits, stored candidates and pages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import plans
from ledgerloom.functions import similar
from ledgerloom.operators import changes, conditions, lookup, nearest, order, rematch
from ledgerloom.sources import paged
from ledgerloom.sources.files import scratch
from ledgerloom.streaming import writes

SMALL = "/root/testdata/sf0.001"
WORDS = ["PAN", "ALMENDRA", "SRL", "SA", "DEL", "NORTE", "COMERCIAL", "Ñandú", "JOSÉ", "X", "AB", "LA", "MADRID", "123"]


def some_names(seed, n, long=0.1):
    r = random.Random(seed)

    def one():
        if r.random() < 0.1:
            return "".join(r.choice("AB ") for _ in range(r.randrange(1, 12)))
        t = list(" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 30 if r.random() < long else 5))))
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice("AEIO XZ")
        return "".join(t)

    return [one() for _ in range(n)]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_many_pairs_score_as_one_by_one():
    a, b = some_names(1, 1500) + ["", "A", "", "B" * 200], some_names(2, 1500) + ["", "", "B", "AB" * 90]
    for one, many in ((similar.common, similar.common_many), (similar.ratio, similar.ratio_many), (similar.token_set_ratio, similar.token_set_many), (similar.partial_ratio, similar.partial_many), (similar.weighted_ratio, similar.weighted_many)):
        assert np.allclose(many(a, b), [one(x, y) for x, y in zip(a, b, strict=True)], atol=1e-9)
    assert similar.edits_many(a, b).tolist() == [plain_edits(x, y) for x, y in zip(a, b, strict=True)]
    assert len(similar.common_many([], [])) == 0


def test_scores_that_matter_are_exact():
    """With a score to reach, what reaches it is exact and nothing is scored too high."""
    a, b = some_names(3, 1500), some_names(4, 1500)
    least = np.array([random.Random(i).uniform(40, 95) for i in range(len(a))])
    for score in (similar.partial, similar.weighted, similar.name_score):
        exact, some = (similar.rounded(score.many(a, b, x)) for x in (None, least))
        assert (np.where(exact >= least, exact == some, some <= exact)).all()


@pytest.mark.parametrize("score", ["edits", "token_set", "partial", "weighted", "name_score"])
def test_bounds_hold_and_the_best_is_found(score, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", (16, 50))
    monkeypatch.setattr(nearest, "STEP", 40)
    monkeypatch.setattr(nearest, "WAITING", 500)
    s = getattr(similar, score)
    names, targets = some_names(5, 60), sorted(set(some_names(6, 300))) + ["PAN " * 90]
    exact = np.array([similar.rounded(s.many([q] * len(targets), targets, None)) for q in names])
    q, r = nearest.Index(names), nearest.Index(targets)
    assert (nearest.tops(s, q, r, slice(None), slice(None)) >= exact - nearest._SLACK).all()
    ids = np.array(random.Random(1).sample(range(1000), len(targets)))
    search = nearest.Search(s, q, r, ids, np.zeros(len(names)))
    rows, columns = np.indices(exact.shape).reshape(2, -1)
    assert (search.closer(rows, columns) >= exact.ravel() - nearest._SLACK).all()
    best, found = nearest.searched(s, names, np.full(len(names), 70.0), targets, ids, False)
    for k in range(len(names)):
        top = exact[k].max()
        want = (top, ids[exact[k] == top].min()) if top >= 70 else (-1.0, None)
        assert (best[k], ids[found[k]] if found[k] >= 0 else None) == want


@pytest.mark.parametrize("score", [similar.name_score, similar.weighted, lookup.similarity])
def test_best_match_over_blocks(spark, monkeypatch, score):
    monkeypatch.setattr(nearest, "QUERIES", 20)
    monkeypatch.setattr(nearest, "NAMES", 50)
    monkeypatch.setattr(lookup, "FEW_NAMES", 0)
    names, targets = some_names(7, 80, 0), some_names(8, 200, 0)
    probe = spark.createDataFrame(list(enumerate([*names, None, "  "])), "key long, name string")
    registry = spark.createDataFrame([(900 - i, t) for i, t in enumerate([*targets, None])], "id long, label string")
    got = {r["key"]: (r["id"], r["score"]) for r in lookup.best_match(probe, "key", "name", registry, "id", "label", 75.0, score=score).collect()}
    clean = lambda t: " ".join(t.split()).upper()
    s, want = (similar.edits if score is lookup.similarity else score), {}
    for k, q in enumerate(map(clean, names)):
        pairs = [(clean(t), 900 - i) for i, t in enumerate(targets) if clean(t)]
        scores = similar.rounded(s.many([q] * len(pairs), [t for t, _ in pairs], None))
        if q and scores.max() >= 75:
            want[k] = (min(i for (_, i), x in zip(pairs, scores, strict=True) if x == scores.max()), float(scores.max()))
    assert got == want
    assert lookup.best_match(probe, "key", "name", registry.where("false"), "id", "label", 75.0, score=score).count() == 0


def test_parts_by_words_equal_brute_force(spark):
    from ledgerloom.plans.scopes import _offers

    typed, offers = (df.collect() for df in _offers(spark, SMALL))
    names = sorted({(r["name"].upper(), 0) for r in offers})
    least = {}
    for r in offers:
        least[r["name"].upper()] = min(r["id"], least.get(r["name"].upper(), r["id"]))
    targets = [t for t, _ in names]
    for query, score, threshold in (("fuzzy_parts_words", similar.name_score, 72), ("fuzzy_parts_weighted", similar.weighted, 75)):
        got = {r["key"]: (r["id"], r["score"]) for r in plans.queries()[query](spark, SMALL).collect()}
        for r in typed[:40]:
            x = similar.rounded(score.many([r["name"].upper()] * len(targets), targets, None))
            best = min(least[t] for t, s in zip(targets, x, strict=True) if s == x.max())
            assert got.get(r["key"]) == ((best, x.max()) if x.max() >= threshold else None)


def fill_by_hand(rows, columns):
    """rows of one process in order, as dicts with idx, number and the columns; each takes from the filled one before."""
    out = [dict(r) for r in rows]
    blank = lambda x: not (x or "").strip()
    for before, now in zip(out, out[1:], strict=False):
        if (now["idx"] is not None and now["idx"] == before["idx"]) or (blank(now["number"]) and not blank(before["number"])):
            for c in columns:
                if blank(now[c]) and not blank(before[c]):
                    now[c] = before[c]
    return [tuple("" if blank(r[c]) else r[c] for c in columns) for r in out]


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_chained_fill_equals_the_rule(spark, ranges):
    r = random.Random(ranges)
    rows = [(p, i, r.choice([None, i // 4, i // 7]), r.choice(["", "\t", None, "", f"n{i}"] if r.random() < 0.6 else [""]), r.choice(["", " ", None, f"p{i}"])) for p in range(4) for i in range(r.choice([1, 40, 120]))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "process int, pos int, idx int, number string, partner string")
    want = {}
    for p in range(4):
        mine = [{"idx": x[2], "number": x[3], "partner": x[4]} for x in rows if x[0] == p]
        want |= {(p, i): v for i, v in enumerate(fill_by_hand(mine, ["number", "partner"]))}
    for got in (order.fill_chained(df, ["number", "partner"], "idx", "number", ["process"], ["pos"], ranges), order.fill_from_previous(df, ["number", "partner"], "idx", "number", ["process"], ["pos"])):
        assert {(x["process"], x["pos"]): (x["number"], x["partner"]) for x in got.collect()} == want
    assert order.fill_chained(df.where("false"), ["number"], "idx", "number", ["process"], ["pos"]).count() == 0
    chain = spark.createDataFrame([(1, i, None, "A" if i == 0 else "") for i in range(4)], "process int, pos int, idx int, number string")
    assert [x["number"] for x in order.fill_chained(chain, ["number"], "idx", "number", ["process"], ["pos"]).orderBy("pos").collect()] == ["A"] * 4


def bill_by_hand(number, moves):
    """The id of the newest move that is the number, those with the very ref first."""
    bare = lambda t: "-".join(p.lstrip("0") or "0" for p in t.split("-"))

    def fits(m):
        if any(x and bare(x.strip()) == bare(number) for x in (m[1], m[2])):
            return True
        name = (m[3] or "").strip()
        return bool(name) and (bare(name).endswith(bare(number)) or "-" + bare(number) in bare(name))

    for some in ([m for m in moves if m[2] == number], moves):
        ids = [m[0] for m in some if m[2] == number or fits(m)]
        if ids:
            return max(ids)
    return None


def test_bills_are_found_by_name(spark):
    r = random.Random(5)
    number = lambda: r.choice(["0001-", "1-", "00001-", "12-"]) + r.choice(["123", "00000123", "0", "000", "89", "00000089"])
    moves = [(i, r.choice([1, 1, 2]), r.choice([None, "", number()]), r.choice([None, number()]), r.choice([None, "FA-A " + number(), "FC " + number(), "BILL/" + number() + "-7", "x-" + number() + "9"])) for i in range(60)]
    bills = [(100 + i, 1 + i % 3, number()) for i in range(40)] + [(200, 1, None), (201, None, "1-123"), (202, 1, " ")]
    present = spark.createDataFrame(moves, "id long, partner long, number string, ref string, name string")
    got = {x["bill"]: x["found"] for x in changes.same_bill(spark.createDataFrame(bills, "bill long, partner long, number string"), present).collect()}
    want = {b: bill_by_hand(n, [(m[0], m[2], m[3], m[4]) for m in moves if m[1] == p]) for b, p, n in bills if n and n.strip() and p}
    assert got == {b: i for b, i in want.items() if i is not None}
    one = spark.createDataFrame([(1, 5, "0001-123")], "bill long, partner long, number string")
    by_name = spark.createDataFrame([(9, 5, None, None, "FA-A 00001-00000123")], "id long, partner long, number string, ref string, name string")
    assert [tuple(x) for x in changes.same_bill(one, by_name).collect()] == [(1, 9, 1)]
    assert changes.same_bill(one, by_name.drop("name")).count() == 0


def test_conditions_as_a_tree(spark):
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else i % 7, i - 1 if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, kind string, n long, up long")
    ask = lambda *t, **h: {x["id"] for x in conditions.matching(df, t, h or None).collect()}
    assert ask() == set(range(40))
    assert ask("|", ("kind", "=", "a"), "&", ("n", ">", 3), ("id", "<", 20)) == {i for i, k, n, _ in rows if k == "a" or (n is not None and n > 3 and i < 20)}
    assert ask("!", "|", ("n", "=", None), ("kind", "in", ["b"]), ("id", ">", 5)) == {i for i, k, n, _ in rows if n is not None and k != "b" and i > 5}
    assert ask("!", ("id", "child_of", 10), id=(df, "id", "up")) == set(range(10))
    assert ask("|", ("id", "child_of", [38, 39]), ("up", "child_of", 36), id=(df, "id", "up"), up=(df, "id", "up")) == {37, 38, 39}
    for wrong in (("&", ("n", "=", 1)), ("x",)):
        with pytest.raises(ValueError):
            ask(*wrong)
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = conditions.matching(o, ["|", ("o_custkey", "=", 5), "!", ("o_totalprice", ">", 10.0)])._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(EqualNullSafe(o_custkey,5),LessThanOrEqual(o_totalprice,10.0))]" in plan


def test_scopes_of_long_chains_and_circles(spark, monkeypatch):
    jobs = []
    plain = lookup.cut
    monkeypatch.setattr(lookup, "cut", lambda df: jobs.append(1) or plain(df))
    chain = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    roots = spark.createDataFrame([(5,), (7000,)], "id long")
    assert {r["id"] for r in lookup.below(chain, "id", "up", roots, "id").collect()} == set(range(5, 1000)) and len(jobs) < 14
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (6, 5), (7, 70)], "id long, up long")
    root = spark.createDataFrame([(2,)], "id long")
    assert {r["id"] for r in lookup.below(circle, "id", "up", root, "id").collect()} == {1, 2, 3, 4}


def test_last_writes_of_late_and_repeated_edits(spark):
    folder = scratch(spark, "edits")
    steps = [[(1, 5, 1, "a", False), (2, 5, 2, "b", False)], [(1, 3, 3, "late", False), (2, 9, 4, "", True)], [(2, 7, 5, "older", False), (1, 5, 1, "a", False), (3, 1, 6, "c", False)], [(3, 1, 7, "d", False)]]
    shape = "k int, at long, n long, v string, gone boolean"
    read = lambda: spark.readStream.schema(shape).parquet(f"{folder}/in")
    for rows in steps:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        last = writes.last_writes(read().withColumnRenamed("gone", "deleted"), ["k"], "at", "n", F.col("deleted")).drop("deleted")
        writes.save(last, f"{folder}/out", f"{folder}/log").awaitTermination()
    schema = spark.createDataFrame([], "k int, at long, n long, gone boolean, v string")
    now = lambda: {(r["k"], r["v"]) for r in writes.current(spark, f"{folder}/out", schema, ["k"], "at", "n").collect()}
    assert now() == {(1, "a"), (3, "d")}
    again = spark.read.parquet(f"{folder}/out/batch=1")
    again.write.mode("overwrite").parquet(f"{folder}/copy")
    spark.read.parquet(f"{folder}/copy").write.mode("overwrite").parquet(f"{folder}/out/batch=1")  # a repeated batch
    assert now() == {(1, "a"), (3, "d")}
    assert writes.current(spark, f"{folder}/nothing", schema, ["k"], "at", "n").count() == 0


def test_rematch_computes_only_what_was_touched(spark):
    path, asked = f"{scratch(spark, 'rematch')}/t", []
    value = {i: i % 3 for i in range(50)}

    def compute(invoices):
        ids = [r["invoice"] for r in invoices.collect()]
        asked.append(len(ids))
        rows = [(i, v) for i in ids for v in range(value[i])]
        return spark.createDataFrame(rows, "invoice long, cand int")

    every = spark.range(50).select(F.col("id").alias("invoice"))
    assert rematch.start(every, compute, path, 4) == 50
    for touched, new in (([1, 2, 3], 2), ([7], 0), (list(range(0, 50, 2)), 0), (list(range(50)), 0), ([4], 1), ([], 9)):
        value.update(dict.fromkeys(touched, new))
        before = len(asked)
        assert rematch.rematch(every.where(F.col("invoice").isin(touched)), compute, path, 4) == len(touched)
        assert asked[before:] == ([len(touched)] if touched else [])
        want = {(i, v) for i in range(50) for v in range(value[i])}
        assert ({tuple(r) for r in rematch.stored(spark, path).collect()} if want else set()) == want


def test_pages_open_only_what_is_needed(spark):
    path = scratch(spark, "pages")
    df = spark.range(0, 2000, 2).select("id", (F.col("id") * 3).alias("x"), F.col("id").cast("string").alias("t"))
    assert paged.write_pages(df.repartition(3, F.rand(1)), path, "id", 100) == 10
    got = paged.read_pages(spark, path, 301, 520)
    assert sorted(r["id"] for r in got.collect()) == list(range(302, 520, 2)) and got.rdd.getNumPartitions() <= 3
    assert [r["id"] for r in paged.read_pages(spark, path, descending=True, limit=7).collect()] == list(range(1998, 1984, -2))
    assert [r["id"] for r in paged.read_pages(spark, path, 777, limit=3).select("id").collect()] == [778, 780, 782]
    assert paged.read_pages(spark, path, descending=True, limit=7).rdd.getNumPartitions() == 1
    assert sorted(r["x"] for r in paged.read_pages(spark, path).where("id in (4, 1000) or x = 60").collect()) == [12, 60, 3000]
    reader = paged.PagedSource({"path": path, "limit": "150"}).reader(df.schema)
    assert len(reader.partitions()) == 2


def fit_by_hand(code, q, r):
    """line_fit without quantities, by the plain scores."""
    clean = lambda t: " ".join(t.split()).upper()
    if not clean(r):
        return 0.0
    k, n = clean(code), clean(r)
    if k and k not in ("1", "NO DISPONIBLE", "NONE", "NULL") and (k in n or n in k):
        return 100.0 if k == n else 92.0
    d = clean(q)
    seen = d.translate(str.maketrans("015", "OIS"))
    first, second = (round(similar.token_set_ratio(t, n), 4) for t in (d, seen))
    if first >= 80 or second >= 80:
        return first if first >= 80 else second
    return max(first, second, *(round(similar.partial_ratio(t, n), 4) for t in (d, seen)))


def test_orders_are_ranked_by_the_score_of_their_lines(spark):
    from ledgerloom.operators import purchase

    r = random.Random(9)
    names = ["ACERO VERDE", "VERDE ACERO 12", "TORNILLO ROJO", "T0RNILLO", "PINTURA", "PINTURAS AZULES", "CABLE"]
    i = [(v, v % 2, line, r.choice(["", "", "CABLE"]), r.choice(names), 3.0) for v in range(8) for line in range(r.randrange(1, 5))]
    o = [(100 + k, k % 2, n, r.choice([*names, ""]), r.choice([3.0, 4.0])) for k in range(10) for n in range(r.randrange(1, 4))]
    got = purchase.fitted_rank(spark.createDataFrame(i, "invoice long, partner long, line int, code string, name string, qty double"), spark.createDataFrame(o, "order long, partner long, po_line int, name string, qty double"))
    from ledgerloom.functions import text

    words = {(a, b): f for a, b, f in _holds(spark, text, [x[4] for x in i], [x[3] for x in o])}
    want = set()
    for v in {x[0] for x in i}:
        mine, rows = [x for x in i if x[0] == v], []
        for order_ in {x[0] for x in o if x[1] == v % 2}:
            best = [max(max(fit_by_hand(x[3], x[4], y[3]), 75.0 if y[3] and words[x[4], y[3]] and fit_by_hand(x[3], x[4], y[3]) < 75 else 0.0) for y in o if y[0] == order_) for x in mine]
            good = [s for s, x in zip(best, mine, strict=True) if s >= (75 if x[3] else 70)]
            rows.append((-len(good), -round(sum(good), 1), order_))
        want |= {(v, x[2], -x[0], -x[1], n) for n, x in enumerate(sorted(rows), 1)}
    assert {(x["invoice"], x["order"], x["matched"], x["score"], x["nth"]) for x in got.collect()} == want


def _holds(spark, text, queries, names):
    """Whether any word of a name (read as letters) holds one of the other, for all pairs."""
    rows = spark.createDataFrame([(a, b) for a in set(queries) for b in set(names)], "q string, r string")
    words = [text.tokens(text.repair_scan(F.col("q"))), text.tokens(text.label_key(F.col("r")))]
    return [tuple(x) for x in rows.select("q", "r", F.exists(words[0], lambda a: F.exists(words[1], lambda b: a.contains(b) | b.contains(a)))).collect()]


def test_plan_reaches_the_wanted_state(spark):
    from ledgerloom.operators import sync

    rows = spark.createDataFrame(
        [
            (1, 0, 7, 3, "1-1", "2/1/2024", "", "bolt", 2, 10, 5, None, 40, 900, "P7", "", True, True),
            (1, 1, None, None, "", "", "", "nut", -1, None, None, None, 41, 900, "P8", "", False, True),
            (1, 2, None, None, "", "", "", " ", None, 3, 6, None, None, 999, "", "", False, True),
            (2, 0, 8, 3, "", "", "", "pin", 1, 1, None, None, 40, None, "", "", False, True),
        ],
        "invoice long, pos int, partner long, journal long, number string, date string, due string, name string, qty int, price int, product long, unit long, account long, po_line long, order_name string, chosen string, overwrite boolean, is_content boolean",
    )
    state = sync.State(
        spark.createDataFrame([(1, 7, 2, None, "2024-01-02", None, "old"), (2, 8, 3, "kept", None, None, "old")], "invoice long, partner long, journal long, number string, date string, due string, origin string"),
        spark.createDataFrame([(1, 12, 1, "bolt", 2, 9, None, 40, None), (1, 11, 2, "nut", 1, 0, 77, 40, 900), (1, 13, 3, "x", 1, 3, 6, None, 999), (2, 21, 1, "pin", 1, 1, None, 40, None)], "invoice long, id long, sequence int, name string, qty int, price int, product long, account long, po_line long"),
        spark.createDataFrame([(1, 31, 63, 5), (1, 32, 70, 4)], "invoice long, id long, tax_id int, amount int"),
        spark.createDataFrame([(900, 3)], "po_line long, price int"),
    )
    money = lambda df, *names: df.withColumns({c: F.col(c).cast("decimal(20,6)") for c in names})
    state = sync.State(state.bills, money(state.lines, "qty", "price"), money(state.taxes, "amount"), money(state.orders, "price"))
    expected = spark.createDataFrame([(1, 63, 9), (1, 70, 4), (1, 81, 2)], "invoice long, tax_id int, amount int")
    plan, left = sync.pending(rows, expected, state, ["partner", "journal", "number", "date", "due"])
    got = {(r["invoice"], r["step"], r["target"], r["field"], r["value"].rstrip("0").rstrip(".") if "." in r["value"] else r["value"]) for r in plan.collect()}
    assert got == {
        (1, 0, "bill", "journal", "3"), (1, 0, "bill", "number", "1-1"), (1, 0, "bill", "due", "2024-01-02"), (1, 0, "bill", "origin", "P7, P8"), (2, 0, "bill", "origin", ""),
        (1, 2, "12", "price", "10"), (1, 2, "12", "product", "5"), (1, 2, "11", "account", "41"), (1, 2, "13", "name", "Línea importada"),
        (1, 3, "12", "po_line", "900"), (1, 3, "11", "po_line", ""), (1, 3, "13", "po_line", ""), (1, 5, "900", "price", "10"), (1, 6, "31", "amount", "9"),
    }
    assert left.count() == 0
    after = sync.replayed(state, plan)
    assert {tuple(r) for r in after.lines.select("id", "price", "po_line").collect()} == {(12, 10, 900), (11, 0, None), (13, 3, None), (21, 1, None)}
    assert after.orders.first()["price"] == 10 and {r["amount"] for r in after.taxes.collect()} == {9, 4}
    assert sync.replayed(state, plan.where("false")).lines.collect() == state.lines.collect()
