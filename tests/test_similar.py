"""The scorers against plain definitions, and the queries that use them against brute force."""

from __future__ import annotations

import random
from functools import cache

import pytest

from ledgerloom.functions import similar
from ledgerloom import plans

FOLDER = "/root/testdata/sf0.001"


def plain_common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@cache
def plain_score(a: str, b: str) -> float:
    def share(x: str, y: str) -> float:
        return 200.0 * plain_common(x, y) / (len(x) + len(y)) if x or y else 100.0

    x, y = set(a.split()), set(b.split())
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    words = max(share(f"{both} {one}".strip(), f"{both} {two}".strip()), share(both, f"{both} {one}".strip()) if both else 0, share(both, f"{both} {two}".strip()) if both else 0)
    pairs = [(a, b), (b, a)] if len(a) == len(b) else [(min(a, b, key=len), max(a, b, key=len))]
    run = max(share(s, t[i:j]) for s, t in pairs for i in range(len(t)) for j in range(i + 1, len(t) + 1) if j - i == len(s) or (j - i < len(s) and (i == 0 or j == len(t))))
    return round(max(round(words, 4), 0.55 * round(words, 4) + 0.45 * round(run, 4)), 4)


def test_common_equals_plain():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(2))
        assert similar.common(a, b) == plain_common(a, b)


@pytest.mark.parametrize(("f", "a", "b", "want"), [(similar.token_set_ratio, "PAN FRANCES", "FRANCES PAN X", 100.0), (similar.token_set_ratio, "", "A", 0.0), (similar.partial_ratio, "PAN", "ALM-PAN FRANCES", 100.0), (similar.partial_ratio, "", "A", 0.0), (similar.partial_ratio, "ABCD", "XBCX", 200 * 2 / 7), (similar.token_set_ratio, "AB", "AC", 50.0)])
def test_scores(f, a, b, want):
    assert f(a, b) == pytest.approx(want)


def test_registry_match_equals_brute_force(spark):
    got = {r["key"]: (r["id"], r["score"]) for r in plans.queries()["fuzzy_words_top1"](spark, FOLDER).collect()}
    n = spark.read.parquet(f"{FOLDER}/nation.parquet").collect()
    names = {r["n_nationkey"]: r["n_name"].upper() for r in n}
    want = {}
    for c in spark.read.parquet(f"{FOLDER}/customer.parquet").collect():
        wrong = names[c["c_nationkey"]].replace("A", ("A", "E", "")[c["c_custkey"] % 3])
        typed = f"{wrong} {c['c_mktsegment']}".upper()
        score, best = max((plain_score(typed, v), -k) for k, v in names.items())
        if score >= 72:
            want[c["c_custkey"]] = (-best, score)
    assert got == want


def test_line_fit(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.purchase import best_order_line, line_fit

    rows = [("X1", "", None, "X1", 1, 100.0), ("X1", "", None, "bolt x1 b", 1, 92.0), ("", "PAN", None, "ALM-PAN FRANCES", 1, 100.0), ("", "CHOCL0 NEGRO", None, "CHOCLO", 1, 100.0), ("", "QQ", 5.0, "ZZ", 5, 55.0), ("", "QQ", 4.0, "ZZ", 5, 0.0), ("", "QQ", 4.0, "", 4, 0.0), (None, None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "code string, d string, qty double, name string, ordered long, want double")
    got = df.select(line_fit(F.col("code"), F.col("d"), F.col("qty"), F.col("name"), F.col("ordered")).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]
    i = spark.createDataFrame([(1, 9, 0, None, "RED BOLT", 2.0), (1, 9, 1, None, None, 3.0)], "invoice long, partner long, line int, code string, name string, qty double")
    o = spark.createDataFrame([(5, 9, 1, "BOLT RED", 1.0), (4, 9, 2, "RED BOLT", 1.0), (3, 8, 1, "RED BOLT", 1.0)], "order long, partner long, po_line int, name string, qty double")
    assert [tuple(r) for r in best_order_line(i, o).collect()] == [(1, 0, 4, 2, 100.0)]


def test_every_line_takes_one_order_line_of_its_partner(spark):
    rows = plans.queries()["po_line_match"](spark, FOLDER).collect()
    partner = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()}
    assert rows and len({(r["invoice"], r["line"]) for r in rows}) == len(rows)
    assert all(partner[r["invoice"]] == partner[r["order"]] and r["score"] >= 70 for r in rows)
