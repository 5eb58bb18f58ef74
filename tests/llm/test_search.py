"""Ranked search against brute force, odd rows, and every way in which its work is cut."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quiltgraph.llm import search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    """Every score of every item and document, in Python's integers.  docs: (id, text); items: (id, text)."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    many, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * k + 1))) for t, k in df.items()}
    asked: dict = {}
    for i, text in items:
        asked.setdefault(i, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * many) // words
            score = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in query.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(found[:top])]
    return sorted(out, key=str)


def ranked(docs, items, **options):
    return sorted((tuple(r) for r in search.rank_documents(docs, items, **options).collect()), key=str)


def test_small_tables_against_brute_force(spark, tiny):
    docs, items = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert len(want) > 100
    assert ranked(docs, items) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    assert sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({search.ORACLE_SQL})").fetchall(), key=str) == want


@pytest.mark.parametrize("limits", [{}, {"CHUNK_PAIRS": 4, "SORTED": 3}, {"CHUNK_PAIRS": 7, "HELD_BYTES": 10}])
def test_odd_rows_ties_and_cut_work(spark, odd, odd_rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    asked = [(1, "two WORDS again"), (2, None), (3, ""), (4, "!!!"), (5, "absent everywhere"), (1, "same same text"), (None, "one no id"), (7, "word7 thé1 漢字 again one words licensed"), (8, "word1 word7 word14 word21")]
    items = spark.createDataFrame([(i, t, "clash") for i, t in asked], "item_id bigint, text string, doc_id string")
    assert ranked(odd, items) == plain([(r[0], r[1]) for r in odd_rows], asked)


def test_ties_by_id_and_copies(spark):
    rows = [(i, "alpha beta") for i in range(50, 0, -1)] + [(7, "alpha beta"), (60, "alpha gamma gamma"), (61, "delta")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    items = spark.createDataFrame([("a", "alpha"), ("b", "delta gamma")], "item_id string, text string")
    assert ranked(docs, items) == plain(rows, [("a", "alpha"), ("b", "delta gamma")])
    assert ranked(docs, items, top=3) == plain(rows, [("a", "alpha"), ("b", "delta gamma")], 3)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert ranked(none, items) == []
    assert ranked(odd, items.limit(0)) == []
    assert ranked(odd.where("text is null"), items) == []


def test_radix_order_and_sums():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 40, 5000) >> rng.integers(0, 40, 5000)
    assert (search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    items, docs, impacts = rng.integers(0, 9, 3000), rng.integers(0, 70, 3000), rng.integers(1, 1 << 40, 3000)
    want: Counter = Counter()
    for i, d, v in zip(items.tolist(), docs.tolist(), impacts.tolist(), strict=True):
        want[i, d] += v
    a, b, s = search.accumulate(items, docs, impacts)
    assert list(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == [(*k, v) for k, v in sorted(want.items())]
    assert all(len(x) == 0 for x in search.accumulate(items[:0], docs[:0], impacts[:0]))
