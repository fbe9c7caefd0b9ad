"""The source divergence audit against plain Python, in one block and in many."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from twinreport.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def expected(rows):
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for t, la, so in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        there = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w in there if there[w] >= 3)
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in set(kept))
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        price = lambda p, q: (p - q) ** 2 // q
        for g in count:
            pairs = [(-sum(price(share(count[g], w), share(count[h], w)) for w in kept), h) for h in count if h != g]
            terms = [(-price(share(count[g], w), share(whole, w)), w) for w in kept if count[g][w] and share(count[g], w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, g, part, item, -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def made(n, n_sources, seed=1):
    r = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10 % 5]}" for i in range(50)] + ["É", "ß-x", "Ab", "aB", "and"] * 3
    rows = [(" ".join(r.choices(words, k=r.choice([0, 2, 9, 60]))), r.choice(["en", "de"]), f"s{int(r.random() ** 2 * n_sources)}") for _ in range(n)]
    return rows + [(None, "en", "only nulls"), ("lonely", "xx", None), ("lonely", "xx", "b"), ("", None, "c"), ("and " * 2000, "en", "s0"), rows[0], rows[0]]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, la, so, 1, "x") for i, (t, la, so) in enumerate(rows)], SCHEMA)
    return [tuple(r) for r in divergence.source_divergence(df).collect()]


@pytest.mark.parametrize("sizes", [{}, {"GROUPS": 3, "CELLS": 300, "ROWS": 5, "SENT": 0}])
def test_against_plain_python(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(divergence, k, v)
    rows = made(150, 12)
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == expected(rows)


def test_counts_are_sent_on_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = made(40, 3)
    assert set(run(spark, rows)) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_product_of_one_hot_columns_is_the_sum_over_terms(monkeypatch):
    r = np.random.default_rng(1)
    left, right = r.geometric(0.1, (700, 4)) - 1, r.geometric(0.02, (700, 3)) - 1
    ls, rs = left.sum(axis=0).tolist(), right.sum(axis=0).tolist()
    share = lambda c, n: 1 + 10**9 * (int(c) + 1) // (n + 900)
    for cells in (1, 2000, 1 << 20):
        monkeypatch.setattr(divergence, "CELLS", cells)
        there, back = divergence.joint_prices(left, right, ls, rs, 900)
        for x in range(4):
            for y in range(3):
                p = [(share(a, ls[x]), share(b, rs[y])) for a, b in zip(left[:, x], right[:, y], strict=True)]
                assert there[x, y] == sum((a - b) ** 2 // b for a, b in p) and back[x, y] == sum((a - b) ** 2 // a for a, b in p)
