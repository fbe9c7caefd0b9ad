"""Phrase collocation mining against plain Python; the trie against counting by loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from twinreport.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, h1 long, n long"


def pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def expected(rows):
    grams = {}
    for text, lang in rows:
        f = grams.setdefault(lang or "und", Counter())
        for w in pieces(text):
            f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in grams.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        longer = Counter()
        for g, c in f.items():
            if len(g) == 3 and c >= 10:
                for inner in (g[:2], g[1:]):
                    longer[inner] = max(longer[inner], c)
        found = []
        for g, a in f.items():
            if len(g) > 1 and a >= 10 and not (len(g) == 2 and 100 * longer[g] >= 50 * a and longer[g]):
                s, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:2000])}
    return out


def made(n=200, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "Is", "is", "É", "new", "york", "city", "a-b", "#1", "𝔘", " x", "san", "jose"] + [f"r{i}" for i in range(300)]
    weights = [30] * 14 + [1] * 300
    fixed = ["New York City", "new york", "san jose", "of the", "the  of\tthe"]
    text = lambda: "".join(r.choice(fixed if r.random() < 0.3 else r.choices(words, weights, k=4)) + r.choice([" ", " ", " ", ". ", ",", "\n", "\x0b", "?"]) for _ in range(r.choice([0, 3, 40, 150])))
    return [(text(), r.choice(["en", "de", None])) for _ in range(n)] + [(None, "en"), ("", None), ("x " * 5000 + "y", "zz"), ("\r\n;;", "de")]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, la, 1, 2) for i, (t, la) in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in co.collocations(df, **more).collect()}


@pytest.mark.parametrize("sizes", [{}, {"SLAB": 500, "WORDS": 60, "HELD": 40, "SHARD": 50, "BITS": 256}])
def test_against_plain_python(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(co, k, v)
    rows = made()
    assert run(spark, rows, **({"part": 30} if sizes else {})) == expected(rows)


def test_hashes_that_two_words_share_lead_to_another_seed(spark, monkeypatch):
    rows = [("alpha beta gamma. " * 12, "en"), ("delta beta. " * 15, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    counts = co.word_counts(df, 0)
    clashing = counts.selectExpr("lang", "word", "if(word IN ('alpha', 'delta'), 77, h) AS h", "n")
    monkeypatch.setattr(co, "word_counts", lambda docs, seed: clashing if seed == 0 else counts)
    assert co.vocabulary(df)[1] == 1


def test_no_rows_and_no_candidates(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a b c", "en"), (None, None)]) == set()


@pytest.mark.parametrize("n_words,n_phrases,hot", [(3, 5, 0), (40, 300, 30), (5000, 4000, 3000), (2, 1, 0)])
def test_trie(n_words, n_phrases, hot):
    r = np.random.default_rng(n_words)
    words = np.sort(r.choice(2**62, n_words, replace=False).astype(np.uint64) + np.uint64(2**63))
    pick = lambda n: words[r.integers(0, n_words, n)]
    h = np.stack([pick(n_phrases), pick(n_phrases), np.where(r.random(n_phrases) < 0.5, pick(n_phrases), np.uint64(0))], axis=1)
    h[:hot, 0] = words[0]  # one word with many continuations
    h = np.unique(h, axis=0)
    trie = co.Trie(h)
    used = np.flatnonzero(trie.check >= 0)
    assert len(set(trie.accepts.tolist())) == len(h) and (trie.base[trie.check[used]] <= used).all()
    row = np.unique(np.append(words[: n_words // 2 + 1], r.choice(2**62, 5).astype(np.uint64)))
    codes = np.concatenate([r.integers(0, len(row) + 1, 4000), [0, 0]]).astype(np.int32)
    near = h[np.isin(h, np.append(row, np.uint64(0))).all(axis=1)]  # some that are surely there
    codes[: 4 * len(near[:900])] = np.concatenate([np.append(np.where(x == 0, 0, np.searchsorted(row, x) + 1), 0) for x in near[:900]] or [np.zeros(0)]).astype(np.int32)
    got = np.bincount(np.concatenate(trie.states(row, codes)), minlength=len(trie.base))[trie.accepts]
    text = [0 if c == 0 else int(row[c - 1]) for c in codes]
    want = Counter((*text[i : i + k], *([0] * (3 - k))) for i in range(len(codes) - 2) for k in (2, 3) if all(text[i : i + k]))
    assert got.tolist() == [want[tuple(map(int, x))] for x in h]
    assert got.sum() > 0 or n_words == 2
