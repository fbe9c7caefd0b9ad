"""The model of the quality rules as a table: grows with the n-grams, and its cuts by language."""

import random

import numpy as np
import pytest
import xxhash

from twinreport.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string"


def prose(r, lang, n):
    return " ".join(lang + r.choice("abcdefgh") + r.choice("klmnopqr") + r.choice("stuvwxyz") for _ in range(n))


def hashed(words, buckets):
    """The buckets of all n-grams of a text."""
    xx = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    h = [xx(w.encode()) for w in words]
    pairs = [xx(b.to_bytes(8, "little"), xx(a.to_bytes(8, "little"))) for a, b in zip(h, h[1:], strict=False)]
    return [(x - (1 << 64) if x >> 63 else x) % buckets for x in h + pairs]


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean and bad documents of three languages; those of 'z' have no trusted label."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(360):
        lang, bad, known = "xyz"[i % 3], i % 9 > 6, i % 2 == 0
        text = prose(r, lang, 120)
        if bad:
            text = " ".join(w + "&&&" if r.random() < 0.7 else w for w in text.split())
        rows.append((i, text, lang))
        if known and (bad or lang != "z"):
            labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), labels


def test_clean_documents_without_labels_are_kept(corpus):
    docs, labels, known = corpus
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    known = dict(known)
    for i, r in got.items():
        clean = i % 9 <= 6
        if "xyz"[i % 3] == "z":
            assert r.kept, i  # nothing trusted to compare with
        elif i not in known:
            assert r.kept == clean, (i, r.score)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_routing_does_not_change_scores(corpus, monkeypatch):
    docs, labels, known = corpus
    default = sorted(map(str, quality_rules.quality_rules(docs, labels).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST", 1)
    monkeypatch.setattr(quality_rules, "BITS", 64)
    monkeypatch.setattr(quality_rules, "LANGUAGES", 0)
    assert sorted(map(str, quality_rules.quality_rules(docs, labels).collect())) == default


def test_own_scores_leave_out_a_documents_own_counts(corpus):
    docs, labels, known = corpus
    buckets, rows, low = 64, docs.collect(), dict(known)
    grams = {r.doc_id: hashed(r.text.split(), buckets) for r in rows}
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw += np.bincount(grams[r.doc_id], minlength=buckets)
        good += np.bincount(grams[r.doc_id], minlength=buckets) * (low.get(r.doc_id) == 1)
    labelled, _ = quality_rules.labelled_counts(docs, labels, buckets)
    got = quality_rules.own_scores(labelled, quality_rules.Model(docs, labelled, buckets)).collect()
    want = []
    for i, q in known:
        own = np.bincount(grams[i], minlength=buckets) * q
        n, total = len(grams[i]), good.sum()
        want.append(sum(np.rint(np.log(((good[g] - own[g]) * raw.sum() / raw[g] + total) / (2 * total)) * 1024) for g in grams[i]) / 1024 / n + q * np.log(2 * total / (2 * total - n)))
    assert np.allclose(sorted(r.own for r in got), sorted(want), atol=2e-3)


def test_buckets_grow_with_the_corpus(spark):
    sizes = [quality_rules.bucket_count(spark.range(n).selectExpr("repeat('x', 1000000) AS text")) for n in (0, 1, 256, 1024)]
    assert sizes == [1 << 14, 1 << 14, 1 << 17, 1 << 18]
