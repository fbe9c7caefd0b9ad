"""License scans, packing, token counts, mixing, quality rules, personal data, against brute force and on odd tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinreport.llm import license_scan, mixing, packing, pii, quality_rules, token_counts
from twinreport.llm.tokens import ChunkTokenizer, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string"
ODD = [
    (1, None, None, None, None, "x", "y", "z"),
    (2, "", "en", "a", 0, "x", "y", "z"),
    (None, "no id but words", "en", "a", 0, None, None, None),
    (3, "word " * 20000 + "\n\n\x0b tail", "en", "b", 0, "x", "y", "z"),
    (4, "tie one two three tie one two three", "en", "b", 0, "x", "y", "z"),
    (4, "tie one two three tie one two three", "en", "b", 0, "x", "y", "z"),
    (5, "é" * 70000, "fr", None, 0, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def prose(spark):
    r = random.Random(2)
    words = ["the", "of", "and", "Kiesel", "über", "run", "1.2.3.4", "a,b", "x***", "|", "don't"]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", ".", ",", "\n", "\t"]) for _ in range(r.randint(0, 300))), "en", f"s{i % 4}", 0, None, None, None) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_base_and_fuzzy(spark):
    rows = [
        (1, "All Rights, reserved! CC-BY. all rights reserved"),
        (2, "Lisensed under the Apache Licence, Version 2.0"),
        (3, "Lizenz: GNU General\nPublic LICENSE. Licensed under CC BY-NC 4.0."),
        (4, "all rightsreserved; general public licenses; ccby"),
        (5, "é Released under teh MIT Licence é"),
        (6, "nothing to see here " * 50),
    ]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (8, 3, 0, 5, "cc-by,reserved")
    assert got[2].labels == "apache-2.0" and got[2].n_base == 0 and 0.8 < got[2].score < 1
    s = got[2].spans[0]
    assert rows[1][1][s.start : s.end] == "Lisensed under the Apache Licence, Version 2.0" and s.edits == 2
    assert got[3].base_labels == "cc-by,gpl" and "cc-by-nc" in got[3].labels
    assert got[4].n_base == 0 and got[6].labels == "" and got[6].score == 0
    assert got[5].labels == "mit" and rows[4][1][got[5].spans[0].start :].startswith("Released")


def test_license_spans_are_complete():
    """Pigeonhole: every text within the edits is found. Brute force: the pattern over the whole text."""
    r = random.Random(5)
    n = license_scan.Notice("released under the mit license", "mit")
    for _ in range(300):
        t = list(n.text)
        for _ in range(r.randint(0, n.edits)):
            i = r.randrange(len(t))
            op = r.random()
            t[i : i + 1] = [] if op < 0.3 else [r.choice("xyzé")] if op < 0.7 else [t[i], r.choice("xyzé")]
        raw = license_scan.normalised("vor é wort " + "".join(t) + " nach é wort")
        assert bool(n.spans(raw)) == bool(n.pattern.search(raw.decode()))


def test_license_ties_and_many_hits():
    found = [("a", 0, 10, 1), ("b", 0, 10, 1), ("c", 5, 12, 0), ("d", 12, 20, 2), ("e", 11, 30, 2)]
    assert license_scan.best(found) == [("c", 5, 12, 0), ("d", 12, 20, 2)]
    r = random.Random(6)
    for _ in range(200):
        found = [(0, a := r.randint(0, 60), a + r.randint(1, 12), r.randint(0, 2)) for _ in range(20)]
        want: list = []
        for x in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in want):
                want.append(x)
        assert license_scan.best(found) == sorted(want, key=lambda x: x[1])
    each = license_scan.scan([license_scan.Notice(t, x) for t, x in license_scan.NOTICES.items()], license_scan.BASE)
    text = "all rights reserved. " * 100_000
    started = time.monotonic()
    got = next(each({"doc_id": [1], "text": [text]}))
    assert time.monotonic() - started < 10
    assert (got["n_base"], len(got["spans"][0])) == ([100_000], 100_000)
    assert [(s["start"], s["first_word"]) for s in got["spans"][0][-2:]] == [(21 * 99_998, 3 * 99_998), (21 * 99_999, 3 * 99_999)]


def test_license_odd(odd):
    got = license_scan.digest(license_scan.license_scan(odd)).collect()
    assert len(got) == len(ODD) and sum(r.doc_id is None for r in got) == 1
    assert {r.n_words for r in got if r.doc_id in (1, 2)} == {0}
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_pii_base_against_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    out.append((kind, *m.span()))
        return out

    r = random.Random(1)
    for _ in range(8000):
        t = "".join(r.choice("1234567890a@@.. -+()%é") for _ in range(r.randint(0, 45)))
        assert brute(t) == pii.base_spans(t), t
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"x {card}.")[0] == ("card", 2, 21)


def test_pii_candidates_and_redaction(spark, odd):
    text = 'mail a.b@c.de or ann (at) site.org, token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", ssn 123-45-6789, call (415) 555-1234, commit 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e'
    fitted = pii.model()
    base, spans = pii.spans_of(text, fitted)
    found = {(k, text[a:b]) for k, a, b in spans}
    assert base == [("email", 5, 13)] and set(base) <= set(spans)
    assert {("email", "ann (at) site.org"), ("ssn", "123-45-6789"), ("phone", "(415) 555-1234")} <= found
    assert sum(k == "secret" for k, *_ in spans) == 1
    ordered = sorted(spans, key=lambda s: s[1])
    assert all(a[2] <= b[1] for a, b in zip(ordered, ordered[1:], strict=False))
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    df = spark.createDataFrame([(1, "x +1 (743) 555-3824 y", 21, 7), (2, None, None, 8)], "doc_id long, text string, n_chars long, spans int")
    red = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert red[1].text == "x [PHONE] y" and red[1].n_chars == 11 and red[1].spans == 7 and red[2].text is None
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_tokenizer_is_exact():
    t = ChunkTokenizer(default_path())
    r = random.Random(3)
    letters = "aB é.,'s'T0٣½ \n\t  *#<|endoftext|>ΣİǅⅧ中—-\r\x0b_’"
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(t.ids([x])[0], "<u4").tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing(prose, odd):
    t = ChunkTokenizer(default_path())
    for docs in (prose, odd):
        pieces = packing.digest(packing.pack_documents(docs)).collect()
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = {}
        for i, x in rows:
            want.setdefault(i, []).append(t.ids([x])[0] + (2).to_bytes(4, "little"))
        assert {p.doc_id for p in pieces} == set(want)
        for i, texts in want.items():
            own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
            assert sum(p.length for p in own) == sum(len(x) // 4 for x in texts)
            if len(texts) == 1:
                at = 0
                for p in own:
                    assert p.start == at and p.doc_tokens == len(texts[0]) // 4
                    assert p.ids_crc32 == zlib.crc32(texts[0][4 * at : 4 * (at + p.length)])
                    at += p.length
        sequences = {}
        for p in pieces:
            sequences.setdefault(p.sequence_id, []).append(p)
        for own in sequences.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 4096 and at & (at - 1) == 0 and {p.context_size for p in own} == {at}
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_step_groups_balance():
    costs = [random.Random(i).randint(1, 1000) for i in range(640)]
    groups = packing.serpentine(costs, 64, 5)
    sums = np.bincount(groups, costs)
    assert np.bincount(groups).tolist() == [10] * 64 and sums.max() < 1.1 * sums.min()


def test_token_counts(spark, prose, odd):
    t = ChunkTokenizer(default_path())
    for docs in (prose, odd):
        lengths = sorted(len(t.ids([r.text or ""])[0]) // 4 for r in docs.collect())
        sums = token_counts.suffix_sums(token_counts.length_counts(docs), block=16).persist()
        for r in sums.collect():
            n = r.length
            assert r.n_docs == lengths.count(n) and r.docs_from == sum(x >= n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
            assert r.kept_tokens == sum(min(x, n) for x in lengths) and r.lost_tokens == sum(lengths) - r.kept_tokens and r.docs_over == sum(x > n for x in lengths)
        for limit in (0, 7, 100, 10**6):
            got = token_counts.answer(sums, limit)
            assert got == {"documents": len(lengths), "tokens": sum(lengths), "docs_over": sum(x > limit for x in lengths), "kept_tokens": sum(min(x, limit) for x in lengths)}
        for q in (0.1, 0.5, 1.0):
            assert token_counts.quantile(sums, q) == lengths[max(0, int(np.ceil(q * len(lengths))) - 1)]
    empty = token_counts.token_counts(odd.limit(0))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5) is None and token_counts.answer(empty, 5)["tokens"] == 0


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, prose, odd):
    for docs in (prose, odd):
        rows = docs.collect()
        got = mixing.mix(docs).collect()
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
        target = brute_targets(sizes)
        assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), words(r.text)) for r in rows)
        for s in sizes:
            own = [r for r in got if r.source == s]
            assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r["size"] for r in own)
            assert abs(sum(r.taken for r in own) - target[s]) < 1.5
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
        # The stream in order of finish time, truncated at the budget, gives the same words but for the documents at the cut.
        stream, served = [], {}
        for r in sorted(got, key=lambda r: r.first_finish):
            weight = r["size"] / max(r.first_finish - served.get(r.source, 0.0), 1e-9)
            served[r.source] = r.first_finish
            if r["size"]:
                stream += [(r.first_finish + p * r.source_size / round(weight), r["size"], r.source) for p in (0, 1)]
        rest, cut = 1.5 * sum(sizes.values()), {}
        for _, n, source in sorted(stream, key=lambda x: x[0]):
            cut[source] = cut.get(source, 0) + min(n, max(rest, 0))
            rest -= n
        largest = {s: max([r["size"] for r in got if r.source == s]) for s in sizes}
        assert all(abs(cut.get(s, 0) - sum(r.taken for r in got if r.source == s)) <= sum(largest.values()) for s in sizes)
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        by_source = {}
        for r in mixed.collect():
            by_source[r.source] = by_source.get(r.source, 0) + words(r.text)
        assert all(abs(by_source.get(s, 0) - target[s]) <= largest[s] for s in sizes)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_rows_without_ids_are_spread(spark):
    rows = spark.createDataFrame([(None, f"a b {i}", "s") for i in range(500)], "doc_id long, text string, source string")
    served = mixing._served(rows, mixing.WEIGHTS, mixing.SHARE, mixing.PASSES, 1, mixing.SEED, False)
    assert served.select("__bucket").distinct().count() == 16


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def test_quality_rules(spark, prose, odd):
    def windows(w):
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})

    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 100, 2)] + [(4, 1), (6, None)], "doc_id long, quality int")
    buckets = 256
    for docs in (prose, odd):
        rows = docs.collect()
        model = quality_rules.Model(docs, quality_rules.labelled_counts(docs, labels, buckets)[0], buckets)
        split = {id(r): re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows}
        low = {}
        for r in labels.filter("quality IS NOT NULL").collect():
            low[r.doc_id] = min(low.get(r.doc_id, 1), r.quality)

        def grams(w):
            h = [xx(x.encode()) for x in w]
            pairs = []
            for a, b in zip(h, h[1:], strict=False):
                first = xx(a.to_bytes(8, "little"))
                pairs.append(xx(b.to_bytes(8, "little"), first))
            return [(x - (1 << 64) if x >> 63 else x) % buckets for x in h + pairs]

        raw, good = np.zeros(buckets), np.zeros(buckets)
        for r in rows:
            c = np.bincount(grams(split[id(r)]), minlength=buckets)
            raw += c
            good += c * (low.get(r.doc_id) == 1)
        counts = {x.bucket: (x.r, x.g) for x in model.table.collect()}
        assert counts == {i: (int(raw[i]), int(good[i])) for i in range(buckets) if raw[i]}
        prior = max(good.sum(), 1)
        ratio = np.rint(np.log((good * raw.sum() / np.maximum(raw, 1) + prior) / (good.sum() + prior)) * quality_rules.UNIT)
        got = quality_rules.quality_rules(docs, labels, buckets, -0.02).collect()
        assert len(got) == len(rows)
        seen = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
        want = []
        for r in rows:
            w, t = split[id(r)], r.text or ""
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            rep = windows(w)
            want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
        assert seen == sorted(want)
        scores = {r.doc_id: r for r in got}
        for r in rows:
            w = split[id(r)]
            if w and r.doc_id is not None:
                s = sum(ratio[g] for g in grams(w)) / quality_rules.UNIT / (2 * len(w) - 1)
                assert abs(scores[r.doc_id].score - s) < 1e-3 and scores[r.doc_id].kept == (not scores[r.doc_id].base_failed and s >= -0.02)
        kept = quality_rules.keep_good(docs, labels, buckets, -0.02)
        assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    none = quality_rules.quality_rules(prose, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality_rules.quality_rules(odd.limit(0), labels).count() == 0
    assert F is not None
