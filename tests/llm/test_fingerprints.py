"""Fingerprints against plain Python: the order of documents in many cells, edited texts, sketches, their estimates."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from twinreport.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, w string, s string, cell long"


def sketch(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] * bool(w)
    return sorted({hashlib.md5(r.encode()).hexdigest()[:12] for r in runs})[:128]


def near(a, b):
    u = sorted({*a, *b})[:128]
    return len({*a} & {*b} & {*u}) / len(u) if u else 1.0


def expected(rows):
    """For rows with distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        s, e = sketch(text), sketch(new)
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), "".join(s), "".join(e), near(s, e), near(s, sketch(after)))
    return out


def made(n=60):
    r = random.Random(1)
    some = [r"zwei", "drei", "𝔘ni", "ça", "a", "bb", " x", "émile"]
    texts = [" ".join(r.choices(some, k=r.choice([0, 1, 3, 5, 30, 400]))) for _ in range(n)]
    ids = r.sample(range(-5000, 5000), n - 3) + [2**62, -(2**62), None]
    return list(zip(ids, texts[:-3] + [None, "", "\t \n"], strict=True))


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], SCHEMA)
    return fp.edited_fingerprints(df, **sizes).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()


def test_against_plain_python(spark):
    rows = made()
    want = expected(rows)
    for sizes in ({}, {"small": 2000}, {"small": 2000, "large": 300}):
        got = {r[0]: tuple(r[1:]) for r in run(spark, rows, **sizes)}
        assert got == want


def test_repeated_ids_follow_each_other(spark):
    rows = [(7, f"text {i % 5} of seven words in all {i}") for i in range(40)] + [(7, "the same")] * 30 + [(3, "three"), (9, "nine")]
    got = run(spark, rows, small=100, large=50)
    assert len(got) == len(rows)
    assert sum(r["fingerprint"] == "".join(sketch("the same")) for r in got) == 30
    # Each row's edited text takes its end from one row, so nine's row and three's are each taken once.
    whole = sorted(t for _, t in rows)
    ends = [t for r in got for t in whole if hashlib.sha256((of(r, rows)[: len(of(r, rows)) - len(of(r, rows)) // 2] + t[: len(of(r, rows)) // 2]).encode()).hexdigest() == r["edited_sha256"]]
    assert "nine" in ends and "three" in ends
    assert sorted(map(tuple, got)) == sorted(map(tuple, run(spark, rows)))


def of(row, rows):
    return next(t for i, t in rows if i == row["doc_id"] and "".join(sketch(t)) == row["fingerprint"])


def test_one_row_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "one two")])[0]["near_next"] == 1.0
    assert run(spark, [(None, None)])[0]["n_chars"] == 0
    assert len(run(spark, [(None, f"t{i}") for i in range(20)], small=10, large=5)) == 20


def test_estimates(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(fp.words(F.col("a")).alias("a"), fp.words(F.col("b")).alias("b"))
    rows = rows.select(fp.sketch("a").alias("a"), fp.sketch("b").alias("b")).withColumn("u", fp.merge(F.col("a"), F.col("b")))
    rows = rows.withColumn("r", fp.resemblance(F.col("a"), F.col("b"), F.col("u")))
    r = rows.select("r", fp.distinct(F.col("a")).alias("n"), fp.containment(F.col("a"), F.col("u"), F.col("r")).alias("c"), "u").first()
    assert abs(r["r"] - 1 / 3) < 0.13 and abs(r["n"] - 3996) < 1100 and abs(r["c"] - 0.5) < 0.2
    assert r["u"] == sorted({*sketch(a), *sketch(b)})[:128]


def test_merged_is_the_sketch_of_all_parts(spark):
    parts = [(1, "a b c d e f g"), (1, "q r s t u v"), (1, ""), (2, ""), (3, " ".join(f"x{i}" for i in range(500)))]
    df = spark.createDataFrame(parts, "k int, t string").select("k", fp.words(F.col("t")).alias("w")).select("k", fp.sketch("w").alias("sketch"))
    got = {r["k"]: r["sketch"] for r in fp.merged(df, ["k"]).collect()}
    assert got == {1: sorted({*sketch(parts[0][1]), *sketch(parts[1][1])}), 2: [], 3: sketch(parts[4][1])}
    back = df.select("sketch", fp.from_fingerprint(fp.fingerprint(F.col("sketch"))).alias("b")).collect()
    assert all(r["b"] == r["sketch"] for r in back)
