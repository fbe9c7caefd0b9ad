"""N-gram join, neighbours, classifier, tool calls, pipeline: against brute force and on odd tables."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinreport.llm import neighbours, ngram_join, quality_classifier, tool_calls
from twinreport.operators.components import components


def near_copies(seed=1, families=12, copies=6):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(families):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([3, 40, 80, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    return rows


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("small,block", [(1024, 384), (4, 3)])
def test_join_against_brute_force(spark, small, block):
    """With tiny buckets and blocks every bucket is split and every group meets in parts."""
    rows = [*near_copies(), (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one  two"), (1005, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash")).withColumn("root", F.lit(1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(df, small=small, block=block).collect()}
    assert got == brute_classes(rows)


def test_join_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "w " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.ngram_join(df).collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("2", "1", 2), ("3", "3", 0), ("None", "None", 0)]
    kept = ngram_join.one_of_each(df.withColumn("extra", F.lit("e")))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"] and kept.columns == ["doc_id", "text", "extra"]
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_overlaps():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40, dtype=np.uint64)) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert ngram_join.overlaps(sets).tolist() == want


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    for i in range(1500, 1560):  # equal vectors, one of them asked for
        rows.append((i, x[100].tolist(), 0))
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] * 16, 0), (2400, [], 0), (2500, [float("inf")] * 16, 0), (None, x[0].tolist(), 0), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = neighbours.nearest(df).collect()
    ids = np.array([i for i, *_ in rows[:1560]])
    full = np.array([v for _, v, _ in rows[:1560]], np.float32).astype(float)
    asked = [i for i in ids if i % 100 == 0]
    assert {g.query_id for g in got} == set(asked)
    hit = 0
    for q in asked:
        d = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11))
        assert [(g.score, g.vec_id) for g in own] == sorted((g.score, g.vec_id) for g in own)
        assert all(abs(g.score - d[g.vec_id]) < 1e-12 for g in own)
        hit += len({g.vec_id for g in own} & set(ids[np.lexsort((ids, d))[:10]]))
    assert hit / len(asked) / 10 >= 0.9
    assert [g.vec_id for g in sorted((g for g in got if g.query_id == 100), key=lambda g: g["rank"])] == list(range(1500, 1510))
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = neighbours.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, label int")).collect()
    assert len(few) == 3


def junk_or_prose(n, seed=1):
    r = random.Random(seed)
    syllables = ["an", "er", "th", "le", "on", "de", "is", "to"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 400))]
        good = r.random() < 0.7
        yield i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)


def test_classifier(spark):
    rows = list(junk_or_prose(400))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(1000, None, "x", "y"), (1001, "", None, None), (None, "a b", "x", "y"), (1002, "word " * 30000, "x", "y")], "doc_id long, text string, lang string, quality string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == 404
    held = {r.doc_id: r for r in got if r.held_out}
    assert set(held) == {r.doc_id for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    truth = {i: q for i, _, q in rows}
    right = [held[i].predicted == truth[i] for i in held if i in truth]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    again = quality_classifier.quality_scores(docs.repartition(5), labels.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    none = quality_classifier.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_classifier_against_plain_loops():
    """Every passage is encoded, weighed and summed one at a time."""
    m = quality_classifier.AttentionModel()
    r = np.random.default_rng(2)
    bags = [r.normal(size=(n, quality_classifier.FEATURES)) for n in (1, 5, 2)]
    m.mean, m.scale = r.normal(size=quality_classifier.FEATURES), r.uniform(0.5, 2, quality_classifier.FEATURES)
    p, want = m.p, []
    for bag in bags:
        encoded = [np.tanh((x - m.mean) / m.scale @ p["W"] + p["b"]) for x in bag]
        weights = np.exp([float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]) for h in encoded])
        z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / weights.sum()
        want.append(1 / (1 + np.exp(-float(z @ p["o"] + p["c"][0]))))
    assert np.allclose(m.score(bags), want)


def test_training_rows_are_bounded(spark):
    """One row an id reaches the driver, however many rows and passages an id has."""
    rows = [(1, f"good words {i % 3} " * 9000) for i in range(40)] + [(2, "BAD!! " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality_classifier.training_rows(docs, labels).select("doc_id").distinct().count() <= 2
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == 41 and len({r.score for r in got if r.doc_id == 1}) <= 3
    assert len(quality_classifier.spread(np.zeros((500, 2)))) == quality_classifier.PASSAGES


def test_gradient():
    m = quality_classifier.AttentionModel()
    r = np.random.default_rng(0)
    x, bag = r.normal(size=(7, quality_classifier.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    loss = lambda: float((w * -(y * np.log(p := m.forward(x, bag, 3)["y"]) + (1 - y) * np.log(1 - p))).mean())
    g = m.gradient(x, bag, y, w)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        before = m.p[k][at]
        m.p[k][at] = before + 1e-6
        up = loss()
        m.p[k][at] = before - 1e-6
        down = loss()
        m.p[k][at] = before
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_tool_calls(spark):
    schemas = {"add": (("a",), {"a": "integer", "note": "string"})}
    calls = [
        (1, "x", 5, "add", '{"note":"n", "a" : 1}', []),
        (1, "y", 1, "add", '{"a":"1"}', ["x", None, "x"]),
        (1, "z", 2, "add", '{"b":1,"a":2}', ["y"]),
        (1, "c", 3, "add", None, ["d"]),
        (1, "d", 4, "other", "{}", ["c"]),
        (1, "m", 9, "add", "not json", ["gone"]),
        (1, "x", 7, "add", "{}", []),
        (None, "x", 1, "add", "{}", []),
        (2, None, 1, "add", "{}", None),
        (2, "x", None, None, '{"a":3}', None),
    ]
    results = [(1, "x", 6, 'said "é"\n'), (1, "x", 8, "late"), (1, "c", 6, "r"), (1, "nobody", 1, "o"), (None, "x", 1, "o")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>").withColumn("level", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("k", F.lit("clash"))
    r = spark.createDataFrame(results, "conv_id long, call_id string, position long, content string")
    got = {(x.conv_id, x.call_id): x for x in tool_calls.link_tool_calls(c, r.withColumn("level", F.lit(1)), schemas).collect()}
    assert set(got) == {(1, k) for k in ("x", "y", "z", "c", "d", "m", "nobody")} | {(2, "x")}
    x = got[1, "x"]
    assert (x.status, x.level, x.place, x.valid, x.n_copies, x.n_results) == ("linked", 0, 0, True, 2, 2)
    assert x.line == '{"arguments":{"a":1,"note":"n"},"depends_on":[],"id":"x","name":"add","result":"said \\"é\\"\\n"}' and json.loads(x.line)["result"] == 'said "é"\n'
    assert (got[1, "y"].status, got[1, "y"].level, got[1, "y"].place, got[1, "y"].valid) == ("no_result", 1, 1, False)
    assert (got[1, "z"].level, got[1, "z"].place, got[1, "z"].valid) == (2, 2, False)
    assert got[1, "c"].status == "blocked" and got[1, "c"].level is None and got[1, "m"].valid is False
    assert got[1, "nobody"].status == "orphan_result" and got[1, "nobody"].line is None
    assert got[2, "x"].level == 0 and got[2, "x"].valid is False
    assert tool_calls.link_tool_calls(c.limit(0), r.limit(0), schemas).count() == 0


def test_canonical_json(spark):
    rows = [
        ('{"b":1e2,"a":[1.50, 2.0,-0,0.0]}', '{"a":[1.5,2,0,0],"b":100}'),
        ('{"a":100}', '{"a":100}'),
        ('{"a":1e400}', None),
        ('{"a":"1e400 \\\\ \\" 2.0, \\\\\\" 3.0","2.0":1e20}', '{"2.0":100000000000000000000,"a":"1e400 \\\\ \\" 2.0, \\\\\\" 3.0"}'),
        ('{"a":1E-7,"b":1e40}', '{"a":0.0000001,"b":1.0E40}'),
        ('{"a":true,"b":null}', '{"a":true,"b":null}'),
        ('{"a":1,"a":2}', None),
        ("nope", None),
        (None, None),
    ]
    got = spark.createDataFrame([(x,) for x, _ in rows], "j string").select("j", tool_calls.canonical(F.col("j")).alias("c")).collect()
    assert {r.j: r.c for r in got} == dict(rows)
    kinds = {"s": "string", "i": "integer", "n": "number", "b": "boolean", "o": "object", "a": "array", "z": "null"}
    values = {"s": '"x"', "i": "1.0", "n": "1.5", "b": "false", "o": '{"q":[1]}', "a": "[]", "z": "null"}
    texts = [(k, v, f'{{"{k}":{x}}}') for k in kinds for v, x in values.items()]
    df = spark.createDataFrame(texts, "k string, v string, j string")
    for k in kinds:
        got = df.filter(F.col("k") == k).select("v", tool_calls.valid(F.lit("t"), tool_calls.canonical(F.col("j")), {"t": ((k,), {k: kinds[k]})}).alias("ok")).collect()
        assert {r.v for r in got if r.ok} == ({"i", "n"} if k == "n" else {k}), k


def brute_levels(needs):
    out = {}
    while True:
        new = {c: 1 + max((out[d] for d in ds), default=-1) for c, ds in needs.items() if c not in out and all(d in out for d in ds)}
        if not new:
            return out
        out |= new


def test_levels_against_brute_force(spark):
    r = random.Random(9)
    rows = []
    for conv in range(30):
        n = r.randint(1, 14)
        for i in range(n):
            ds = [f"c{r.randint(0, n if r.random() < 0.05 else max(i - 1, 0))}" for _ in range(r.randint(0, 3))] if i else []
            rows.append((conv, f"c{i}", ds))
    # A ladder of parallel calls, and a long chain that names the last two each.
    rows += [(100, f"c{i}_{j}", [f"c{i - 1}_{k}" for k in range(4)] if i else []) for i in range(12) for j in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    got = {(x.conv_id, x.call_id): x.level for x in tool_calls.levels(df).collect()}
    want = {}
    for conv in {c for c, *_ in rows}:
        own = brute_levels({i: set(d) for c, i, d in rows if c == conv})
        want |= {(conv, i): v for i, v in own.items()}
    assert got == want


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    rows = [(1, f"c{i}", [f"c{i - k}" for k in (1, 2) if i >= k]) for i in range(n)] + [(1, "loop", ["loop"]), (1, "ring", ["loop"])]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    real = tool_calls.checkpointed
    monkeypatch.setattr(tool_calls, "checkpointed", lambda d: rounds.append(1) or real(d))
    got = {x.call_id: x.level for x in tool_calls.levels(df).collect()}
    assert got == {f"c{i}": i for i in range(n)} and len(rounds) < 4 * 20


def test_every_status_and_turn(spark):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", None if (c, t) == (3, 1) else f"say {c} {t} \"2.0\"\n" * (4000 if c == 5 else 1)) for c in range(40) for t in range(7)]
    rows += [(1, 90, "tool", "x"), (1, 90, "tool", "y"), (2, 91, None, "z"), (None, 1, "user", "n"), (4, None, "user", "n"), (7, 50, "assistant", "orphan"), (8, 60, "user", "unanswered"), (9, 1, "user", "say 9 1 again")]
    rows.append((50, 1, "user", '{"name":"answer","arguments":{"turn":1e0,"prompt":"p"}}'))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = {(x.conv_id, x.call_id): x for x in tool_calls.chat_calls(df).collect()}
    assert {x.status for x in got.values()} == {"linked", "no_result", "blocked", "orphan_result", "not_a_call"}
    assert got[1, "turn_90"].n_copies == 2 and got[2, "turn_91"].status == "not_a_call" and got[9, "call_1"].n_copies == 2
    assert got[50, "call_1"].valid and json.loads(got[50, "call_1"].line)["arguments"] == {"prompt": "p", "turn": 1}
    assert not got[3, "call_1"].valid
    for (c, i), x in got.items():
        kind = (7 * c + int(i.split("_")[1])) % 20
        if x.status not in ("orphan_result", "not_a_call") and c != 50:
            assert x.valid == (kind not in (0, 1, 2, 6) and (c, i) != (3, "call_1")), (c, i)
            assert (json.loads(x.line)["arguments"] is None) == (kind == 6)
            if kind in (3, 4):
                assert x.level is None


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "er", "th", "le"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(120)) + f" mail{i}@site.example.org", "en", f"s{i % 3}", 0))
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)]
    rows += [(200 + i, " ".join(word().upper() + "!!" for _ in range(120)), "en", "s1", 0) for i in range(10)]
    rows += [(300, None, None, None, None), (None, "x", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows if i is not None], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{len(seen)}")
        d = spark.read.parquet(f"{sf}/{len(seen)}")
        seen.append(d)
    assert {x.doc_id for x in seen[0].collect()} == set(range(60)) | set(range(100, 110))
    assert {x.doc_id for x in seen[1].collect()} == set(range(60))
    assert all("[EMAIL]" in x.text and "@" not in x.text and x.n_chars == len(x.text) for x in seen[2].collect())
    assert {x.doc_id for x in seen[3].collect()} <= set(range(60)) and seen[3].count() > 60
    assert seen[4].agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.run(spark, sf).count() > 0
