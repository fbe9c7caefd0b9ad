import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinreport.config import Settings
from twinreport.operators import evaluate, groups, recommend, similarity, terms

SNOWBALL = Settings(stemmer="snowball")


def reports(spark, rows):
    return spark.createDataFrame(rows, "bug_id long, summ string, desc string")


def vectors(spark, key, bags):
    return spark.createDataFrame([(k, "desc", t, w) for k, bag in bags.items() for t, w in bag.items()], f"{key} long, field string, term string, w double")


def test_term_counts(spark):
    df = reports(spark, [(1, "this is a test of calculation for single report term count.", "this is the description of the test report. just a test."), (2, None, "")])
    got = {(r.bug_id, r.field, r.term): r.tf for r in terms.term_counts(df, SNOWBALL).collect()}
    assert got[1, "summ", "calcul"] == 1 and got[1, "desc", "test"] == 2 and (1, "desc", "report") not in got
    assert not [k for k in got if k[0] == 2]


def test_synonyms(spark):
    df = reports(spark, [(1, "email mail mail", "folder")])
    got = {(r.field, r.term): r.tf for r in terms.term_counts(df, Settings()).collect()}
    assert got == {("summ", "email"): 1, ("summ", "mail"): 2, ("summ", "e-mail"): 2, ("summ", "message"): 2, ("desc", "folder"): 1, ("desc", "directory"): 1}


def test_weights(spark):
    counts = spark.createDataFrame([(1, "summ", "oak", 5), (1, "summ", "elm", 12), (1, "desc", "lark", 7), (1, "desc", "wren", 21), (1, "desc", "rook", 7)], "bug_id long, field string, term string, tf long")
    dfs = terms.field_counts(counts)
    assert terms.document_counts(counts).filter("term = 'rook'").first()["desc"] == 1
    for r in terms.squared_lengths(terms.weights(counts, dfs, 100, "tfidf")).collect():
        assert abs(r.len2 - 1) < 1e-9
    assert {round(r.w, 9) for r in terms.weights(counts, dfs, 100, "bidf").collect()} == {round(math.log(101 / 2), 9)}
    with pytest.raises(ValueError):
        terms.weights(counts, dfs, 1, "other")


def test_asymmetric_similarity(spark):
    q = vectors(spark, "query_id", {1: {"oak": 1.0, "elm": 1.0}})
    c = vectors(spark, "bug_id", {1: {"oak": 1.0, "elm": 1.0, "fir": 1.0}, 2: {"oak": 1.0, "ash": 1.0, "yew": 1.0}, 3: {"other": 1.0}})
    got = {r.bug_id: r.rd for r in similarity.similarities(q, c, Settings()).collect()}
    assert got == {1: 1.0, 2: 0.5}
    unwanted = spark.createDataFrame([(1, "fir")], "query_id long, term string")
    got = {r.bug_id: r.rd for r in similarity.similarities(q, c, Settings(penalty_weight=1.0), unwanted).collect()}
    assert got == {1: 0.5, 2: 0.5}


def test_every_candidate_is_scored(spark):
    """Candidates that share no term stay, an incoming report without terms is like all, traces count."""
    s = Settings(scoring_strategy="weighted", bug_stacktrace_ratio=1.0)
    trace = "array<array<string>>"
    asked = spark.createDataFrame([(1, "p", None, None, None, [["f", "g"]]), (2, "p", 10**9, [10], 11, []), (3, "r", None, None, None, None)], f"query_id long, product string, ts long, exclude array<long>, dummy_bug_id long, stacktrace {trace}")
    held = spark.createDataFrame([(10, "p", 10**9, [["f"]]), (11, "p", 10**9, []), (12, "p", 10**9, [["h", "??"]]), (13, "q", 10**9, []), (14, "p", 1, [])], f"bug_id long, product string, ts long, stacktrace {trace}")
    ours = spark.createDataFrame([(1, "summ", "oak", 2.0), (1, "desc", "elm", 1.0)], "query_id long, field string, term string, w double")
    theirs = spark.createDataFrame([(10, "summ", "oak", 1.0), (13, "summ", "oak", 1.0), (12, "desc", "yew", 1.0)], "bug_id long, field string, term string, w double")
    got = {(r.query_id, r.bug_id): (r.rs, r.rd, r.rt, r.score) for r in similarity.over_candidates(asked, held, ours, theirs, s).collect()}
    assert got == {
        (1, 10): (0.5, 0.0, 0.5, 0.75), (1, 11): (0.0, 0.0, 0.0, 0.0), (1, 12): (0.0, 0.0, 0.0, 0.0), (1, 14): (0.0, 0.0, 0.0, 0.0),
        (2, 12): (1.0, 1.0, 1.0, 2.0),
    }


def test_scores_cover_all_bands(spark):
    rows = [(s / 4, t / 4) for s in range(5) for t in range(5)]
    df = spark.createDataFrame(rows, "nl double, rt double")

    def brute(nl, rt):
        if nl > 0.5:
            return 0.75 + 0.25 * (nl + rt) / 2 if rt > 0.5 else 0.5 + 0.25 * nl
        return 0.25 + 0.25 * rt if rt > 0.5 else 0.25 * (nl + rt) / 2

    got = df.select("nl", "rt", similarity.score(F.col("nl"), F.col("nl"), F.col("rt"), Settings()).alias("s"), similarity.score(F.col("nl"), F.col("nl"), F.col("rt"), Settings(scoring_strategy="distweighted"), F.lit(True)).alias("d"))
    for r in got.collect():
        assert abs(r.s - brute(r.nl, r.rt)) < 1e-12
        assert abs(r.d - (0.7 * max(r.nl, r.rt) + 0.3 * min(r.nl, r.rt))) < 1e-12


def test_cut_and_duplicates(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.85), (1, 12, 0.1), (2, 10, 0.5)], "query_id long, bug_id long, score double")
    s = Settings(bug_duplicate_number=1)
    rows = similarity.similar(df, s)
    assert [(r.query_id, r.bug_id, r["rank"]) for r in rows.orderBy("rank").collect()] == [(1, 10, 1), (1, 11, 2)]
    g = spark.createDataFrame([(10, 5), (11, 5)], "bug_id long, group long")
    assert [r.bug_id for r in similarity.duplicates(rows, g, s).collect()] == [10]
    n = spark.createDataFrame([(1, 9)], "query_id long, n long")
    assert similarity.similar(df, s, n).first()["cut"] == 0.72
    array = F.array(*[F.lit(float(i)) for i in range(10, 0, -1)])
    got = spark.range(1).select(*[similarity.at_least(array, F.lit(float(t))) for t in (3, 11, 1)], similarity.at_least(F.array().cast("array<double>"), F.lit(1.0))).first()
    assert list(got) == [8, 0, 10, -1]


def test_candidates(spark):
    docs = spark.createDataFrame([(1, "p", 0), (2, "p", 10**9), (3, "p", 10**9), (4, "q", 10**9), (5, "p", 10**9)], "bug_id long, product string, ts long")
    q = spark.createDataFrame([(9, "p", 10**9, [2], 3), (8, "p", None, None, None)], "query_id long, product string, ts long, exclude array<long>, dummy_bug_id long")
    got = {(r.query_id, r.bug_id) for r in similarity.candidates(q, docs, Settings()).collect()}
    assert got == {(9, 5), (8, 1), (8, 2), (8, 3), (8, 5)}


def test_groups_against_merging(spark):
    r = random.Random(4)
    edges = [(r.randint(1, 40), r.randint(1, 40)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    bad = {r.randint(1, 40) for _ in range(8)}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    root = {x: find(x) for x in list(parent)}
    members, sizes = groups.duplicate_groups(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(b,) for b in bad], "bug_id long"))
    assert {(m.bug_id, m.group) for m in members.collect()} == {(x, g) for x, g in root.items() if x not in bad}
    e, i = Counter(root[a] for a, _ in edges), Counter(g for x, g in root.items() if x in bad)
    want = {(g, e[g] + 1 - i[g], sum(x not in bad for x, y in root.items() if y == g)) for g in set(root.values())}
    assert {tuple(s) for s in sizes.collect()} == {w for w in want if w[2]}


def test_group_tables(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "src long, dst long")
    members, sizes = groups.star_groups(edges)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 4), (4, 4)}
    assert {tuple(r) for r in sizes.collect()} == {(1, 3), (4, 2)}
    assert [r.group for r in groups.groups_between(sizes, 2, 4).collect()] == [1]
    basic = spark.createDataFrame([(1, 5, "a"), (2, 9, "b")], "bug_id long, ts long, product string")
    assert {tuple(r) for r in groups.group_spans(members, basic).collect()} == {(1, 4, 2), (4, -10000000999, 0)}
    found = spark.createDataFrame([(1, 2), (1, 4), (1, 1), (7, 8)], "query_id long, bug_id long")
    assert {tuple(r) for r in groups.hits(found, members).collect()} == {(1, 2, True), (1, 4, False), (7, 8, False)}
    lines = groups.product_counts(spark.createDataFrame([(1, "a")] * 3 + [(2, "b"), (3, None)], "bug_id long, product string"), 2, "<", ">")
    assert [tuple(r) for r in lines.collect()] == [("a", 3, "<a> <!--3-->")]


def test_difference_and_keyword(spark):
    s = Settings(stemmer="snowball")
    new = terms.term_counts(reports(spark, [(1, "kettle in kitchen", "steam everywhere")]).withColumnRenamed("bug_id", "query_id"), s, "query_id")
    old = terms.term_counts(reports(spark, [(5, "kettle of copper leaked", "everywhere steam puddle")]), s)
    found = spark.createDataFrame([(1, 5, 1.0), (1, 6, 1.0)], "query_id long, bug_id long, score double")
    diff = recommend.report_difference(found, new, old)
    assert {(r.field, r.term) for r in diff.collect()} == {("summ", "copper"), ("summ", "leak"), ("desc", "puddl")}
    best = recommend.best_keyword(recommend.keyword_scores(diff, found, terms.field_counts(old), 10)).first()
    assert best.term == "puddl" and abs(best.score - math.log(11 / 2) / math.log(11)) < 1e-6


def test_clusters(spark):
    rows = [(i, f"t{i % 3}", 1.0 + i / 100) for i in range(12)]
    w = spark.createDataFrame(rows, "id long, term string, w double")
    got = recommend.cluster_sentences(recommend.sentence_features(w, 64), 3).collect()
    assert len(got) == 12
    for c in {r.cluster for r in got}:
        own = [r for r in got if r.cluster == c]
        assert len({r.id % 3 for r in own}) == 1 and sum(r.representative for r in own) == 1


def test_sentences_stop_after_enough_reports(spark):
    rows = spark.createDataFrame([(1, b, p, "s") for b, n in ((5, 3), (6, 2), (7, 4)) for p in range(n)], "query_id long, bug_id long, pos long, sentence string")
    ranked = spark.createDataFrame([(1, 7, 1), (1, 5, 2), (1, 6, 3)], "query_id long, bug_id long, rank long")
    held = lambda most: {r.bug_id for r in recommend.first_reports(rows, ranked, most).collect()}
    assert held(3) == {7} and held(4) == {7, 5} and held(6) == {7, 5} and held(7) == {7, 5, 6}


def test_representatives(spark):
    rows = spark.createDataFrame([(q, 1, i, f"s{i}") for q, n in ((1, 9), (2, 2)) for i in range(n)], "query_id long, bug_id long, pos long, sentence string")
    w = spark.createDataFrame([(1, 1, i, f"t{i % 3}", 1.0 + i) for i in range(9)], "query_id long, bug_id long, pos long, term string, w double")
    got = recommend.representatives(rows, w, 3).collect()
    assert sorted(r.pos for r in got if r.query_id == 2) == [0, 1]
    own = [r.pos for r in got if r.query_id == 1]
    assert 1 <= len(own) <= 3 and len({p % 3 for p in own}) == len(own)
    again = recommend.representatives(rows.repartition(3), w.repartition(2), 3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_duplicate_texts(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, bug_id long, rank long")
    got = {r.bug_id: (r.summ, r["desc"]) for r in recommend.duplicate_texts(found, reports(spark, [(5, "a", "b")])).collect()}
    assert got == {5: ("a", "b"), 6: ("", "")}


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "query_id long, n_true long")
    hits = spark.createDataFrame([(1, 5, True), (1, 6, False), (2, 7, False), (3, 8, True)], "query_id long, bug_id long, hit boolean")
    r = evaluate.macro(cases, hits, hits.filter("query_id = 1")).first()
    assert (r.similar_cases, r.similar_precision, r.similar_recall, r.similar_binary_recall, r.similar_size) == (2, 0.25, 0.25, 0.5, 1.5)
    assert (r.duplicate_cases, r.duplicate_recall) == (1, 0.5)
    empty = evaluate.macro(cases.limit(0), hits, hits).first()
    assert empty.similar_cases == 0 and empty.similar_precision is None
    sizes = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 40)], "group long, size long")
    assert {tuple(x) for x in evaluate.strata(sizes, Settings()).collect()} == {(1, "small"), (3, "middle"), (4, "large")}
    members = spark.createDataFrame([(i, i % 4) for i in range(20)], "bug_id long, group long")
    drawn = evaluate.sample_members(members, members.select("group").distinct(), 6).collect()
    assert len(drawn) == 6 and all(r.bug_id % 4 == r.group for r in drawn)
    text = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)))], "id long, x string")
    kept = text.select(evaluate.incomplete_text(F.col("x"), F.col("id"), 0.5, Settings()).alias("y")).first().y.split()
    assert 140 < len(kept) < 260
    assert len(evaluate.grid()) == 15
