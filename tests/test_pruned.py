"""Searches by bounds against scoring every pair; the range join; groups that links are added to."""

import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from twinreport.config import Settings
from twinreport.lineage import checkpointed
from twinreport.operators import groups, similarity, terms
from twinreport.operators.pruned import Pruned


def corpus(spark, n, seed, lengths=(3, 8, 25)):
    """Reports of words with ranks as in a language, and incoming reports that are parts of some of them, and others."""
    r = random.Random(seed)
    word = lambda: f"w{int(1500 ** r.random())}"
    texts = [[word() for _ in range(r.choice(lengths))] for _ in range(n)]
    asked = [r.choice(texts)[:6] + [word() for _ in range(4)] for _ in range(12)] + [["w1", "w1"], ["none"], [], texts[3]]
    rows = lambda ts, key: checkpointed(
        spark.createDataFrame([(i, f, w) for i, t in enumerate(ts) for f, part in (("summ", t[:3]), ("desc", t)) for w in part], f"{key} long, field string, term string").groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    return rows(asked, "query_id"), rows(texts, "bug_id")


def ready(spark, settings, n, seed, **more):
    asked, counts = corpus(spark, n, seed, **more)
    dfs = terms.field_counts(counts)
    ours = checkpointed(terms.weights(asked, dfs, n, settings.tfidf_algorithm, "query_id"))
    theirs = checkpointed(terms.weights(counts, dfs, n, settings.tfidf_algorithm))
    nl = F.col("rs") * settings.bug_summary_ratio + F.col("rd") * settings.bug_description_ratio
    scored = checkpointed(similarity.similarities(ours, theirs, settings).select("query_id", "bug_id", F.round(nl, similarity.DIGITS).alias("score")))
    blocks = counts.groupBy("bug_id").agg(F.floor(F.log2(F.sum("tf"))).cast("int").alias("block"))
    vectors = checkpointed(theirs.filter("w != 0").join(blocks, "bug_id"))
    return Pruned(ours, vectors, vectors.groupBy("field", "term", "block").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("df")), settings), scored, ours


@pytest.mark.parametrize("algorithm", ["bidf", "tfidf"])
def test_top_and_cut_are_those_of_all_pairs(spark, algorithm):
    s = Settings(tfidf_algorithm=algorithm, bug_no_similar_threshold=0.2, bug_summary_ratio=0.3, bug_description_ratio=0.7)
    for seed, n in ((1, 400), (2, 12)):
        search, scored, ours = ready(spark, s, n, seed)
        for k in (1, 5):
            want = similarity.top(scored, k).select("query_id", "bug_id", "score", "rank")
            assert sorted(map(tuple, search.top(k).collect())) == sorted(map(tuple, want.collect()))
        total = ours.select("query_id").distinct().withColumn("n", F.lit(n).cast("long"))
        want = similarity.similar(scored, s, total).select("query_id", "bug_id", "score", "cut", "rank")
        assert sorted(map(tuple, search.similar(n).collect())) == sorted(map(tuple, want.collect()))


def test_least_score_where_every_report_shares_a_term(spark):
    asked = spark.createDataFrame([(1, "desc", "a"), (1, "desc", "b"), (2, "desc", "b")], "query_id long, field string, term string").withColumn("w", F.lit(1.0))
    theirs = checkpointed(spark.createDataFrame([(i, "desc", "a" if i % 3 else "b", 0) for i in range(30)] + [(5, "desc", "b", 0)], "bug_id long, field string, term string, block int").withColumn("w", F.lit(0.5)))
    search = Pruned(asked, theirs, theirs.groupBy("field", "term", "block").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("df")), Settings())
    assert {r["query_id"]: r["low"] for r in search.least_scores(30).collect()} == {1: 0.625, 2: 0.0}  # without a summary it is fully like all
    assert {r["query_id"]: r["low"] for r in search.least_scores(31).collect()} == {1: 0.0, 2: 0.0}


def test_few_pairs_are_formed(spark):
    s = Settings(bug_no_similar_threshold=0.2)
    search, scored, _ = ready(spark, s, 4000, 3, lengths=(20, 40))
    search.similar(4000).count()
    # Every report there has one of the commonest words, so its least scores need all pairs of one incoming report.
    assert (search.formed["first"] + search.formed["reaching"]) * 10 < scored.count()


def test_reports_that_are_no_candidates(spark):
    s = Settings(bug_no_similar_threshold=0.0)
    search, scored, ours = ready(spark, s, 60, 4)
    gone = checkpointed(similarity.top(scored, 2).select("query_id", "bug_id"))
    again = Pruned(ours, search.theirs, search.theirs.groupBy("field", "term", "block").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("df")), s, gone)
    left = scored.join(gone, ["query_id", "bug_id"], "left_anti")
    total = ours.select("query_id").distinct().join(gone.groupBy("query_id").agg(F.count(F.lit(1)).alias("g")), "query_id", "left").select("query_id", (60 - F.coalesce("g", F.lit(0))).alias("n"))
    want = similarity.similar(left, s, total).select("query_id", "bug_id", "score", "cut", "rank")
    assert sorted(map(tuple, again.similar(60).collect())) == sorted(map(tuple, want.collect()))


def tables(spark, products, seed=1, n=4000, asked=30):
    r = random.Random(seed)
    year = 365 * 86400
    reports = [(i, r.choice(products), r.choice([None, r.randrange(0, 12 * year)])) for i in range(n)]
    q = [(i, r.choice(products), r.choice([None, r.randrange(0, 14 * year)]), [r.randrange(n) for _ in range(5)], r.randrange(n)) for i in range(asked)]
    return spark.createDataFrame(q, "query_id long, product string, ts long, exclude array<long>, dummy_bug_id long"), spark.createDataFrame(reports, "bug_id long, product string, ts long"), q, reports


def test_range_join_is_the_filter(spark):
    q, reports, plain_q, plain_r = tables(spark, ["a", "b", "c", None], n=600)
    window = Settings().window_seconds
    want = {(a, b) for a, p, t, x, d in plain_q for b, o, u in plain_r if p is not None and p == o and (t is None or (u is not None and u > t - window)) and b not in x and b != d}
    for sent in (0, 100):
        got = [tuple(r) for r in similarity.candidates(q, reports, Settings(), sent=sent).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_product_is_spread_over_all_tasks(spark):
    q, reports, *_ = tables(spark, ["only"], n=20_000, asked=20)
    rows = similarity.candidates(q, reports, replace(Settings(), window_seconds=40 * 365 * 86400), sent=0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 2 * statistics.median(sizes)


def test_groups_by_batches_are_those_of_a_rebuild(spark):
    r = random.Random(5)
    store, all_links, all_bad = groups.GroupStore.empty(spark), [], []
    for _ in range(10):
        links = [(r.randrange(60), r.randrange(60)) for _ in range(4)]
        links = [(a, b) for a, b in links if a != b]
        bad = [(r.randrange(60),)] if r.random() < 0.5 else []
        before = dict(store.nodes.collect())
        all_links, all_bad = all_links + links, all_bad + bad
        store = store.with_links(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(bad, "bug_id long"))
        after = dict(store.nodes.collect())
        assert store.moved == sum(after[x] != g for x, g in before.items()) and store.added == len(after) - len(before)
        want = groups.duplicate_groups(spark.createDataFrame(all_links, "src long, dst long"), spark.createDataFrame(all_bad, "bug_id long"))
        for got, w in zip(store.groups(), want, strict=True):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, w.collect()))


def test_a_text_finds_what_it_was_taken_from(spark):
    from twinreport.plans import domain

    row = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.length("text").desc()).first()
    got = domain.ask(spark, "/root/testdata/sf0.001", row["text"].split("\n")[0].upper(), row["text"], 3).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["score"] == 1.0 and row["doc_id"] in [r["bug_id"] for r in got]
