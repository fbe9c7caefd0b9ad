"""What queries over the whole corpus shuffle and write, and what they leave; terms counted where a report lies."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinreport.config import Settings
from twinreport.lineage import shared_folder
from twinreport.operators import similarity, terms

SF = "/root/testdata/sf0.01"
TFIDF = Settings(tfidf_algorithm="tfidf")
#: Times the input that a query may shuffle on these few documents; terms of the best ten reports of each incoming one are much there.
SHUFFLED = {"dot_similarity_topn": 2, "dot_pruned_topn": 4, "sentences_with_term": 7, "compare_tfidf": 4}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def shuffled(spark, after=-1):
    """Bytes that stages after one wrote to shuffles, and the last stage."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    empty = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(jvm.double, 0), empty)
    found = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]
    return sum(n for i, n in found if i > after), max([i for i, _ in found], default=-1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", SHUFFLED)
def test_little_is_shuffled_and_nothing_is_left(spark, name):
    spark.range(1).collect()
    folder = shared_folder(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(folder) if x.count("-") != 4} if os.path.isdir(folder) else set()
    _, last = shuffled(spark)
    before = tables()
    entry.queries()[name](spark, SF).collect()
    assert tables() == before
    assert 0 < shuffled(spark, last)[0] < SHUFFLED[name] * os.path.getsize(f"{SF}/documents.parquet")


def test_terms_are_counted_where_a_report_lies(spark):
    df = spark.createDataFrame([(1, "Oak elm oak", "version: fir fir\noak the"), (2, None, None), (3, "", "yew " * 2500 + "ash"), (4, "a bug", "e-mail e-mail")], "bug_id long, summ string, desc string")
    got = terms.local_counts(df, Settings())
    assert rows(got) == rows(terms.term_counts(df, Settings(), synonyms=False)) and (3, "desc", "yew", 2500) in rows(got)
    assert "Exchange" not in plan(got)
    many = df.unionByName(df.filter("bug_id = 1")).unionByName(spark.createDataFrame([(None, "oak", "elm oak"), (None, "elm", "elm")], df.schema)).repartition(3)
    got = rows(terms.local_counts(many, Settings()))
    assert got == rows(terms.term_counts(many, Settings(), synonyms=False)) and (None, "desc", "elm", 2) in got and (1, "desc", "fir", 4) in got
    stems = Settings(stemmer="snowball")
    assert rows(terms.local_counts(many, stems)) == rows(terms.term_counts(many, stems, synonyms=False))


@pytest.mark.parametrize("lists", [1, 1000])
def test_few_lists_at_a_time(spark, monkeypatch, lists):
    import pyarrow as pa

    monkeypatch.setattr(terms, "LISTS", lists)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 9]), pa.array(["summ"] * 4), pa.array([["b", "a", "b"], None, [], ["b"]])], names=["k", "field", "terms"])
    got = [r for b in terms._counted_lists([batch]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == [(7, "summ", "a", 1), (7, "summ", "b", 2), (9, "summ", "b", 1)]


@pytest.mark.parametrize("hot", [0, 1, 5, 250_000])
def test_weights_of_a_part(spark, monkeypatch, hot):
    monkeypatch.setattr(terms, "HOT", hot)
    counts = spark.createDataFrame([(i, f, f"w{j}", 1 + (i + j) % 3) for i in range(1, 12) for f in ("summ", "desc") for j in range(12) if j % i == 0 and (f == "desc" or i % 2)], "bug_id long, field string, term string, tf long")
    dfs = terms.field_counts(counts)
    part = counts.filter("term in ('w0', 'w6', 'w9')")
    got = terms.scaled(part, terms.lengths(counts, dfs, 40), dfs, 40, 24)
    want = terms.weights(counts, dfs, 40, "tfidf").filter("term in ('w0', 'w6', 'w9')")
    key = lambda df: rows(df.select("bug_id", "field", "term", F.round("w", 9).alias("w")))
    assert key(got) == key(want)


@pytest.mark.parametrize("settings", [Settings(), TFIDF])
def test_pairs_are_summed_where_their_report_lies(spark, settings):
    q = spark.createDataFrame([(1, "desc", "oak", 1.0), (1, "summ", "elm", 2.0), (2, "desc", "elm", 1.0)], "query_id long, field string, term string, w double")
    c = spark.createDataFrame([(i, "desc", t, 0.5 + i) for i in range(9) for t in ("oak", "elm", "fir")[: 1 + i % 3]], "bug_id long, field string, term string, w double")
    got = similarity.similarities(q, c.repartition("bug_id"), settings, n_terms=3)
    want = similarity.similarities(q, c, settings)
    assert rows(got) == rows(want)
    dealt = r"hashpartitioning\(query_id#\d+L, bug_id"
    assert not re.search(dealt, plan(got)) and re.search(dealt, plan(want))
