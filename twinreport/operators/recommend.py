"""What an incoming report could still tell: terms of similar reports that it lacks, the keyword that splits them best, sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..lineage import met
from .similarity import DIGITS
from .terms import unit_idf


def report_difference(found: DataFrame, incoming: DataFrame, corpus: DataFrame, skip: DataFrame | None = None, query: str = "query_id", n: int | None = None) -> DataFrame:
    """query, bug_id, field, term: terms of the found reports (query, bug_id) that the incoming report lacks.

    Of a summary those not in the incoming summary; of a description those in neither field and not skipped (query, term).
    n: the found reports, if known; some are broadcast, so that no other report's terms are shuffled.
    """
    each, words = found.select(query, "bug_id"), corpus.select("bug_id", "field", "term")
    theirs = each.join(words, "bug_id") if n is None else met(words, each, ["bug_id"], n)
    known = incoming.filter("field = 'summ'").select(query, F.explode(F.array(F.lit("summ"), F.lit("desc"))).alias("field"), "term")
    known = known.unionByName(incoming.filter("field = 'desc'").select(query, "field", "term"))
    if skip is not None:
        known = known.unionByName(skip.select(query, F.lit("desc").alias("field"), "term"))
    return theirs.join(known.distinct(), [query, "field", "term"], "left_anti").select(query, "bug_id", "field", "term")


def keyword_scores(differences: DataFrame, scored: DataFrame, dfs: DataFrame, n: int, penalty: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """query, term, score: how evenly a term splits the score of the similar reports, times its unit idf.

    differences: report_difference; scored: query, bug_id, score; dfs: field, term, df; n: reports. Queries whose scores
    add up to 0 have none.
    """
    total = scored.groupBy(query).agg(F.sum("score").alias("total")).filter("total > 0")
    rows = differences.filter("field = 'desc'").join(scored.select(query, "bug_id", "score"), [query, "bug_id"])
    if penalty is not None:
        rows = rows.join(penalty.select(query, "term"), [query, "term"], "left_anti")
    mass = rows.groupBy(query, "term").agg(F.sum("score").alias("mass")).join(total, query)
    df = dfs.filter("field = 'desc'").select("term", "df")
    gain = 1 - 2 * F.abs(F.col("mass") / F.col("total") - 0.5)
    value = F.round(gain * unit_idf(F.lit(n), F.coalesce("df", F.lit(0))), DIGITS)
    return mass.join(df, "term", "left").select(query, "term", value.alias("score"))


def best_keyword(scores: DataFrame, query: str = "query_id") -> DataFrame:
    """The term with the highest score of each query, ties to the first in order."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def top_keywords(scores: DataFrame, n: int = 10, query: str = "query_id") -> DataFrame:
    """The n best terms of each query with their rank from 1."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def sentence_rows(reports: DataFrame, desc: Column | None = None, more: Sequence[str] = ()) -> DataFrame:
    """bug_id, pos, sentence: the pieces of each description; more: columns to keep."""
    return reports.select(*more, "bug_id", F.posexplode(T.sentences(F.col("desc") if desc is None else desc)).alias("pos", "sentence"))


def sentences_with(rows: DataFrame, keywords: DataFrame, settings: Settings, n: int | None = None) -> DataFrame:
    """query, bug_id, pos, sentence for sentences (of query's found reports) that hold the query's keyword (query, term).
    n: the keywords, if known; some are broadcast."""
    tokens = T.tokens(T.strip_template(F.col("sentence")), settings.tokenizer, settings.ascii_boundary)
    asked = rows.join(keywords, "query_id") if n is None else met(rows, keywords, ["query_id"], n)
    return asked.filter(F.array_contains(tokens, F.col("term"))).select("query_id", "bug_id", "pos", "sentence")


def first_reports(sentences: DataFrame, ranked: DataFrame, most: int = 1000) -> DataFrame:
    """The sentences (query_id, bug_id, ...) of the reports taken in order of rank until over `most` sentences are held."""
    sizes = sentences.groupBy("query_id", "bug_id").agg(F.count(F.lit(1)).alias("n")).join(ranked.select("query_id", "bug_id", "rank"), ["query_id", "bug_id"])
    ahead = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    taken = sizes.withColumn("__ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).filter(F.col("__ahead") <= most)
    return sentences.join(taken.select("query_id", "bug_id"), ["query_id", "bug_id"], "left_semi")


def duplicate_texts(found: DataFrame, reports: DataFrame) -> DataFrame:
    """query_id, bug_id, rank, summ, desc of the reports taken for duplicates; empty texts for those that are gone."""
    texts = reports.select("bug_id", "summ", "desc")
    return found.join(texts, "bug_id", "left").select("query_id", "bug_id", "rank", F.coalesce("summ", F.lit("")).alias("summ"), F.coalesce("desc", F.lit("")).alias("desc"))


def answers(similar: DataFrame, keyword: DataFrame, sentences: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One packed answer for each incoming report that has similar ones.

    query_id, n_similar, keyword (null if no term splits them), n_sentences, sentences (array of bug_id, pos, sentence, in
    order), duplicates (ids in order of rank, comma-joined), texts (array of rank, bug_id, summ, desc), tip. sentences:
    query_id, bug_id, pos, sentence, bounded for each report by `first_reports` or `representatives`; duplicates: of
    `duplicate_texts`, a few for each report.
    """
    said = sentences.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("bug_id", "pos", "sentence"))).alias("sentences"))
    again = duplicates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "bug_id", "summ", "desc"))).alias("texts"))
    rows = similar.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_similar"))
    rows = rows.join(keyword.select("query_id", F.col("term").alias("keyword")), "query_id", "left").join(said, "query_id", "left").join(again, "query_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    ids = F.coalesce(F.array_join(F.transform("texts", lambda x: x["bug_id"].cast("string")), ","), F.lit(""))
    n_sentences = F.when(F.col("sentences").isNull(), 0).otherwise(n("sentences"))
    n_texts = F.when(F.col("texts").isNull(), 0).otherwise(n("texts"))
    return rows.select("query_id", "n_similar", "keyword", n_sentences.cast("long").alias("n_sentences"), "sentences", ids.alias("duplicates"), "texts", T.tip(n_texts, n_sentences).alias("tip"))


def representatives(rows: DataFrame, vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """query_id, bug_id, pos, sentence, cluster: of each query's sentences all if they are at most k, else the nearest to the
    centre of each of k clusters.

    vectors: query_id, bug_id, pos, term, w. k-means by cosine over exact vocabularies, within a query; its sentences are
    bounded by `first_reports`. Equal distances go to the first sentence; sentences without terms are a point of their own.
    """
    terms = vectors.groupBy("query_id", "bug_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("terms"))
    full = rows.join(terms, ["query_id", "bug_id", "pos"], "left")

    def cluster(part):
        import numpy as np

        part = part.sort_values(["bug_id", "pos"]).reset_index(drop=True)
        if len(part) <= k:
            return part.assign(cluster=range(len(part)))[names]
        bags = [dict(m) if m is not None else {} for m in part["terms"]]
        place = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
        x = np.zeros((len(part), len(place) + 1))
        for i, b in enumerate(bags):
            for t, w in b.items():
                x[i, place[t]] = w
            x[i, -1] = not b
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        r = np.random.default_rng(seed)
        centre, label = x[np.sort(r.choice(len(x), k, replace=False))], None
        for _ in range(50):
            new = (x @ centre.T).argmax(axis=1)
            if label is not None and (new == label).all():
                break
            label = new
            for c in set(label.tolist()):
                centre[c] = x[label == c].sum(axis=0)
                centre[c] /= max(np.linalg.norm(centre[c]), 1e-12)
        best = sorted({int(np.flatnonzero(label == c)[(x[label == c] @ centre[c]).argmax()]) for c in set(label.tolist())})
        return part.iloc[best].assign(cluster=label[best])[names]

    names = ["query_id", "bug_id", "pos", "sentence", "cluster"]
    return full.groupBy("query_id").applyInPandas(cluster, "query_id long, bug_id long, pos long, sentence string, cluster long")


def cluster_sentences(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """id, cluster, representative: k-means by cosine over sentence vectors (id, features), and whether the row is its
    cluster's nearest to the centre, ties to the smaller id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(vectors)
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    rows = model.transform(vectors).withColumn("__v", vector_to_array("features"))
    center = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centers]), F.col("cluster") + 1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col("__v")
    rows = rows.withColumn("__c", center).withColumn("distance", 1 - dot(v, F.col("__c")) / F.nullif(F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("__c"), F.col("__c"))), F.lit(0.0)))
    first = rows.groupBy("cluster").agg(F.min(F.struct("distance", "id")).alias("f")).select("cluster", F.col("f.id").alias("__first"))
    return rows.join(first, "cluster").select("id", F.col("cluster").cast("long").alias("cluster"), (F.col("id") == F.col("__first")).alias("representative"))


def sentence_features(weights: DataFrame, size: int = 256) -> DataFrame:
    """id, features: vectors of fixed width from term weights (id, term, w); terms are hashed to places."""
    from pyspark.ml.functions import array_to_vector

    places = weights.groupBy("id", F.pmod(F.xxhash64("term"), F.lit(size)).cast("int").alias("place")).agg(F.sum("w").alias("w"))
    entries = places.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return entries.select("id", array_to_vector(dense).alias("features"))
