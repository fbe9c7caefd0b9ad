"""Similarity of incoming reports to a corpus: sparse products, scores, rankings and cuts.

Products run over an inverted index: incoming and corpus terms meet in an equi-join, so the work follows the postings of
the incoming terms. Reports that share no term score 0 and are never paired; how many there are is known by counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.stacktrace import TRACE, stack_similarity
from ..lineage import checkpointed, met, spread_join

#: Scores are rounded before they are ranked, so that the order of sums doesn't decide ties.
DIGITS = 6
#: Incoming reports that are broadcast, at most.
SENT = 100_000


def products(incoming: DataFrame, corpus: DataFrame, query: str = "query_id", key: str = "bug_id", n_terms: int | None = None) -> DataFrame:
    """query, key, summ, desc: sparse products of each field for pairs that share a term. A weight of 0 adds nothing, and is left out.

    n_terms: the incoming rows, if known; some are broadcast, so that a corpus dealt by key is not shuffled again.
    """
    q = incoming.filter("w != 0").select(query, "field", "term", F.col("w").alias("qw"))
    c = corpus.filter("w != 0").select(key, "field", "term", F.col("w").alias("cw"))
    part = lambda f: F.coalesce(F.sum(F.when(F.col("field") == f, F.col("qw") * F.col("cw"))), F.lit(0.0)).alias(f)
    pairs = q.join(c, ["field", "term"]) if n_terms is None else met(c, q, ["field", "term"], n_terms)
    return pairs.groupBy(query, key).agg(part("summ"), part("desc"))


def penalties(corpus: DataFrame, terms: DataFrame, query: str = "query_id", key: str = "bug_id") -> DataFrame:
    """query, key, penalty: the weight of unwanted terms (query, term) in a report's description."""
    return corpus.filter("field = 'desc'").join(terms.distinct(), "term").groupBy(query, key).agg(F.sum("w").alias("penalty"))


def asymmetric(dot: Column, len2: Column, penalty: Column | None = None, penalty_weight: float = 100.0) -> Column:
    """The product over the primary's squared length, less the penalty, at least 0; 1 for a primary without weight."""
    top = dot if penalty is None else dot - penalty_weight * penalty
    return F.when(F.coalesce(len2, F.lit(0.0)) < 1e-6, 1.0).otherwise(F.greatest(F.lit(0.0), top / len2))


def similarities(incoming: DataFrame, corpus: DataFrame, settings: Settings, unwanted: DataFrame | None = None, query: str = "query_id", key: str = "bug_id", n_terms: int | None = None) -> DataFrame:
    """query, key, rs, rd: similarity of summaries and descriptions for pairs that share a term. n_terms: as for `products`."""
    pairs = products(incoming, corpus, query, key, n_terms)
    if settings.tfidf_algorithm == "tfidf":
        return pairs.select(query, key, F.col("summ").alias("rs"), F.col("desc").alias("rd"))
    length = incoming.groupBy(query).agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("w") * F.col("w"))), F.lit(0.0)).alias(f"{f}_len2") for f in ("summ", "desc")])
    pairs = pairs.join(length, query) if n_terms is None else met(pairs, length, [query], n_terms)
    penalty = None
    if unwanted is not None:
        pairs = pairs.join(penalties(corpus, unwanted, query, key), [query, key], "left")
        penalty = F.coalesce("penalty", F.lit(0.0))
    rs = asymmetric(F.col("summ"), F.col("summ_len2"))
    rd = asymmetric(F.col("desc"), F.col("desc_len2"), penalty, settings.penalty_weight)
    return pairs.select(query, key, rs.alias("rs"), rd.alias("rd"))


def score(rs: Column, rd: Column, rt: Column, settings: Settings, has_stack: Column | None = None) -> Column:
    """One score from the similarities of summary, description and stack trace."""
    s = settings
    nl = rs * s.bug_summary_ratio + rd * s.bug_description_ratio
    if s.scoring_strategy == "weighted":
        return nl + rt * s.bug_stacktrace_ratio
    if s.scoring_strategy == "distweighted":
        p = s.bug_primary_ratio
        both = p * F.greatest(nl, rt) + (1 - p) * F.least(nl, rt)
        return F.when(F.coalesce(has_stack, F.lit(False)) if has_stack is not None else F.lit(True), both).otherwise(p * nl + (1 - p))
    if s.scoring_strategy != "heuristic":
        raise ValueError(f"no such strategy: {s.scoring_strategy}")
    alike, traced = nl > s.bug_nl_threshold, rt > s.bug_stacktrace_threshold
    return (
        F.when(alike & traced, 0.75 + 0.25 * (nl + rt) / 2)
        .when(alike, 0.5 + 0.25 * nl)
        .when(traced, 0.25 + 0.25 * rt)
        .otherwise(0.25 * (nl + rt) / 2)
    )


def candidates(incoming: DataFrame, reports: DataFrame, settings: Settings, sent: int = SENT) -> DataFrame:
    """query_id, bug_id: reports of the product that are not older than the window nor excluded, nor the report itself.

    incoming: query_id, product, ts (null: no bound), exclude (array or null), dummy_bug_id (or null). Up to `sent` of them
    are broadcast, so reports are filtered where they lie; more meet them in a range join (`in_ranges`).
    """
    q = incoming.select("query_id", "product", F.col("ts").alias("__ts"), "exclude", "dummy_bug_id")
    rows = reports.select("bug_id", "product", "ts")
    pairs = rows.join(F.broadcast(q), "product") if q.count() <= sent else in_ranges(q, rows, settings.window_seconds)
    return pairs.filter(is_candidate(settings)).select("query_id", "bug_id")


def in_ranges(q: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """Rows (product, ts, ...) beside the incoming reports (product, __ts, ...) of their product, but for those of buckets of
    time that end before an incoming report's window.

    Buckets are as wide as the window. An incoming report goes to the buckets of its product that there are, from that in
    which its window starts; a bucket of a product that holds many rows is split, whatever part of all rows it is.
    """
    rows = checkpointed(rows.withColumn("__bucket", F.floor(F.col("ts") / window)))
    counts = checkpointed(rows.groupBy("product", "__bucket").agg(F.count(F.lit(1)).alias("__m")))
    from_ = F.floor((F.col("__ts") - window) / window)
    there = q.withColumn("__from", from_).join(counts.select("product", "__bucket"), "product")
    there = there.filter(F.col("__ts").isNull() | F.col("__bucket").isNull() | (F.col("__bucket") >= F.col("__from"))).drop("__from")
    # Rows without a time are in no window, only with incoming reports without one.
    null = F.lit(-(1 << 60))
    keyed = lambda df: df.withColumn("__bucket", F.coalesce("__bucket", null))
    return spread_join(keyed(rows), keyed(there), ["product", "__bucket"], counts=keyed(counts)).drop("__bucket")


def is_candidate(settings: Settings) -> Column:
    """On pairs with bug_id, ts, __ts, exclude, dummy_bug_id."""
    young = F.col("__ts").isNull() | (F.col("ts") > F.col("__ts") - settings.window_seconds)
    excluded = F.coalesce(F.array_contains("exclude", F.col("bug_id")), F.lit(False))
    return young & ~excluded & ~F.coalesce(F.col("dummy_bug_id") == F.col("bug_id"), F.lit(False))


def over_candidates(incoming: DataFrame, reports: DataFrame, ours: DataFrame, theirs: DataFrame, settings: Settings, unwanted: DataFrame | None = None) -> DataFrame:
    """query_id, bug_id, rs, rd, rt, score for every candidate of each incoming report, those that share no term included.

    incoming: as for `candidates`, and stacktrace; reports: bug_id, product, ts, stacktrace; ours, theirs: their vectors. A
    field of an incoming report without weight is fully like every other; an incoming report without a trace is taken to
    have the other's. The vectors meet within products only.
    """
    product_of = lambda v, r, key: v.join(r.select(key, "product"), key).withColumn("term", F.concat_ws("\x00", "product", "term")).drop("product")
    pairs = similarities(product_of(ours, incoming, "query_id"), product_of(theirs, reports, "bug_id"), settings, unwanted)
    weight = ours.groupBy("query_id").agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("w") * F.col("w"))), F.lit(0.0)).alias(f"__{f}") for f in ("summ", "desc")])
    empty = lambda f: F.when(F.lit(settings.tfidf_algorithm == "bidf") & (F.coalesce(F.col(f"__{f}"), F.lit(0.0)) < 1e-6), 1.0).otherwise(0.0)
    rows = candidates(incoming, reports, settings).join(pairs, ["query_id", "bug_id"], "left").join(weight, "query_id", "left")
    rows = rows.join(incoming.select("query_id", F.col("stacktrace").alias("__ours")), "query_id").join(reports.select("bug_id", F.col("stacktrace").alias("__theirs")), "bug_id")
    has_stack = F.exists(F.coalesce("__ours", F.array().cast(TRACE)), lambda t: F.size(t) > 0)
    rt = F.when(~has_stack, 1.0).otherwise(stack_similarity(F.col("__ours"), F.col("__theirs"), settings.stacktrace_algorithm))
    rows = rows.select("query_id", "bug_id", F.coalesce("rs", empty("summ")).alias("rs"), F.coalesce("rd", empty("desc")).alias("rd"), rt.alias("rt"), has_stack.alias("__has"))
    return rows.withColumn("score", F.round(score(F.col("rs"), F.col("rd"), F.col("rt"), settings, F.col("__has")), DIGITS)).drop("__has")


def top(scored: DataFrame, n: int, query: str = "query_id", key: str = "bug_id", value: str = "score") -> DataFrame:
    """The n best of each query, ties to the smaller key, with their rank from 1."""
    order = Window.partitionBy(query).orderBy(F.desc(value), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def similar(scored: DataFrame, settings: Settings, n_candidates: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """Scored rows at or over the cut, where the best reaches the least score; at most bug_similar_max a query.

    cut = min + (max - min) * percent. n_candidates (query, n): candidates of a query; if more than are scored, the rest
    share no term and the least score is 0.
    """
    s = settings
    spread = scored.groupBy(query).agg(F.min("score").alias("__min"), F.max("score").alias("__max"), F.count(F.lit(1)).alias("__n"))
    if n_candidates is not None:
        spread = spread.join(n_candidates.select(query, F.col("n").alias("__all")), query, "left").withColumn("__min", F.when(F.col("__all") > F.col("__n"), F.least(F.lit(0.0), "__min")).otherwise(F.col("__min")))
    spread = spread.filter(F.col("__max") >= s.bug_no_similar_threshold)
    cut = F.round(F.col("__min") + (F.col("__max") - F.col("__min")) * s.bug_similar_percent, DIGITS)
    rows = scored.join(spread.select(query, cut.alias("cut")), query).filter(F.col("score") >= F.col("cut"))
    return top(rows, s.bug_similar_max, query)


def duplicates(similar_rows: DataFrame, groups: DataFrame, settings: Settings, query: str = "query_id") -> DataFrame:
    """The first similar rows of queries whose similar rows fall in few enough groups (bug_id, group)."""
    grouped = similar_rows.join(groups.select("bug_id", "group"), "bug_id", "left")
    few = grouped.groupBy(query).agg(F.countDistinct("group").alias("n_groups")).filter(F.col("n_groups") <= settings.bug_duplicate_threshold)
    return similar_rows.join(few, query).filter(F.col("rank") <= settings.bug_duplicate_number)


def at_least(scores: Column, target: Column) -> Column:
    """How many elements of a descending array reach the target; -1 for an empty array."""
    return F.when(F.size(scores) == 0, F.lit(-1)).otherwise(F.size(F.filter(scores, lambda x: x >= target)))


def distribution(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """query, n, near_top (scores over the last tenth of the span), q0 ... q100: scores at parts of the descending list.

    ranked: the rows with their rank from 1.
    """
    spread = ranked.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("__max"), F.min("score").alias("__min"))
    rows = ranked.join(spread, query)
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1) + 1
    near = F.count_if(F.col("score") > F.round(F.col("__max") - (F.col("__max") - F.col("__min")) * 0.1, DIGITS)).alias("near_top")
    return rows.groupBy(query, "n").agg(near, *[F.max(F.when(F.col("rank") == at(q / 100), F.col("score"))).alias(f"q{q}") for q in (0, 20, 40, 60, 80, 100)])


def positions(ranked: DataFrame, truth: DataFrame, query: str = "query_id") -> DataFrame:
    """query, bug_id, position (from 0), score of the true duplicates (query, bug_id) among the ranked rows."""
    return ranked.join(truth.select(query, "bug_id").distinct(), [query, "bug_id"]).select(query, "bug_id", (F.col("rank") - 1).alias("position"), "score")
