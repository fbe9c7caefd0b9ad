"""The best reports of each incoming one, exact, without scoring every report that shares a term.

Every shared term adds to a score at most its bound: the incoming report's part times the largest weight that the term has
in the corpus. Terms in order of their bounds, a report that reaches a score must hold one of the leading terms, those from
which on the bounds add up to that score; the rest, the frequent terms with the long postings, can't lift it there alone.
So pairs are formed over leading terms only, those that can still reach the score with all the rest are kept, and for
these few the rest is added up. Where a term's weight differs between reports, as it does by their length, reports are
parted into blocks of like length, and bounds hold within a block.

The score to reach follows from the data (`top`): the rarest terms of each incoming report find some reports, whose sums
so far are lower bounds; the best of them are scored in full, and the k-th of these is a score that k reports reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..lineage import checkpointed, met, written
from . import similarity
from .similarity import DIGITS

#: Reports that the first terms find for each one that is sought, about; how many of them are scored in full for the bound.
FIRST, FULL = 5, 2
#: The same for all that is sought, at least.
FIRST_LEAST, FULL_LEAST = 30, 10
#: Sums in another order may differ by less.
SLACK = 2.0 * 10**-DIGITS
#: Reports with the fewest terms that are tried for one without a common term.
WITNESSES = 200

KEYS = ["field", "term", "block"]


class Pruned:
    """Incoming and corpus vectors, ready for searches.

    ours: query_id, field, term, w; theirs: bug_id, block, field, term and w, or without w if a term weighs the same in all
    reports; weights: field, term, block, top (the largest weight in the block), df (its reports). Scores are those of the weighted strategy:
    each field's similarity (of `settings.tfidf_algorithm`) times its ratio. theirs is read several times, so it should be
    a table; terms that no incoming report has are not needed there. `formed` counts the pairs of each step; `paths` are the
    tables that the steps wrote, for who has the rows to delete (`lineage.finished`). without: query_id, bug_id of reports that are no candidates.
    """

    def __init__(self, ours: DataFrame, theirs: DataFrame, weights: DataFrame, settings: Settings, without: DataFrame | None = None):
        s = settings
        self.without = None if without is None else checkpointed(without.select("query_id", "bug_id").distinct())
        self.settings, self.theirs, self.formed, self.paths = s, theirs, {}, []
        ratio = F.when(F.col("field") == "summ", s.bug_summary_ratio).otherwise(s.bug_description_ratio)
        own = Window.partitionBy("query_id", "field")
        rows = ours.withColumn("len2", F.sum(F.col("w") * F.col("w")).over(own)) if s.tfidf_algorithm == "bidf" else ours.withColumn("len2", F.lit(1.0))
        # A field without weight is fully like every other.
        light = F.col("len2") < 1e-6
        part = F.when(light, 0.0).otherwise(ratio * F.col("w") / F.col("len2"))
        held = rows.filter("w != 0").join(weights.filter("top != 0"), ["field", "term"]).select("query_id", *KEYS, part.alias("part"), (part * F.col("top")).alias("bound"), "df")
        leading = [F.desc("bound"), "df", *KEYS]
        after = Window.partitionBy("query_id", "block").orderBy(*leading).rowsBetween(0, Window.unboundedFollowing)
        before = Window.partitionBy("query_id").orderBy(*leading).rowsBetween(Window.unboundedPreceding, -1)
        terms = held.withColumn("rest", F.sum("bound").over(after)).withColumn("found", F.coalesce(F.sum("df").over(before), F.lit(0)))
        self.terms = checkpointed(terms)
        self.n_terms = self.terms.count()
        if s.tfidf_algorithm == "bidf":
            fields = ours.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("summ"), F.lit("desc"))).alias("field"))
            sizes = fields.join(rows.groupBy("query_id", "field").agg(F.max("len2").alias("len2")), ["query_id", "field"], "left")
            base = F.sum(F.when(F.coalesce("len2", F.lit(0.0)) < 1e-6, ratio).otherwise(0.0))
            self.base = checkpointed(sizes.groupBy("query_id").agg(base.alias("base")))
        else:
            self.base = checkpointed(ours.select("query_id").distinct().withColumn("base", F.lit(0.0)))

    def _table(self, pairs: DataFrame) -> DataFrame:
        pairs, path = written(pairs, "pairs", compression="zstd")
        self.paths.append(path)
        return pairs

    def _value(self) -> Column:
        return F.col("part") * F.col("w") if "w" in self.theirs.columns else F.col("bound")

    def _sums(self, terms: DataFrame, name: str) -> DataFrame:
        """query_id, block, bug_id, s: what the terms (of incoming reports) add up to in each report that holds one."""
        pairs = met(self.theirs, terms.select("query_id", *KEYS, "part", "bound"), KEYS, self.n_terms).groupBy("query_id", "block", "bug_id").agg(F.sum(self._value()).alias("s"))
        pairs = self._table(pairs if self.without is None else pairs.join(self.without, ["query_id", "bug_id"], "left_anti"))
        self.formed[name] = self.formed.get(name, 0) + pairs.count()
        return pairs

    def _filled(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """pairs with the value of the terms added to s."""
        pairs = self._table(pairs)
        rows = met(self.theirs, pairs.select("query_id", "bug_id"), ["bug_id"], pairs.count())
        more = met(rows, terms.select("query_id", *KEYS, "part", "bound"), ["query_id", *KEYS], self.n_terms)
        more = more.groupBy("query_id", "bug_id").agg(F.sum(self._value()).alias("more"))
        return pairs.join(more, ["query_id", "bug_id"], "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0.0))).drop("more")

    def _scored(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.base, "query_id").select("query_id", "bug_id", F.round(F.col("s") + F.col("base"), DIGITS).alias("score"))

    def reaching(self, least: DataFrame) -> DataFrame:
        """query_id, bug_id, score of all reports that share a term and score `least` (query_id, least) or more."""
        terms = self.terms.join(least.join(self.base, "query_id").select("query_id", (F.col("least") - F.col("base") - SLACK).alias("need")), "query_id")
        leading = F.col("rest") >= F.col("need")
        left = checkpointed(terms.groupBy("query_id", "block").agg(F.max("need").alias("need"), F.coalesce(F.max(F.when(~leading, F.col("rest"))), F.lit(0.0)).alias("left")))
        pairs = self._sums(terms.filter(leading), "reaching")
        pairs = pairs.join(left, ["query_id", "block"]).filter(F.col("s") + F.col("left") >= F.col("need")).select("query_id", "bug_id", "s")
        rows = self._scored(self._filled(pairs, terms.filter(~leading)))
        return rows.join(least, "query_id").filter(F.col("score") >= F.col("least")).select("query_id", "bug_id", "score")

    def bound(self, k: int) -> DataFrame:
        """query_id, least: a score that k reports reach, for every incoming report; 0 if fewer share a term."""
        start = F.col("found") < max(FIRST * k, FIRST_LEAST)
        first = self._sums(self.terms.filter(start), "first")
        best = similarity.top(first.select("query_id", "bug_id", F.col("s").alias("score")), max(FULL * k, FULL_LEAST)).select("query_id", "bug_id", F.col("score").alias("s"))
        full = similarity.top(self._scored(self._filled(best, self.terms.filter(~start))), k)
        kth = full.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        return checkpointed(self.base.select("query_id").join(kth, "query_id", "left").select("query_id", F.coalesce("least", F.lit(0.0)).alias("least")))

    def top(self, k: int) -> DataFrame:
        """query_id, bug_id, score, rank: the k best reports of each incoming one, as `similarity.top` of all scores."""
        return similarity.top(self.reaching(self.bound(k)), k)

    def least_scores(self, n_reports: int) -> DataFrame:
        """query_id, low: the least score over all reports, 0 where one of them shares no term.

        Such a report is looked for among those with the fewest terms; an incoming report that shares a term with all of
        these is scored against every report.
        """
        sizes = self.theirs.groupBy("bug_id").agg(F.count(F.lit(1)).alias("m"))
        if self.without is None and sizes.count() < n_reports:
            return self.base.select("query_id", F.lit(0.0).alias("low"))
        few = checkpointed(sizes.orderBy("m", "bug_id").limit(WITNESSES).select("bug_id"))
        shared = met(self.theirs, few, ["bug_id"], WITNESSES).join(self.terms.select("query_id", *KEYS), KEYS).select("query_id", "bug_id")
        if self.without is not None:  # those that are no candidates witness nothing
            shared = shared.unionByName(self.without.join(few, "bug_id"))
        shared = shared.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
        held = self.base.select("query_id").join(shared.filter(F.col("m") >= few.count()), "query_id", "left").withColumn("all", F.col("m").isNotNull())
        held = checkpointed(held.select("query_id", "all"))
        open_ = held.filter("all")
        if open_.isEmpty():
            return held.select("query_id", F.lit(0.0).alias("low"))
        scores = self._scored(self._sums(self.terms.join(open_, "query_id", "left_semi"), "least"))
        all_of = F.lit(n_reports)
        if self.without is not None:
            fewer = self.without.groupBy("query_id").agg(F.count(F.lit(1)).alias("fewer"))
            scores, all_of = scores.join(fewer, "query_id", "left"), F.lit(n_reports) - F.coalesce(F.max("fewer"), F.lit(0))
        low = scores.groupBy("query_id").agg(F.when(F.count(F.lit(1)) < all_of, 0.0).otherwise(F.min("score")).alias("low"))
        return held.join(low, "query_id", "left").select("query_id", F.coalesce("low", F.lit(0.0)).alias("low"))

    def similar(self, n_reports: int) -> DataFrame:
        """query_id, bug_id, score, cut, rank: as `similarity.similar` of all scores, the least of them over all reports."""
        s = self.settings
        best = self.top(1).select("query_id", F.col("score").alias("high")).filter(F.col("high") >= s.bug_no_similar_threshold)
        cut = F.round(F.col("low") + (F.col("high") - F.col("low")) * s.bug_similar_percent, DIGITS)
        cuts = checkpointed(best.join(self.least_scores(n_reports), "query_id").select("query_id", cut.alias("cut")))
        rows = self.reaching(cuts.withColumnRenamed("cut", "least"))
        return similarity.top(rows.join(cuts, "query_id"), s.bug_similar_max).select("query_id", "bug_id", "score", "cut", "rank")
