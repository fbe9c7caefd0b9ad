"""Retrieval quality: samples of grouped reports, incomplete versions of them, macro precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T


def strata(sizes: DataFrame, settings: Settings) -> DataFrame:
    """group, stratum: small, middle or large; a group whose size is a bound itself is in none."""
    s, size = settings, F.col("size")
    name = F.when((size > 0) & (size < s.small_group), "small").when((size > s.small_group) & (size < s.middle_group), "middle").when((size > s.middle_group) & (size < 99999), "large")
    return sizes.select("group", name.alias("stratum")).filter("stratum IS NOT NULL")


def sample_members(members: DataFrame, groups: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """draw, group, bug_id: k draws with replacement, a group by equal chance, then a member; seeded by hashes.

    groups: group. Each draw takes the group, and in it the member, with the least hash of draw, seed and id: the hash makes
    them independent, and the minimum needs one aggregation over the groups for each of the k draws.
    """
    draws = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw")
    chance = lambda *c: F.xxhash64(F.lit(seed), F.col("draw"), *c)
    chosen = groups.select("group", draws).groupBy("draw").agg(F.min_by("group", F.struct(chance(F.col("group")), "group")).alias("group"))
    return chosen.join(members, "group").groupBy("draw", "group").agg(F.min_by("bug_id", F.struct(chance(F.col("bug_id")), "bug_id")).alias("bug_id"))


def draws(members: DataFrame, strata: DataFrame, numbers: dict[str, int], seed: int = 1) -> DataFrame:
    """stratum, draw, group, bug_id: so many draws with replacement from each stratum (of `strata`), a group by equal
    chance, then a member; the least hash of seed, draw and id decides, so reruns agree."""
    chance = lambda kind, c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(kind), F.col("draw").cast("string"), F.col(c).cast("string")).cast("binary"))
    many = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    rows = strata.filter(F.col("stratum").isin(*numbers)).withColumn("draw", F.explode(F.sequence(F.lit(1), many[F.col("stratum")])))
    chosen = rows.groupBy("stratum", "draw").agg(F.min_by("group", chance("g", "group")).alias("group"))
    return chosen.join(members, "group").groupBy("stratum", "draw", "group").agg(F.min_by("bug_id", chance("b", "bug_id")).alias("bug_id"))


def cases(drawn: DataFrame, reports: DataFrame, rates: tuple[float, ...], settings: Settings) -> DataFrame:
    """The drawn reports (bug_id, ts, product, summ, desc) without some of their words, once for each rate: the fields of a
    report line, which names the report it comes from, and rate and stratum."""
    none = F.array().cast("array<string>")
    rows = drawn.join(reports, "bug_id")
    trace = F.col("stacktrace") if "stacktrace" in reports.columns else F.array().cast("array<array<string>>")
    out = None
    for rate in rates:
        text = lambda c, rate=rate: incomplete_text(F.col(c), F.col("bug_id"), rate, settings)
        one = rows.select(
            F.lit(rate).alias("rate"), "stratum", F.col("ts").alias("create_ts"), "product", text("summ").alias("summ"), text("desc").alias("desc"), trace.alias("stacktrace"),
            none.alias("penalty"), F.col("bug_id").alias("dummy_bug_id"), none.cast("array<long>").alias("exclude_ids"), none.alias("skip_terms"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def grid_metrics(cases: DataFrame, similar_hits: DataFrame, duplicate_hits: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, rate and the means of `macro` for each pair of them, from one scored table.

    cases: query_id, rate, n_true; the hits: query_id, bug_id, hit, high (the best score of the case). What a case returns
    counts at the thresholds that its best score reaches.
    """
    at = lambda df: df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    per = lambda rows: at(rows).filter(F.col("high") >= F.col("threshold")).groupBy("threshold", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    kept = at(cases.filter("n_true > 0"))
    rows = None
    for name, found, how in (("similar", similar_hits, "left"), ("duplicate", duplicate_hits, "inner")):
        c = kept.join(per(found), ["threshold", "query_id"], how).select("threshold", "rate", "n_true", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("h", F.lit(0)).alias("h"))
        one = c.groupBy("threshold", "rate").agg(
            F.count(F.lit(1)).alias(f"{name}_cases"),
            F.round(F.avg(F.when(F.col("n") > 0, F.col("h") / F.nullif("n", F.lit(0))).otherwise(0.0)), 6).alias(f"{name}_precision"),
            F.round(F.avg(F.col("h") / F.col("n_true")), 6).alias(f"{name}_recall"),
            F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias(f"{name}_binary_recall"),
            F.round(F.avg("n"), 6).alias(f"{name}_size"),
        )
        rows = one if rows is None else rows.join(one, ["threshold", "rate"], "left")
    return rows.withColumn("duplicate_cases", F.coalesce("duplicate_cases", F.lit(0)))


def incomplete_text(text: Column, key: Column, rate: float, settings: Settings, seed: str = "drop") -> Column:
    """The tokens that stay, joined by spaces; templates go first. A rate of at most 0.001 leaves the text as it is."""
    if rate <= 0.001:
        return text
    return F.array_join(T.drop_words(T.tokens(T.strip_template(text), settings.tokenizer, settings.ascii_boundary), key, rate, seed), " ")


def macro(cases: DataFrame, similar_hits: DataFrame, duplicate_hits: DataFrame, query: str = "query_id") -> DataFrame:
    """One row: means over cases of precision, recall, whether any was hit, and size; for duplicates over the cases that have some.

    cases: query, n_true; the hits: query, bug_id, hit. Cases without true duplicates are left out. Without cases: nulls.
    """
    per = lambda rows: rows.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    kept = cases.filter("n_true > 0").select(query, "n_true")
    out = None
    for name, rows, how in (("similar", similar_hits, "left"), ("duplicate", duplicate_hits, "inner")):
        c = kept.join(per(rows), query, how).select("n_true", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("h", F.lit(0)).alias("h"))
        row = c.agg(
            F.count(F.lit(1)).alias(f"{name}_cases"),
            F.round(F.avg(F.when(F.col("n") > 0, F.col("h") / F.nullif("n", F.lit(0))).otherwise(0.0)), 6).alias(f"{name}_precision"),
            F.round(F.avg(F.col("h") / F.col("n_true")), 6).alias(f"{name}_recall"),
            F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias(f"{name}_binary_recall"),
            F.round(F.avg("n"), 6).alias(f"{name}_size"),
        )
        out = row if out is None else out.withColumn("__k", F.lit(1)).join(row.withColumn("__k", F.lit(1)), "__k").drop("__k")  # one row each
    return out


def grid(thresholds: tuple[float, ...] = (0.65, 0.70, 0.75), rates: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8)) -> list[tuple[float, float]]:
    """The parameter pairs of an experiment."""
    return [(t, r) for t in thresholds for r in rates]
