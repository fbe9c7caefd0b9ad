"""Quality rules: counts over every whole text, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

The verdict compares two multinomials over word unigrams and bigrams: one of the trusted documents (all labels of the
document say quality 1), one of the whole corpus. N-grams are hashed into buckets, whose number grows with the square root
of the corpus (`bucket_count`), about as its vocabulary does. A document's score is the mean, over its n-grams, of
log(p_trusted / p_corpus). The trusted counts are smoothed towards the corpus by as many n-grams as the trusted documents
have, so a score means the same at each size of corpus. Log ratios are kept as fixed-point integers, so sums do not depend
on the order of rows.

Buckets are counted where the texts lie, so only counts are shuffled: a row for each bucket and task, and the tasks grow
with the buckets, so these rows grow like the corpus. The model is a table that meets the n-grams by a broadcast up to
BROADCAST buckets (the bound of what is sent) and by a shuffle beyond, the heaviest buckets aside; the result is the same.
The texts of labelled documents move, once, to their labels: a bitmap of the labelled ids, BITS at most, keeps most others
where they are (the join that follows decides). What moved is hashed once; its counts and its n-grams' buckets are kept in
a table, from which the model, these documents' scores and the cuts are made. Other texts are read twice.

The least score is set for each language (`lang`, if docs have it) from labelled documents that pass the base rules, each
scored without the trusted counts of its own text: where the shares kept of the trusted and of the bad ones (some label
says quality 0) differ most. A language without labelled documents of both kinds is judged by the base rules alone.

Defined results: a null text counts as empty; an empty text has all counts 0, base_failed true, kept false, score null;
without any trusted document the ratio says nothing and kept is not base_failed; repeated rows are each judged alike; a
null doc_id is returned as null; columns but doc_id, text and lang are ignored by `quality_rules` and returned by `keep_good`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import removed, written
from .common import SPACES, checkpointed, texts

#: Buckets for each square root of the corpus' bytes; the number is rounded up to a power of two.
GROWTH = 8
#: Buckets that are broadcast, at most; more meet the n-grams by a shuffle.
BROADCAST = 1 << 22
#: Bits of the bitmap of labelled ids, at most, and for each id.
BITS, BITS_EACH = 1 << 23, 8
#: Buckets for each task that counts n-grams.
EACH = 8192
#: Languages whose cuts are broadcast, at most.
LANGUAGES = 10_000
#: Log ratios are summed in units of 2**-10.
UNIT = 1 << 10

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bucket_count(docs: DataFrame) -> int:
    """The number of buckets for a corpus: grows with the square root of its bytes, from 2 ** 14 up."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(14, math.ceil(math.log2(GROWTH * math.sqrt(size + 1))))


def _tail(items: Column, start: int, n: Column) -> Column:
    return F.slice(items, F.lit(start), F.greatest(n, F.lit(0)))


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, the counts of a text but the last, __w: hashes of the words, __b: of the pairs of adjacent words.

    Texts and words go no further than the step that hashes them: later steps carry eight bytes a word.
    """
    df = docs.withColumn("__words", F.array_remove(F.split("text", SPACES), ""))
    df = df.withColumn("__lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__w"),
    )
    n = F.size("__w")
    return df.withColumn("__b", F.zip_with(_tail(F.col("__w"), 1, n - 1), _tail(F.col("__w"), 2, n - 1), lambda a, b: F.xxhash64(a, b)))


def _grams() -> Column:
    return F.concat("__w", "__b")


def _repeated() -> tuple[Column, Column, Column]:
    """Three columns in a row, __t, __s and n_repeat_words: equal windows meet by sorting their hashes, in n log n."""
    n = F.size("__w")
    threes = F.zip_with(_tail(F.col("__b"), 1, n - 2), _tail(F.col("__w"), 3, n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.when(F.size(F.array_distinct("__t")) < F.size("__t"), F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    m = F.size("__s")
    # Neighbours in the sorted order that are the same window: both places' words are repeated.
    same = F.zip_with(
        _tail(F.col("__s"), 1, m - 1),
        _tail(F.col("__s"), 2, m - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    repeated = F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    return threes, windows, F.when(F.col("__s").isNull(), 0).otherwise(repeated).cast("long")


def _counted(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, all counts, base_failed and __g, the hashes of the n-grams."""
    threes, windows, repeated = _repeated()
    df = _hashed(docs, *keep)
    df = df.select(*keep, *COUNTS[:-1], _grams().alias("__g"), threes.alias("__t")).select(*keep, *COUNTS[:-1], "__g", windows.alias("__s"))
    df = df.select(*keep, *COUNTS[:-1], "__g", repeated.alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets).cast("long"))


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


class Labelled:
    """Counts of the rows that may have labels, as a table: the columns `keep`, the counts, base_failed, __label (1 trusted,
    0 bad, else null), grams: array of (bucket, c), the distinct buckets of a row and how often each is there. `maybe` tells
    these rows of docs from all others."""

    def __init__(self, table: DataFrame, maybe: Column, keep: list[str]):
        self.table, self.maybe, self.keep = table, maybe, keep


def _labels(labels: DataFrame) -> tuple[DataFrame, Column]:
    """doc_id, __label (1 trusted, 0 bad), and which rows of docs may have one: all that have, few others."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__label")).filter("__label IN (0, 1)")
    known = checkpointed(known)
    bits = 1 << max(6, min(BITS.bit_length() - 1, (BITS_EACH * known.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int")
    parts = known.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))).alias("bits"))
    bitmap = ["0"] * (bits // 64)
    for r in parts.collect():  # at most BITS / 64 rows
        bitmap[r["at"]] = str(r["bits"])
    maybe = F.getbit(F.get(F.split(F.lit(",".join(bitmap)), ",").cast("array<long>"), F.shiftright(place, 6)), place.bitwiseAND(63)) == 1
    return known, F.col("doc_id").isNotNull() & maybe


def _rows(docs: DataFrame, text_key: bool) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(_lang(docs)).alias("__key"))
    return rows.withColumn("__text", F.xxhash64("text")) if text_key else rows


def labelled_counts(docs: DataFrame, labels: DataFrame, buckets: int, text_key: bool = False) -> tuple[Labelled, str]:
    """The counts of the rows that may have labels, and the table's path."""
    known, maybe = _labels(labels)
    keep = ["doc_id", "__key", *["__text"] * text_key]
    slim = [*keep, *COUNTS, "base_failed", "__label"]
    rows = _rows(docs.filter(maybe), text_key).join(known.hint("shuffle_hash"), "doc_id", "left")
    rows = _counted(rows, *keep, "__label").select(*slim, F.sort_array(F.transform("__g", lambda h: _bucket(h, buckets).cast("int"))).alias("__s"))
    starts = F.filter(F.transform("__s", lambda _, i: i), lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1)))
    rows = rows.select("*", starts.alias("__i"))
    runs = F.zip_with("__i", _tail(F.col("__i"), 2, F.size("__i") - 1), lambda a, b: F.struct(F.get("__s", a).alias("bucket"), (F.coalesce(b, F.size("__s")) - a).alias("c")))
    table, path = written(rows.select(*slim, runs.alias("grams")), "labelled")
    return Labelled(table, maybe, keep), path


def bucket_counts(docs: DataFrame, labelled: Labelled, buckets: int) -> DataFrame:
    """bucket, r (its n-grams in all documents), g (in the trusted)."""
    # A task gives a row for each bucket: its own share of the texts must grow as the buckets do.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, buckets // EACH)
    rest = _hashed(texts(docs.coalesce(tasks).filter(~labelled.maybe))).select(F.explode(_grams()).alias("h"))
    rest = rest.select(_bucket(F.col("h"), buckets).alias("bucket"), F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("g"))
    own = labelled.table.coalesce(tasks).select("__label", F.inline("grams"))
    own = own.select(F.col("bucket").cast("long").alias("bucket"), F.col("c").cast("long").alias("r"), F.when(F.col("__label") == 1, F.col("c")).otherwise(0).cast("long").alias("g"))
    return rest.unionByName(own).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("g").alias("g"))


class Model:
    """Counts of all documents (r) and of the trusted (g) by bucket, and their totals."""

    def __init__(self, docs: DataFrame, labelled: Labelled, buckets: int):
        self.buckets = buckets
        self.table = checkpointed(bucket_counts(docs, labelled, buckets))
        totals = self.table.agg(F.coalesce(F.sum("r"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0))).first()
        self.raw, self.good = int(totals[0]), int(totals[1])
        self.prior = float(max(self.good, 1))

    def ratio(self, g: Column) -> Column:
        """The fixed-point log ratio of a bucket with r of the corpus and g of the trusted."""
        ratio = (g * F.lit(float(self.raw)) / F.col("r") + self.prior) / F.lit(self.good + self.prior)
        return F.rint(F.log(ratio) * UNIT).cast("long")  # round() would go through decimals

    def meets(self, grams: DataFrame, columns: list[str | Column]) -> DataFrame:
        """grams (with bucket, which may be null) and `columns` of the model."""
        table = self.table.select("bucket", *columns)
        if self.buckets <= BROADCAST:
            return grams.join(F.broadcast(table), "bucket", "left")
        # More than one n-gram in 2 ** 14: at most 2 ** 14 buckets, so that none of them crowds a task.
        often = F.broadcast(self.table.filter(F.col("r") > self.raw / (1 << 14)).select("bucket"))
        heavy = grams.join(F.broadcast(self.table.filter(F.col("r") > self.raw / (1 << 14)).select("bucket", *columns)), "bucket")
        rest = grams.filter("bucket IS NOT NULL").join(often, "bucket", "left_anti").join(table.hint("merge"), "bucket")
        none = grams.filter("bucket IS NULL").select("*", *[F.lit(None).alias(c) for c in table.columns[1:]])
        return heavy.unionByName(rest).unionByName(none)


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of docs (text: not null), the counts, base_failed and score: one row a row, in one reading."""
    slim = [*keep, *COUNTS, "base_failed"]
    # Numbered, so that equal rows stay apart; a task that is done again numbers its rows alike.
    rows = _counted(docs, *keep).withColumn("__row", F.monotonically_increasing_id())
    grams = rows.select("__row", *slim, F.explode_outer("__g").alias("__h")).select("__row", *slim, _bucket(F.col("__h"), model.buckets).alias("bucket"))
    sums = model.meets(grams, [model.ratio(F.col("g")).alias("__v")]).groupBy("__row").agg(*[F.first(c).alias(c) for c in slim], F.sum("__v").alias("__t"))
    return sums.select(*slim, _mean("__t").alias("score"))


def _mean(total: str) -> Column:
    """The mean of a text's log ratios, null without n-grams."""
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    return F.when(n > 0, F.col(total) / F.lit(float(UNIT)) / n)


def judged(labelled: Labelled, model: Model) -> DataFrame:
    """What `scored` gives, of the rows that may have labels, and __label and own: of the trusted, score without what the
    document itself adds to the trusted counts; of the bad ones, score; null if the base rules reject it or without label."""
    slim = [*labelled.keep, *COUNTS, "base_failed", "__label"]
    rows = labelled.table.withColumn("__row", F.monotonically_increasing_id())
    grams = rows.select("__row", *slim, F.inline_outer("grams")).withColumn("bucket", F.col("bucket").cast("long"))
    met = model.meets(grams, ["r", "g", model.ratio(F.col("g")).alias("__v")])
    trusted = (F.col("__label") == 1) & ~F.col("base_failed")
    left = F.when(trusted, model.ratio(F.greatest(F.col("g") - F.col("c"), F.lit(0)))).otherwise(F.col("__v"))
    sums = met.groupBy("__row").agg(*[F.first(c).alias(c) for c in slim], F.sum(F.col("c") * F.col("__v")).alias("__t"), F.sum(F.col("c") * left).alias("__o"))
    total = F.lit(model.good + model.prior)
    less = F.when(trusted, F.log(total / F.greatest(total - (2 * F.col("n_words") - 1), F.lit(1.0)))).otherwise(0.0)
    own = F.when(F.col("__label").isNotNull() & ~F.col("base_failed"), _mean("__o") + less)
    return sums.select(*slim, _mean("__t").alias("score"), own.alias("own"))


def own_scores(labelled: Labelled, model: Model) -> DataFrame:
    """__key, __label, own of the labelled documents that pass the base rules."""
    return judged(labelled, model).filter("own IS NOT NULL").select("__key", "__label", "own")


def cuts(own: DataFrame) -> DataFrame:
    """__key (of a language), cut: the score that best tells the trusted documents from the bad ones of that language."""
    bins = own.groupBy("__key", F.floor(F.col("own") * UNIT).alias("bin")).agg(F.count(F.when(F.col("__label") == 1, 1)).alias("t"), F.count(F.when(F.col("__label") == 0, 1)).alias("b"))
    whole, upward = Window.partitionBy("__key"), Window.partitionBy("__key").orderBy("bin")
    below = upward.rowsBetween(Window.unboundedPreceding, -1)
    gain = F.sum("b").over(below) / F.sum("b").over(whole) - F.sum("t").over(below) / F.sum("t").over(whole)
    both = bins.withColumn("kinds", F.least(F.sum("b").over(whole), F.sum("t").over(whole)))
    rows = both.filter("kinds > 0").select("__key", "bin", gain.alias("gain"), ((F.lag("bin").over(upward) + 1 + F.col("bin")) / F.lit(2.0 * UNIT)).alias("cut"))
    best = rows.filter("gain > 0").groupBy("__key").agg(F.max(F.struct("gain", (-F.col("bin")).alias("bin"), "cut")).alias("best"))
    return best.select("__key", F.col("best.cut").alias("cut"))


def verdicts(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float | None = None, *, text_key: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept for every row of docs; __text, a hash of the text, if asked for."""
    buckets = buckets or bucket_count(docs)
    labelled, path = labelled_counts(docs, labels, buckets, text_key)
    model = Model(docs, labelled, buckets)
    told = checkpointed(judged(labelled, model))
    removed(docs.sparkSession, path)
    cut = checkpointed(cuts(told.filter("own IS NOT NULL"))) if threshold is None else None
    keep = labelled.keep
    rows = scored(_rows(docs.filter(~labelled.maybe), text_key), model, *keep).unionByName(told.drop("__label", "own"))
    if cut is not None:
        rows = rows.join(F.broadcast(cut) if cut.count() <= LANGUAGES else cut, "__key", "left")
    else:
        rows = rows.withColumn("cut", F.lit(threshold))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("cut"), F.lit(True))
    return rows.select(*keep, *COUNTS, "base_failed", "score", kept.alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept for every row of docs. `buckets`: else as `bucket_count` says;
    `threshold`: else cuts from the labels."""
    return verdicts(docs, labels, buckets, threshold).drop("__key")


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float | None = None) -> DataFrame:
    """The rows of docs, all their columns, that are kept."""
    # A verdict depends on text and language alone; the id keeps copies apart, so that no group of them fills a task.
    keys = ["__id", "__text", "__key"]
    bad = verdicts(docs, labels, buckets, threshold, text_key=True).filter("NOT kept")
    bad = bad.select(F.xxhash64("doc_id").alias("__id"), "__text", "__key").distinct()
    keyed = docs.select("*", F.xxhash64("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"), F.xxhash64(_lang(docs)).alias("__key"))
    return keyed.join(bad, keys, "left_anti").select(docs.columns)
