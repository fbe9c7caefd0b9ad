"""Term counts, document counts and term weights in long form: bug_id, field (summ or desc), term, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..config import Settings
from ..functions import text as T
from ..functions.stem import STEMMERS, stem_table
from ..functions.words import DOMAIN_STOP_WORDS, STOP_WORDS, SYNONYMS
from ..lineage import SENT, checkpointed, met

FIELDS = ("summ", "desc")
#: Terms whose document counts are broadcast, at most.
HOT = 250_000
#: Lists of tokens that a task counts at once.
LISTS = 1000


def _token_lists(reports: DataFrame, settings: Settings, key: str, strip: bool = True) -> DataFrame:
    """key, f (field, terms): each field's tokens; templates are removed from descriptions only."""
    desc = T.strip_template(F.col("desc")) if strip else F.col("desc")
    split = lambda c: T.tokens(c, settings.tokenizer, settings.ascii_boundary)
    each = F.array(F.struct(F.lit("summ").alias("field"), split(F.col("summ")).alias("terms")), F.struct(F.lit("desc").alias("field"), split(desc).alias("terms")))
    return reports.select(key, F.explode(each).alias("f"))


def token_rows(reports: DataFrame, settings: Settings, key: str = "bug_id", strip: bool = True) -> DataFrame:
    """key, field, pos, term: every token; templates are removed from descriptions only."""
    return _token_lists(reports, settings, key, strip).select(key, "f.field", F.posexplode("f.terms").alias("pos", "term"))


def stemmed(rows: DataFrame, settings: Settings) -> DataFrame:
    """Terms replaced by their stems, which are computed once for each distinct word."""
    if settings.stemmer == "none":
        return rows
    stems = stem_table(rows.select("term"), settings.stemmer)
    return rows.join(stems, rows["term"] == stems["word"]).drop("word", "term").withColumnRenamed("stem", "term")


def is_stop_word(term: Column, settings: Settings) -> Column:
    """Terms under three letters and stop words. The English list is not stemmed, so a stem that differs from its word stays."""
    stem = STEMMERS[settings.stemmer]
    return (F.length(term) < 3) | term.isin(*STOP_WORDS, *map(stem, DOMAIN_STOP_WORDS))


def bags(rows: DataFrame, settings: Settings, key: str = "bug_id", stop_words: bool = True, synonyms: bool = True) -> DataFrame:
    """key, field, term, tf from token rows: stems are counted, then stop words go, then synonyms come."""
    counts = stemmed(rows, settings).groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    if stop_words:
        counts = counts.filter(~is_stop_word(F.col("term"), settings))
    return expanded(counts, settings, key) if synonyms else counts


def synonym_pairs(settings: Settings) -> list[tuple[str, str]]:
    stem = STEMMERS[settings.stemmer]
    return sorted({(stem(a), stem(b)) for group in SYNONYMS for a in group for b in group if stem(a) != stem(b)})


def expanded(counts: DataFrame, settings: Settings, key: str = "bug_id") -> DataFrame:
    """Adds the absent synonyms of each term with its count; of several counts the largest."""
    # A fixed list of a few pairs, held in the plan: no join.
    pairs = synonym_pairs(settings)
    also = F.create_map(*[x for a in sorted({a for a, _ in pairs}) for x in (F.lit(a), F.array(*[F.lit(d) for c, d in pairs if c == a]))])
    added = counts.filter(F.col("term").isin(*sorted({a for a, _ in pairs}))).select(key, "field", F.explode(also[F.col("term")]).alias("term"), "tf")
    added = added.groupBy(key, "field", "term").agg(F.max("tf").alias("tf"))
    absent = added.join(counts.select(key, "field", "term"), [key, "field", "term"], "left_anti")
    return counts.unionByName(absent)


def term_counts(reports: DataFrame, settings: Settings, key: str = "bug_id", synonyms: bool = True) -> DataFrame:
    return bags(token_rows(reports, settings, key), settings, key, synonyms=synonyms)


def local_counts(reports: DataFrame, settings: Settings, key: str = "bug_id") -> DataFrame:
    """key, field, term, tf as `term_counts` without synonyms, counted where a report lies, so that no token is shuffled.

    Stems, and reports of a key that is there more than once, meet by a shuffle.
    """
    if settings.stemmer != "none":
        return term_counts(reports, settings, key, synonyms=False)
    again = checkpointed(reports.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col(key).alias("__again")))
    n = again.count()
    if n:
        few, same = (F.broadcast(again) if n <= SENT else again), reports[key].eqNullSafe(F.col("__again"))
        repeated = term_counts(reports.join(few, same, "left_semi"), settings, key, synonyms=False)
        reports = reports.join(few, same, "left_anti")
    lists = _token_lists(reports, settings, key).select(key, "f.field", "f.terms")
    schema = StructType([lists.schema[key], lists.schema["field"], StructField("term", StringType()), StructField("tf", LongType())])
    rows = lists.mapInArrow(_counted_lists, schema).filter(~is_stop_word(F.col("term"), settings))
    return rows.unionByName(repeated) if n else rows


def _counted_lists(batches):
    """Batches of (key, field, terms) as (key, field, term, tf), a few lists at a time."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for start in range(0, len(batch), LISTS):
            key, field, lists = batch.slice(start, LISTS).columns
            words = lists.flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            row = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            found, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            at = pa.array(found // n)
            columns = [key.take(at), field.take(at), words.dictionary.take(pa.array(found % n)), pa.array(tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:2], "term", "tf"])


def as_maps(rows: DataFrame, value: str, key: str = "bug_id") -> DataFrame:
    """One row per key with a map of terms for each field."""
    made = [F.map_from_entries(F.filter(F.collect_list(F.when(F.col("field") == f, F.struct("term", value))), lambda x: x.isNotNull())).alias(f) for f in FIELDS]
    return rows.groupBy(key).agg(*made)


def document_counts(counts: DataFrame) -> DataFrame:
    """term, summ, desc: in how many reports' fields a term occurs."""
    return counts.groupBy("term").agg(*[F.count_if(F.col("field") == f).alias(f) for f in FIELDS])


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (1 + df))


def unit_idf(n: Column, df: Column) -> Column:
    return idf(n, df) / F.log(n + 1)


def field_counts(counts: DataFrame) -> DataFrame:
    """field, term, df."""
    return counts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def looked_up(counts: DataFrame, dfs: DataFrame) -> DataFrame:
    """counts with df, for terms that dfs holds, a table of few bytes beside counts.

    The most frequent terms, which most rows hold, are broadcast; the rows of the others meet dfs by a shuffle, where no
    term is in more reports than the least frequent one that was broadcast.
    """
    level = F.floor(F.log2(F.col("df"))).cast("int").alias("level")
    sizes, n, least = dict(map(tuple, dfs.groupBy(level).agg(F.count(F.lit(1))).collect())), 0, 0
    for k in sorted(sizes, reverse=True):
        n += sizes[k]
        if n > HOT:
            least = 2 ** (k + 1)
            break
    keys = ["field", "term"]
    hot = F.broadcast(dfs.filter(F.col("df") >= least).select(*keys, "df"))
    rows = counts.join(hot, keys)
    return rows.unionByName(counts.join(hot, keys, "left_anti").join(dfs.filter(F.col("df") < least).select(*keys, "df"), keys)) if least else rows


def lengths(counts: DataFrame, dfs: DataFrame, n: int, key: str = "bug_id") -> DataFrame:
    """key, summ, desc: the lengths of the tf-idf vectors of each field, one row a report; null for a field without terms."""
    w = F.col("tf") * idf(F.lit(n), F.col("df"))
    part = lambda f: F.sqrt(F.sum(F.when(F.col("field") == f, w * w))).alias(f)
    return looked_up(counts, dfs).groupBy(key).agg(*map(part, FIELDS))


def scaled(counts: DataFrame, lengths_: DataFrame, dfs: DataFrame, n: int, n_terms: int, key: str = "bug_id") -> DataFrame:
    """key, field, term, w as the tf-idf weights of `weights`, for a part of the counts: lengths_ are those of whole reports,
    dfs holds the part's terms, n_terms of them. The rows are dealt by key."""
    rows = met(counts, dfs, ["field", "term"], n_terms).join(lengths_, key)
    w, length = F.col("tf") * idf(F.lit(n), F.col("df")), F.when(F.col("field") == "summ", F.col("summ")).otherwise(F.col("desc"))
    return rows.select(key, "field", "term", F.when(length > 1e-4, w / length).otherwise(w).alias("w"))


def weights(counts: DataFrame, dfs: DataFrame, n: int, algorithm: str = "bidf", key: str = "bug_id") -> DataFrame:
    """key, field, term, w. tfidf: tf * idf, scaled to length one if the length exceeds 0.0001; bidf: idf alone.

    n: the number of reports. Terms that no report has count as in none.
    """
    value = idf(F.lit(n), F.coalesce("df", F.lit(0)))
    rows = counts.join(dfs, ["field", "term"], "left")
    if algorithm == "bidf":
        return rows.select(key, "field", "term", value.alias("w"))
    if algorithm != "tfidf":
        raise ValueError(f"no such weighting: {algorithm}")
    rows = rows.select(key, "field", "term", (F.col("tf") * value).alias("w"))
    length = rows.groupBy(key, "field").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return rows.join(length, [key, "field"]).select(key, "field", "term", F.when(F.col("length") > 1e-4, F.col("w") / F.col("length")).otherwise(F.col("w")).alias("w"))


def squared_lengths(vectors: DataFrame, key: str = "bug_id") -> DataFrame:
    return vectors.groupBy(key, "field").agg(F.sum(F.col("w") * F.col("w")).alias("len2"))


def compared(a: DataFrame, b: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Two bags of terms side by side, missing values 0: key, term, a, b."""
    left, right = a.withColumnRenamed(value, "a"), b.withColumnRenamed(value, "b")
    return left.join(right, [*key, "term"], "full_outer").select(*key, "term", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
