"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrame functions only.

A text's shingles are its runs of five words (all its words, if they are fewer). A shingle's hash is the first twelve hex
digits of its md5; a sketch is the K smallest distinct hashes in order, a sample of the set that is the same wherever a
shingle occurs. So the sketch of a union is the K smallest of the sketches' union (`merge`, `merged`), and two sketches
give the resemblance of their sets, how much of one is contained in the other, and how many distinct shingles each holds.
A sketch of fewer than K hashes holds its whole set, and what follows from such sketches is exact. A fingerprint is a
sketch written in a row, twelve digits a hash.

`next_document` sets beside each row the text of the row that follows it in descending order of doc_id. Rows are dealt into
cells of neighbouring ids, a few megabytes each, from quantiles of the ids; the first row of each cell is copied to the
cell before it, so the rest is a window within a cell. Ids that hold more than a cell are split by a hash of the text.

Defined results: a null text counts as empty; a text without words has the empty fingerprint, whose likeness is 1 to
itself and 0 to all others; rows with equal ids follow each other in order of a hash of their texts, equal rows are
interchangeable; null ids come last; a single row follows itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .common import SPACES

#: Hashes of a sketch, hex digits of a hash, words of a shingle.
K, DIGITS, SHINGLE = 128, 12, 5
#: Bytes of text that a cell holds about: a few, as long as the quantiles are no more than QUANTILES, then LARGE.
SMALL, LARGE, QUANTILES = 4 << 20, 32 << 20, 512
#: Cells whose first rows are broadcast, at most; more are joined by a shuffle.
CELLS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def sketch(w: str) -> Column:
    """The sketch of an array of words; w names a column."""
    n = F.size(w)
    runs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(n - (SHINGLE - 1), F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)])
    hashed = lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)
    many = F.transform(runs, lambda x: hashed(F.concat_ws(" ", *[x[f"w{i}"] for i in range(SHINGLE)])))
    found = F.when(n == 0, F.array().cast("array<string>")).when(n < SHINGLE, F.array(hashed(F.concat_ws(" ", w)))).otherwise(many)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, K)


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, K)


def merged(sketches: DataFrame, keys: list[str], column: str = "sketch") -> DataFrame:
    """One sketch for each value of the keys, of all its rows' sketches (of parts of a text, say)."""
    hashes = sketches.select(*keys, F.explode(column).alias("__h")).distinct()
    order = Window.partitionBy(*keys).orderBy("__h")
    least = hashes.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= K)
    full = least.groupBy(*keys).agg(F.array_sort(F.collect_list("__h")).alias(column))
    empty = sketches.groupBy(*keys).agg(F.max(F.size(column)).alias("__m")).filter("__m = 0").select(*keys, F.array().cast("array<string>").alias(column))
    return full.unionByName(empty)


def fingerprint(s: Column) -> Column:
    return F.array_join(s, "")


def from_fingerprint(f: Column) -> Column:
    """The sketch that a fingerprint writes."""
    starts = F.when(F.length(f) > 0, F.sequence(F.lit(0), (F.length(f) / DIGITS).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(f, i * DIGITS + 1, F.lit(DIGITS)))


def distinct(s: Column) -> Column:
    """How many distinct shingles a sketch stands for: exact below K, else by the K-th smallest hash."""
    last = F.conv(F.element_at(s, -1), 16, 10).cast("double")
    return F.when(F.size(s) < K, F.size(s).cast("double")).otherwise(F.lit(float((K - 1) << (4 * DIGITS))) / (last + 1))


def resemblance(a: Column, b: Column, union: Column) -> Column:
    """The part of the union's sketch (`merge` of the two) that both hold; 1 if both are empty."""
    last = F.element_at(union, -1)
    both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= last))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def containment(a: Column, union: Column, alike: Column) -> Column:
    """How much of a's set the other holds, from the union's sketch and the resemblance; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), alike * distinct(union) / distinct(a)))


def _cells(rows: DataFrame, small: int, large: int) -> Column:
    """The cell of each row (doc_id, h, text): larger ids, and hashes of one id, are in larger cells."""
    at = F.percentile_approx("doc_id", F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)]), F.lit(10_000))
    size, nulls, n, found = rows.agg(F.sum(F.octet_length("text")), F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1)), at).first()
    many = min(QUANTILES, max(1, math.ceil((size or 0) / small)))
    split = max(1, min(1 << 19, math.ceil((size or 0) / large / many)))
    bounds = [found[i * QUANTILES // many] for i in range(many + 1)] if found else []
    seen = {b: bounds.count(b) for b in bounds}
    unique, times = sorted(seen), [seen[b] for b in sorted(seen)]
    part = F.col("h").cast("double") / float(1 << 64) + 0.5
    spread = lambda x, k: F.least(F.floor(x * k), k - 1)
    lost = spread(part, F.lit(split * math.ceil(many * (nulls or 0) / max(n or 1, 1)) or 1)) - (1 << 20)
    if not unique:
        return lost.cast("long")
    lower, held = F.array(*map(F.lit, unique)), F.array(*map(F.lit, times))
    i = F.size(F.filter(lower, lambda b: b <= F.col("doc_id"))) - 1
    least, above = F.get(lower, i), F.coalesce(F.get(lower, i + 1), F.lit(unique[-1] + 1))
    # An id that several bounds name holds several cells' rows.
    own = spread(part, F.when(F.get(held, i) > 1, F.get(held, i) * split).otherwise(1))
    between = spread((F.col("doc_id").cast("double") - least) / (above.cast("double") - least), F.lit(split))
    place = F.when(F.col("doc_id") == least, i.cast("long") * 2 * (1 << 20) + own).otherwise((i.cast("long") * 2 + 1) * (1 << 20) + between)
    return F.when(F.col("doc_id").isNull(), lost).otherwise(place).cast("long")


def next_document(docs: DataFrame, columns: dict[str, Column], small: int = SMALL, large: int = LARGE) -> DataFrame:
    """doc_id, text (null: empty), the columns made of them, and next_text, next_<column>: those of the row that follows in
    descending order of doc_id, and of the first after the last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("cell", _cells(rows, small, large))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")
    heads = rows.select("cell", "doc_id", "h").groupBy("cell").agg(F.max(order).alias("m")).select("cell", "m.doc_id", "m.h")
    # One short row a cell.
    above = F.coalesce(F.lead("cell").over(Window.orderBy("cell")), F.min("cell").over(Window.partitionBy()))
    heads = checkpointed(heads.select(F.col("cell").alias("__cell"), F.col("doc_id").alias("__id"), F.col("h").alias("__h"), above.alias("__to")))
    heads = F.broadcast(heads) if heads.count() <= CELLS else heads.hint("shuffle_hash")
    first = (F.col("cell") == F.col("__cell")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    placed = rows.join(heads, first, "left")
    here = F.struct(F.col("cell"), F.lit(False).alias("copy"))
    places = F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("__to").alias("cell"), F.lit(True).alias("copy"))))
    dealt = placed.select("doc_id", "text", "h", F.inline(places)).repartition("cell")
    for name, made in columns.items():
        dealt = dealt.withColumn(name, made)
    window = Window.partitionBy("cell").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("h"))
    taken = ["text", *[c for c in columns if not c.startswith("__")]]
    dealt = dealt.select("cell", "copy", "doc_id", "h", *taken)
    for c in taken:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(window))
    return dealt.filter("NOT copy").drop("cell", "copy", "h")


def edited(text: Column, after: Column) -> Column:
    """The text whose last floor(n / 2) code points are replaced by the first as many (or all) of the other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(after, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_shingles for every row of docs."""
    rows = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", sketch("w").alias("s"))
    return rows.select("doc_id", fingerprint(F.col("s")).alias("fingerprint"), F.round(distinct(F.col("s"))).cast("long").alias("n_shingles"))


def edited_fingerprints(docs: DataFrame, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """One row a row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles, n_edited_shingles, kept (how much of the text's shingles the edited one holds)."""
    rows = next_document(docs, {"__w": words(F.col("text")), "s": sketch("__w")}, small, large)
    rows = rows.withColumn("__edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "s", "next_s", words(F.col("__edited")).alias("__v"))
    rows = rows.withColumn("e", sketch("__v")).drop("__v")
    rows = rows.withColumn("u", merge(F.col("s"), F.col("e"))).withColumn("v", merge(F.col("s"), F.col("next_s")))
    rows = rows.withColumn("near_edited", resemblance(F.col("s"), F.col("e"), F.col("u")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), "near_edited",
        resemblance(F.col("s"), F.col("next_s"), F.col("v")).alias("near_next"), F.round(distinct(F.col("s"))).cast("long").alias("n_shingles"),
        F.round(distinct(F.col("e"))).cast("long").alias("n_edited_shingles"), containment(F.col("s"), F.col("u"), F.col("near_edited")).alias("kept"),
    )


HASHES = (
    "CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN [left(md5(array_to_string({w}, ' ')), 12)]"
    " ELSE list_sort(list_distinct(list_transform(range(1, len({w}) - 3), lambda i: left(md5(array_to_string({w}[i:i + 4], ' ')), 12))))[1:128] END"
)
DISTINCT = "CASE WHEN len({s}) < 128 THEN len({s})::DOUBLE ELSE (127::DOUBLE * 281474976710656) / (('0x' || {s}[-1])::BIGINT::DOUBLE + 1) END"
NEAR = "CASE WHEN len({u}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(list_intersect({a}, {b}), lambda x: x <= {u}[-1]))::DOUBLE / len({u}) END"
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), o AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS after_id FROM t
), e AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM o
), w AS (
  SELECT doc_id, after_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') AS v FROM e
), s AS (
  SELECT doc_id, after_id, n_chars, edited_sha256, {HASHES.format(w='w')} AS s, {HASHES.format(w='v')} AS e FROM w
), u AS (
  SELECT s.*, n.s AS n, list_sort(list_distinct(list_concat(s.s, s.e)))[1:128] AS u, list_sort(list_distinct(list_concat(s.s, n.s)))[1:128] AS v FROM s JOIN s n ON n.doc_id = s.after_id
), x AS (
  SELECT *, {NEAR.format(a='s', b='e', u='u')} AS near_edited FROM u
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint, near_edited, {NEAR.format(a='s', b='n', u='v')} AS near_next,
  round({DISTINCT.format(s='s')})::BIGINT AS n_shingles, round({DISTINCT.format(s='e')})::BIGINT AS n_edited_shingles,
  CASE WHEN len(s) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, near_edited * ({DISTINCT.format(s='u')}) / ({DISTINCT.format(s='s')})) END AS kept
FROM x
"""
