"""Source divergence audit: how the terms of each source of a language differ from those of its other sources and of the whole.

Terms are counted where the texts lie, and only counts move. A group is a source of a language. What two groups differ by
at a term depends on the two counts alone, so the sum over all terms follows from their joint table: for how many terms
the one group has the count a and the other the count b. One-hot columns, one for each count level of each group, give
all these tables at once as the product of their matrix's transpose with itself. The product is taken in blocks of terms
with like totals, so that a block has few levels, and of groups, in 32-bit floats that hold such counts exactly; each
block's tables are priced in integers and only sums leave it. Terms that neither of two blocks of groups holds are the
remaining cell of the tables, (0, 0), and are added at the end.

`term` rows name the terms that a group has more of than its language, by the same price.

Defined results: a null text, lang or source counts as ''; groups and languages without terms are there, with the value 0
for each pair if their language has no kept term; repeated rows are documents of their own; ties go to the first item in
byte order; other columns are ignored; an empty table gives no rows. doc_id is not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed, removed, spread_join, written
from .common import pa_schema
from .grouped import grouped

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Documents of a language that a kept term is in, at least.
DOCUMENTS = 3
#: Terms named for each group.
TERMS = 200
#: Entries that a task counts before it sends them on.
HELD = 300_000
#: Terms of a block, about; groups of a block, about; cells of a product, at most (a single term's levels aside).
ROWS, GROUPS, CELLS = 4096, 64, 1 << 20
#: Groups whose numbers are broadcast, at most; more are joined by shuffles that split hot ones.
SENT = 100_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), more than one row a term; a row with the term '' for each group."""
    schema = "lang string, source string, term string, n long, d long"
    fields = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        d: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                terms, held = ["", *found], d[lang, source]
                data = [[lang] * len(terms), [source] * len(terms), terms, [0, *found.values()], [0, *map(held.__getitem__, found)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, fields, strict=True)], schema=fields)
            n.clear()
            d.clear()

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = TERM.findall((text or "").translate(LOWER))
                n[lang, source].update(words)
                d[lang, source].update(set(words))
                if len(words) > HELD:
                    yield from out()
            if sum(map(len, n.values())) > HELD:
                yield from out()
        yield from out()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), "text").mapInArrow(run, schema)


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term, total, counts (array of source, n) of the terms in enough documents; the row '' of a language lists its groups."""
    rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = rows.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return terms.filter((F.col("d") >= DOCUMENTS) | (F.col("term") == "")).drop("d")


def group_totals(terms: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms), terms (kept ones of the language), whole (their occurrences there)."""
    sizes = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    return sizes.join(terms.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("terms"), F.sum("total").alias("whole")), "lang")


def share(n: Column, size: Column, terms: Column) -> Column:
    """A term's smoothed share of a group in units of 10 ** -9, rounded down, and one more."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (wide(n) + 1), wide(size) + wide(terms))).cast("long")


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return rows if most is None else rows.filter(F.col("rank") <= most)


def over_used(terms: DataFrame, totals: DataFrame, n_groups: int) -> DataFrame:
    """The `term` rows."""
    rows = terms.filter("term != ''").select("lang", "term", "total", F.inline("counts")).filter("n > 0")
    met = rows.join(F.broadcast(totals), ["lang", "source"]) if n_groups <= SENT else spread_join(checkpointed(rows), totals, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("whole"), F.col("terms"))
    met = met.withColumn("p", p).withColumn("q", q).filter("p > q")
    return ranked(met.select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value")), "term", TERMS)


def _levels(counts: np.ndarray, sizes: list[int], v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot columns of each group's count levels, where each group's columns start, and each column's share."""
    at, starts, shares = [], [], []
    for g, size in enumerate(sizes):
        levels, place = np.unique(counts[:, g], return_inverse=True)
        at.append(place + len(shares))
        starts.append(len(shares))
        shares += [1 + 10**9 * (int(a) + 1) // (size + v) for a in levels]
    x = np.zeros((len(counts), len(shares)), np.float32)
    x[np.arange(len(counts))[:, None], np.stack(at, axis=1)] = 1
    return x, np.array(starts), np.array(shares, np.int64)


def _width(counts: np.ndarray) -> int:
    s = np.sort(counts, axis=0)
    return counts.shape[1] + int((s[1:] != s[:-1]).sum())


def joint_prices(left: np.ndarray, right: np.ndarray, left_sizes: list[int], right_sizes: list[int], v: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over terms (rows) of the price of each left group towards each right one, and the other way round."""
    there = np.zeros((len(left_sizes), len(right_sizes)), np.int64)
    back = there.copy()
    order = np.argsort(left.sum(axis=1) + right.sum(axis=1), kind="stable")
    left, right = left[order], right[order]
    at, rows = 0, len(left)
    while at < len(left):
        rows = min(rows, len(left) - at)
        while rows > 1 and _width(left[at : at + rows]) * _width(right[at : at + rows]) > CELLS:
            rows //= 2
        x, xs, p = _levels(left[at : at + rows], left_sizes, v)
        y, ys, q = _levels(right[at : at + rows], right_sizes, v)
        tables = (x.T @ y).astype(np.int64)
        gap = (p[:, None] - q[None, :]) ** 2
        fold = lambda z, xs=xs, ys=ys: np.add.reduceat(np.add.reduceat(z, xs, axis=0), ys, axis=1)
        there += fold(tables * (gap // q[None, :]))
        back += fold(tables * (gap // p[:, None]))
        at, rows = at + rows, rows * 2
    return there, back


def _block(block: pa.Table) -> Iterator[dict]:
    """The sums of one block of terms and two of groups; its first row names the groups."""
    head = block.slice(0, 1).to_pylist()[0]
    v = head["terms"]
    sides = [[(s, n) for s, n, b in zip(head["sources"], head["n"], head["blocks"], strict=True) if b == k] for k in (head["i"], head["j"])]
    names = [s for side in sides[: 1 + (head["i"] != head["j"])] for s, _ in side]
    rows = block.slice(1)
    if not all(sides) or not len(rows):
        return
    counts = np.zeros((len(rows), len(names)), np.int64)
    lists = rows.column("sources").combine_chunks()
    place = pc.index_in(lists.flatten(), value_set=pa.array(names)).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    counts[row, place] = rows.column("n").combine_chunks().flatten().to_numpy()
    k = len(sides[0])
    left, right = counts[:, :k], counts if head["i"] == head["j"] else counts[:, k:]
    there, back = joint_prices(left, right, [n for _, n in sides[0]], [n for _, n in sides[1]], v)
    pairs = [(a, b, there[x, y]) for x, (a, _) in enumerate(sides[0]) for y, (b, _) in enumerate(sides[1]) if a != b]
    if head["i"] != head["j"]:
        pairs += [(b, a, back[x, y]) for x, (a, _) in enumerate(sides[0]) for y, (b, _) in enumerate(sides[1])]
    source, item, value = zip(*pairs, strict=True) if pairs else ((), (), ())
    yield {"lang": [head["lang"]] * len(pairs), "source": source, "item": item, "value": value, "seen": [len(rows)] * len(pairs)}


def _blocks(table: pa.Table) -> Iterator[dict]:
    """A block at a time: its row of groups has kind 0 and is its first. Blocks of groups that have none have no such row."""
    kind, key = table.column("kind").to_numpy(), table.column("key").to_numpy()
    starts = np.flatnonzero((kind == 0) | (np.diff(key, prepend=key[:1] - 1) != 0)).tolist()
    for a, b in zip(starts, [*starts[1:], len(table)], strict=True):
        if kind[a] == 0:
            yield from _block(table.slice(a, b - a))


def distances(terms: DataFrame, totals: DataFrame, n_groups: int) -> DataFrame:
    """The `pair` rows."""
    most = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 1
    many = -(-most // GROUPS)
    block = lambda s: F.pmod(F.xxhash64(s), F.lit(many)).cast("int")
    # Terms of like totals: four classes for each power of two, cut by a hash where a class has many.
    rows = terms.filter("term != ''").withColumn("class", F.floor(4 * F.log2("total")).cast("int"))
    sizes = rows.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("m"))
    cut = {r[0]: -(-r[1] // ROWS) for r in sizes.groupBy("class").agg(F.max("m")).collect()}  # four for each power of two
    cuts = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]) if cut else F.create_map(F.lit(0), F.lit(1))
    part = lambda h: (F.col("class") * F.lit(1 << 32) + F.pmod(h, F.element_at(cuts, F.col("class")))).cast("long")
    # Every two blocks of groups of which the term is in one.
    here = F.array_distinct(F.transform("counts", lambda c: block(c["source"])))
    two = F.array_distinct(F.flatten(F.transform(here, lambda b: F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda j: F.struct(F.least(b, j).alias("i"), F.greatest(b, j).alias("j"))))))
    rows = rows.select("lang", part(F.xxhash64("term")).alias("part"), "counts", F.inline(two))
    held = F.filter("counts", lambda c: (c["n"] > 0) & block(c["source"]).isin(F.col("i"), F.col("j")))
    rows = rows.select("lang", "i", "j", "part", F.lit(1).alias("kind"), held.alias("c")).select("lang", "i", "j", "part", "kind", F.col("c.source").alias("sources"), F.col("c.n").alias("n"), F.lit(None).cast("array<int>").alias("blocks"), F.lit(None).cast("long").alias("terms"))
    # The groups of two blocks, for every part of the terms.
    parts = sizes.select("lang", F.explode(F.sequence(F.lit(0), F.element_at(cuts, F.col("class")) - 1)).alias("k"), "class").select("lang", (F.col("class") * F.lit(1 << 32) + F.col("k")).cast("long").alias("part"))
    lists = totals.withColumn("b", block(F.col("source"))).groupBy("lang", "terms", "b").agg(F.collect_list(F.struct("source", F.col("size").alias("n"), "b")).alias("c"))
    other = lists.select("lang", F.col("b").alias("j"), F.col("c").alias("d"))
    heads = lists.withColumnRenamed("b", "i").join(other, "lang").filter("i <= j").withColumn("c", F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(F.concat("c", "d")))
    heads = heads.join(parts, "lang").select("lang", "i", "j", "part", F.lit(0).alias("kind"), F.col("c.source").alias("sources"), F.col("c.n").alias("n"), F.col("c.b").alias("blocks"), "terms")
    keyed = rows.unionByName(heads).withColumn("key", F.xxhash64("lang", "i", "j", "part"))
    sums = grouped(keyed, "key", _blocks, "lang string, source string, item string, value long, seen long", ["lang", "i", "j", "part", "kind"])
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # The result has every two groups of a language.
    other = totals.select("lang", F.col("source").alias("item"), F.col("size").alias("other"))
    pairs = totals.join(other, "lang").filter("source != item").join(sums, ["lang", "source", "item"], "left")
    zero = F.lit(0)
    left = F.col("terms") - F.coalesce("seen", zero)
    rest = F.when(left > 0, left * price(share(zero, F.col("size"), F.col("terms")), share(zero, F.col("other"), F.col("terms")))).otherwise(zero)
    return ranked(pairs.select("lang", "source", "item", (F.coalesce("value", zero) + rest).cast("long").alias("value")), "pair")


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    terms, path = written(kept_terms(docs), "divergence")
    totals = checkpointed(group_totals(terms))
    n_groups = totals.count()
    result = checkpointed(distances(terms, totals, n_groups).unionByName(over_used(terms, totals, n_groups)))
    removed(spark, path)
    return result


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT lang, source, id, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source FROM d GROUP BY lang, source
), sizes AS (
  SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS whole FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.size + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.total + 1) // (l.whole + l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
)
SELECT * FROM numbered WHERE part = 'pair' OR rank <= 200
"""
