"""N-gram Jaccard join by chosen paths: every pair of documents whose sets of five-word shingles are 0.8 alike or more.

Documents with equal sets are one set with a number of copies. Each of RUNS independent runs sends every set down a path:
at each level it joins the bucket of the shared token that its set samples (the least under a random order, so two sets
sample the same one with a chance equal to their Jaccard similarity). Buckets of one set end; buckets of up to SMALL sets
are compared by brute force; larger ones are split again on the next sampled token, down to LEVELS. What is still larger
then shares LEVELS sampled tokens and is one candidate group as it is. Runs are repeated until a pair at the threshold whose
buckets take all levels is missed with a chance below 1 - RECALL.

Within a bucket, sets are compared by their samples; those that may be alike form candidate groups. The whole sets of each
candidate group meet in blocks, where every pair's similarity is computed exactly, so precision is 1. Links are counted,
and only one link a set and block leaves the task; classes are the connected components of the exact links.

Result: one row per row of docs: doc_id, class_id (the least doc_id of the class), n_links (other rows that are alike,
copies included). Words are runs of anything but ASCII white space, as they stand.

Defined results: texts of one to four words are one shingle; texts that are null or without words are alike to nothing
(class_id = doc_id, n_links 0); rows with a null doc_id take no part and get class_id null, n_links 0; repeated rows count
as copies; other columns are ignored; an empty table gives an empty result. Sets are told apart by 128 bits of hash and
their size, and numbered, so no two share a number. Keys that hold a large part of the rows (a shared token, a class of
copies) are split over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import removed, spread_join, written
from ..operators.components import components
from .common import WORD, checkpointed, map_batches, texts
from .grouped import grouped
from .tokens import let_go

WORDS, SIMILARITY = 5, 0.8
RECALL = 0.9998
LEVELS = 5
#: Repetitions: a pair at the threshold stays together for all levels with chance SIMILARITY ** LEVELS.
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY**LEVELS))
#: Large buckets that are broadcast, at most; there is one in SMALL * RUNS sets or fewer at a level.
LARGE = 100_000
#: Sets of a bucket that is compared by brute force.
SMALL = 1024
#: Sets in a block of exact comparison, and shingles, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles times orders that are sampled at a time.
SAMPLED = 1 << 17
#: Samples that agree for a candidate: over four standard deviations below the threshold.
AGREE = 0.58

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _mixed(np.arange(1, 17, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(batch: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each whole text its distinct shingles as ascending 64-bit hashes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b" ".join([*raw, b""]) + b" ", np.uint8)
    inside = ~_SEPARATOR[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(batch)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]]))) if starts[0] == 0 else None
    if at is None:
        at = np.zeros(len(data), np.int64)
        at[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))
    table = _mixed(np.arange(1, int(at.max()) + 2, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
    value = np.where(inside, (data.astype(np.uint64) + _U(1)) * table[at], _U(0))
    word = _mixed(np.add.reduceat(value, starts))
    gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        gram += word[k : k + len(gram)] * _STEP[k]
    gram = _mixed(gram)
    ends = np.cumsum([len(r) + 1 for r in raw])
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            out.append(_mixed((word[a:b] * _STEP[8 : 8 + b - a]).sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two signed numbers."""
    a, b = _mixed(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64), _mixed(s + _U(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _orders(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda: r.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * _U(2) + _U(1)
    return draw(), draw()


def _sample(s: np.ndarray, xor: np.ndarray, times: np.ndarray) -> np.ndarray:
    """32 bits of the least shingle under each order, some orders at a time, so that a long text takes no more memory."""
    step = max(1, SAMPLED // len(s))
    least = [((s[None] ^ xor[i : i + step]) * times[i : i + step]).min(axis=1) for i in range(0, len(xor), step)]
    return (np.concatenate(least) >> _U(32)).astype(np.uint32).view(np.int32)


def sampled(docs: DataFrame, samples: int) -> DataFrame:
    """doc_id, sid, sid2 (the set's identity), n (its size), tokens (the sampled ones, 32 bits of each), sketch (8 bits of
    each, for comparing: chance only makes more candidates), text_hash."""

    def make():
        xor, times = _orders(samples)

        let_go()  # what an earlier packing step holds in this worker

        def each(batch: dict[str, list]) -> Iterator[dict[str, list]]:
            for i in range(0, len(batch["text"]), 512):
                sets = shingles(batch["text"][i : i + 512])
                ids = [identity(s) for s in sets]
                tokens = [_sample(s, xor, times) if len(s) else None for s in sets]
                yield {"doc_id": batch["doc_id"][i : i + 512], "sid": [a for a, _ in ids], "sid2": [b for _, b in ids], "n": [len(s) for s in sets], "tokens": tokens, "sketch": [None if t is None else t.astype("u1").tobytes() for t in tokens], "text_hash": batch["text_hash"][i : i + 512]}

        return each

    return map_batches(texts(docs, F.xxhash64("text").alias("text_hash")), make, "doc_id long, sid long, sid2 long, n int, tokens array<int>, sketch binary, text_hash long")


def buckets(sets: DataFrame, runs: int = RUNS, levels: int = LEVELS, small: int = SMALL) -> tuple[DataFrame, DataFrame, list[str]]:
    """set, sketch, run, key: the buckets of all runs that are compared; a, b: links of the sets of those that are still
    larger at the last level, each to the least one; and the paths of tables that both read.

    A level reads what the one before left in large buckets, with the rest of the run's sampled tokens, and no set again.
    """
    path = lambda r: F.slice("tokens", r * levels + 1, levels)
    rows = sets.select("set", F.inline(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), path(r).alias("path")))))
    done, paths, keys = None, [], ["run", "key"]
    links = sets.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0)
    for level in range(1, levels + 1):
        rows = rows.select("set", "run", F.xxhash64("run", F.slice("path", 1, level)).alias("key"), "path")
        counts = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.min("set").alias("least")).filter("m > 1"))
        large = counts.filter(F.col("m") > small).select(*keys, "least")
        crowded = large.count()
        if crowded:
            # Each row is marked by one join; the large buckets stay where they are, unless they are many.
            sizes = counts.filter(F.col("m") > small).select(*keys, F.col("m").alias("__m"))
            marked = rows.join(F.broadcast(large), keys, "left") if crowded <= LARGE else spread_join(rows, large, keys, "left", counts=sizes)
            rest = F.when(F.col("least").isNotNull(), F.col("path")).alias("path") if level < levels else F.lit(None).alias("path")
            rows, at = written(marked.select("set", *keys, "least", rest.cast("array<int>")), "buckets")
            paths.append(at)
        # What is left has no hot keys.
        ready = (rows.filter("least IS NULL") if crowded else rows).join(counts.filter(F.col("m") <= small).select(*keys), keys).select("set", *keys)
        done = ready if done is None else done.unionByName(ready)
        if not crowded:
            break
        rows = rows.filter("least IS NOT NULL")
    else:
        links = rows.filter("set != least").select(F.col("set").alias("a"), F.col("least").alias("b")).distinct()
    return done.join(sets.select("set", "sketch"), "set"), links, paths


def _groups(table: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of equal keys."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _slabs(n: int) -> Iterator[slice]:
    """Rows of a matrix of n columns, some at a time, so that temporaries stay small."""
    step = max(1, (1 << 19) // n)
    yield from (slice(i, i + step) for i in range(0, n, step))


def _forest(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for a square matrix of links."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | linked.T
    np.fill_diagonal(reach, True)
    while True:
        new = np.concatenate([np.where(reach[i], root[None], n).min(axis=1) for i in _slabs(n)])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _by_group(df: DataFrame, keys: list[str], each, schema: str) -> DataFrame:
    """mapInArrow over tables that hold whole groups of the keys."""
    return grouped(df.withColumn("__group", F.xxhash64(*keys)), "__group", each, schema, keys)


def candidates(bucketed: DataFrame, agree: float = AGREE) -> DataFrame:
    """a, b: in each bucket a link from every set to the least set of its candidate group there."""

    def each(table: pa.Table) -> Iterator[dict]:
        sids = table.column("set").to_numpy()
        tokens = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "u1").reshape(table.num_rows, -1)
        least = math.ceil(agree * tokens.shape[1])
        out_a, out_b = [], []
        for a, b in _groups(table, ["run", "key"]):
            t, s = tokens[a:b], sids[a:b]
            n = b - a
            if n == 2:
                if (t[0] == t[1]).sum() >= least:
                    out_a.append(s[:1])
                    out_b.append(s[1:])
                continue
            linked = np.zeros((n, n), bool)
            step = max(1, 2_000_000 // (n * t.shape[1]))
            for i in range(0, n, step):
                linked[i : i + step] = (t[i : i + step, None] == t[None]).sum(axis=2) >= least
            root = _forest(linked)
            own = np.flatnonzero(root != np.arange(n))
            out_a.append(s[own])
            out_b.append(s[root[own]])
        if out_a:
            yield {"a": np.concatenate(out_a), "b": np.concatenate(out_b)}

    return _by_group(bucketed, ["run", "key"], each, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    if n == 2:
        return np.array([[len(sets[0]), k := len(np.intersect1d(*sets, assume_unique=True))], [k, len(sets[1])]])
    token, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    number = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])]) if len(token) else np.zeros(0, int)
    shared = np.bincount(number) > 1
    keep = shared[number]
    column = (np.cumsum(shared) - 1)[number[keep]]
    owner = owner[keep]
    # Sums of ones are exact in single precision up to 2 ** 24.
    out = np.zeros((n, n), np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    width = max(256, (1 << 21) // n)
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        out += m @ m.T
    inter = out.astype(np.int32)
    np.fill_diagonal(inter, [len(s) for s in sets])
    return inter


def verified(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """set, other, links: per set and block its exact links (weighed by copies) and the least set of its group there."""
    bound = round(similarity * 1000)

    def each(table: pa.Table) -> Iterator[dict]:
        sids, copies, mine = (table.column(k).to_numpy() for k in ("set", "copies", "mine"))
        raw = table.column("shingles")
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in _groups(table, ["comp", "part_a", "part_b"]):
            _, first = np.unique(sids[a:b], return_index=True)
            own = a + first
            if len(own) < 2:
                continue
            sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in own]
            s, k, m = sids[own], copies[own], mine[own]
            inter = overlaps(sets)
            size = np.diag(inter).astype(np.int64)
            linked = np.empty(inter.shape, bool)
            for i in _slabs(len(sets)):
                both = inter[i].astype(np.int64)
                linked[i] = both * 1000 >= bound * (size[i, None] + size[None] - both)
            np.fill_diagonal(linked, False)
            if table.column("part_a")[a].as_py() != table.column("part_b")[a].as_py():
                linked &= m[:, None] != m[None]  # pairs within a part are counted where it meets itself
            root = _forest(linked)
            out[0].append(s)
            out[1].append(s[root])
            out[2].append(np.concatenate([(linked[i] * k[None]).sum(axis=1) for i in _slabs(len(sets))]))
        if out[0]:
            sid, other, links = (np.concatenate(x) for x in out)
            some = links > 0
            yield {"set": sid[some], "other": other[some], "links": links[some]}

    return _by_group(members, ["comp", "part_a", "part_b"], each, "set long, other long, links long")


def classes(docs: DataFrame, similarity: float = SIMILARITY, runs: int = RUNS, levels: int = LEVELS, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables. Rows: doc_id, text_hash, sid, sid2, n for every row of docs. Sets: set, sid, sid2, n, least (doc_id),
    copies, root (of its class). Links: set, other, links."""
    rows = checkpointed(sampled(docs, runs * levels))
    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    sets = named.groupBy("sid", "sid2", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    sets = checkpointed(sets.withColumn("set", F.monotonically_increasing_id()))
    compared, crowded, paths = buckets(sets, runs, levels, small)
    try:
        groups = components(candidates(compared).unionByName(crowded))
    finally:
        for path in paths:
            removed(docs.sparkSession, path)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("set"), F.col("root").alias("comp"))
    groups = checkpointed(groups.join(sets.select("set", "sid", "sid2", "n", "least", "copies"), "set"))
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("m") / F.lit(block)), F.least("m", F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)))).cast("int")
    placed = spread_join(groups, sizes, ["comp"], counts=sizes.withColumnRenamed("m", "__m"))
    placed = placed.select("set", "sid", "sid2", "comp", "copies", F.pmod(F.xxhash64("set"), parts).cast("int").alias("mine"), parts.alias("parts"))

    def whole(batch: dict[str, list]) -> Iterator[dict[str, list]]:
        for i in range(0, len(batch["text"]), 512):
            found = shingles(batch["text"][i : i + 512])
            ids = [identity(s) for s in found]
            yield {"sid": [a for a, _ in ids], "sid2": [b for _, b in ids], "shingles": [s.tobytes() for s in found]}

    wanted = texts(docs).join(groups.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    contents = map_batches(wanted, lambda: whole, "sid long, sid2 long, shingles binary")
    members = contents.join(placed, ["sid", "sid2"]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    members = members.select("set", "comp", "copies", "shingles", "mine", F.least("mine", "other").alias("part_a"), F.greatest("mine", "other").alias("part_b"))
    links = checkpointed(verified(members, similarity))
    roots = components(links.select(F.col("set").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "set")
    sets = checkpointed(sets.drop("tokens", "sketch").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    return rows.drop("tokens", "sketch"), sets, links


def ngram_join(docs: DataFrame, similarity: float = SIMILARITY, runs: int = RUNS, levels: int = LEVELS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    rows, sets, links = classes(docs, similarity, runs, levels, small, block)
    least = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    result = spread_join(sets, least, ["root"]).join(links.groupBy("set").agg(F.sum("links").alias("links")), "set", "left")
    result = result.select("sid", "sid2", "n", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    no_set = F.col("doc_id").isNull() | (F.col("n") == 0)
    with_set = spread_join(rows.filter(~no_set).drop("text_hash"), result, ["sid", "sid2", "n"], counts=sets.select("sid", "sid2", "n", F.col("copies").alias("__m")))
    alone = rows.filter(no_set).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_set.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links")).unionByName(alone)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all their columns, with one document of each class: one row of its least doc_id; if several texts
    of the class have that id, the one with the least hash.

    Rows with a null doc_id, a null text or no words belong to no class and stay.
    """
    rows, sets, _ = classes(docs, similarity)
    first = sets.groupBy("root").agg(F.min(F.struct("least", "sid", "sid2", "n")).alias("f")).select("root", F.col("f.least").alias("doc_id"), "f.sid", "f.sid2", "f.n")
    # Only rows of the class' least id are looked at, so a large class is no large group here.
    chosen = rows.join(first, ["doc_id", "sid", "sid2", "n"]).groupBy("root", "doc_id").agg(F.min("text_hash").alias("__text"), F.count(F.lit(1)).alias("__rows"))
    chosen = checkpointed(chosen.select("doc_id", "__text", "__rows").distinct())
    keyed = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(chosen.filter("__rows = 1"), ["doc_id", "__text"], "left_semi")
    loose = docs.filter(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(WORD))
    out = kept.select(docs.columns).unionByName(loose)
    several = chosen.filter("__rows > 1")
    if not several.isEmpty():
        out = out.unionByName(keyed.join(several, ["doc_id", "__text"], "left_semi").dropDuplicates(["doc_id", "__text"]).select(docs.columns))
    return out
