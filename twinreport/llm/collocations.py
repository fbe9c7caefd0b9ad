"""Phrase collocation mining: phrases of two and three words that occur often, scored by how much more than chance.

A word stands for itself and its language by 64 bits of hash; a vocabulary of all words shows that no two share them (else
another seed is taken), so all counts are exact. Texts are encoded once: a row of `encoded` holds some megabytes of text as
numbers of words, 0 where a piece ends or a word is too rare to be in any phrase.

Candidates are Apriori-safe: a pair of frequent words that is frequent, a triple both of whose pairs are. What is frequent
a level below is known to a task as a bitmap of bounded size, which may let more through, never less. Candidates are dealt
by hash into parts of at most about PART; each part is a double-array trie whose arrays are broadcast. In one pass over the
encoded texts numpy advances the states of all positions of a row at once, level by level, and counts the accepting states
that are reached by bincount; the tasks' counts are summed in shards. A word is two steps of the trie, its number's high
and low half, so that a state's children lie close together.

More candidates make more parts and so more passes over the encoded texts, one for each PART of them; no
candidate is left out.

Defined results: a null text counts as empty, a null lang as `und`; repeated rows count each; ties go to the first phrase
in byte order; doc_id and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import removed, spread_join, written
from .common import pa_schema
from .grouped import grouped

#: Occurrences of a candidate; part of a phrase's occurrences (in hundredths) that drops it for a longer one; rows a language.
LEAST, COVERED, ROWS = 10, 50, 2000
#: Candidates of a trie, about.
PART = 500_000
#: Bits of a bitmap of what is frequent, at most.
BITS = 1 << 27
#: Bytes of text in a row of encoded texts, about; words that a task counts or looks up before it starts afresh.
SLAB, WORDS = 2 << 20, 150_000
#: Phrases that a task counts before it sends them on; of all words, so many make a shard.
HELD, SHARD = 700_000, 1 << 20

BREAK = b"\n"
#: Lower case for A-Z, a space for a tab, BREAK for what ends a piece; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def split(text: bytes | None) -> list[bytes]:
    """The words of a text (UTF-8) in order, BREAK between pieces and empty ones wherever."""
    return (text or b"").translate(LETTERS).replace(BREAK, b" \n ").split(b" ")


def word_hash(lang: bytes, word: bytes, seed: int) -> int:
    """0 and 1 are left to breaks and to nothing."""
    return max(2, xxhash.xxh3_64_intdigest(lang + b"\0" + word, seed))


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, np.uint64).view(np.int64)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes | None]]:
    """lang, text of one row after the other, so that a batch's texts are not there twice."""
    for lang, text in zip(*batch.columns, strict=True):
        yield lang.as_py(), text.as_py()


# --- words ---------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n: every word."""
    schema = "lang string, word string, h long, n long"
    fields = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                counts.pop(b"", None)
                counts.pop(BREAK, None)
                h = _signed(np.fromiter((word_hash(lang, w, seed) for w in counts), np.uint64, len(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(h), pa.array(list(counts.values()), pa.int64())], schema=fields)
            found.clear()

        for batch in batches:
            for lang, text in rows(batch):
                found.setdefault(lang, Counter()).update(split(text))
                if sum(map(len, found.values())) > WORDS:
                    yield from out()
        yield from out()

    return _docs(docs).mapInArrow(run, schema).groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int, str]:
    """The table of all words under the first seed for which no two words share a hash; the seed, the table's path."""
    seed = 0
    while True:
        table, path = written(word_counts(docs, seed), "vocabulary")
        if table.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty():
            return table, seed, path
        removed(docs.sparkSession, path)
        seed += 1


# --- bitmaps -------------------------------------------------------------------------------------------------------


def mix(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits of hash of each row of columns."""
    m = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        m = (m ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(29)
        m *= np.uint64(0x94D049BB133111EB)
        m ^= m >> np.uint64(32)
    return m


def bitmap(often: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """Bits of the hashes of the rows, n of them: 64-bit words, BITS / 64 of them at most."""
    bits = 1 << max(6, min(BITS.bit_length() - 1, (32 * n).bit_length()))
    schema = "at long, bits long"
    fields = pa_schema(often.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = mix([c.to_numpy().view(np.uint64) for c in batch.columns]) & np.uint64(bits - 1)
            at, inverse = np.unique(place >> np.uint64(6), return_inverse=True)
            made = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(made, inverse, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(at)), pa.array(_signed(made))], schema=fields)

    out = np.zeros(bits // 64, np.uint64)
    parts = often.select(*columns).mapInArrow(run, schema).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[parts.column("at").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return out


def among(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    place = mix(columns) & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


# --- encoded texts -------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, seed: int, frequent) -> DataFrame:
    """words (64-bit hashes in order), codes (32-bit numbers: 0 or one more than a word's place): some texts a row."""
    schema = "words binary, codes binary"
    fields = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, dict[bytes, int]] = {}
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate(held), return_inverse=True)
            codes = codes.astype(np.int32)
            if words[0] == 0:
                words = words[1:]
            else:
                codes += 1
            codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]  # one 0 at a time
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], schema=fields)

        for batch in batches:
            for lang, text in rows(batch):
                known = cache.setdefault(lang, {b"": 1, BREAK: 0})
                words = split(text)
                new = list(set(words).difference(known))
                if sum(map(len, cache.values())) + len(new) > WORDS:
                    cache.clear()
                    known = cache.setdefault(lang, {b"": 1, BREAK: 0})
                    new = list(set(words).difference(known))
                if new:
                    h = np.fromiter((word_hash(lang, w, seed) for w in new), np.uint64, len(new))
                    known.update(zip(new, np.where(among(frequent.value, [h]), h, 0).tolist(), strict=True))
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                held += [h[h != 1], np.zeros(1, np.uint64)]
                size += len(text or b"")
                if size > SLAB:
                    yield out()
                    size = 0
        if held:
            yield out()

    return _docs(docs).mapInArrow(run, schema)


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words and codes of each row; two zeros follow the codes."""
    for batch in batches:
        for words, codes in zip(batch.column("words"), batch.column("codes"), strict=True):
            yield np.frombuffer(words.as_buffer(), np.uint64), np.append(np.frombuffer(codes.as_buffer(), np.int32), np.zeros(2, np.int32))


# --- frequent phrases ----------------------------------------------------------------------------------------------


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of columns in order of their hashes, the sums of n, the hashes."""
    m = mix(columns)
    order = np.argsort(m, kind="stable")
    differ = lambda o: np.append(True, np.any([c[o][1:] != c[o][:-1] for c in columns], axis=0))[: len(m)]
    new = differ(order)
    if (m[order][1:] == m[order][:-1])[new[1:]].any():  # two rows share a hash
        order = np.lexsort([*columns, m])
        new = differ(order)
    starts = np.flatnonzero(new)
    return [c[order][starts] for c in columns], np.add.reduceat(n[order], starts), m[order][starts]


def _planes(a: np.ndarray) -> bytes:
    """Bytes by their place in the number, which compress well where numbers are alike."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def _unplaned(b: pa.Scalar, kind: type) -> np.ndarray:
    raw = np.frombuffer(b.as_buffer(), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def frequent_phrases(encoded: DataFrame, k: int, below, shards: int, least: int = LEAST) -> DataFrame:
    """h1 ... hk, a of the phrases of k words (2, 3) that occur so often; below: for 3 a broadcast bitmap of the pairs that do."""
    names = [f"h{i + 1}" for i in range(k)]
    schema = "shard long, n binary, " + ", ".join(f"{x} binary" for x in names)
    fields = pa_schema(encoded.sparkSession, schema)
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def count(words: np.ndarray, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The phrases of a row and how often each is there."""
        at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        wide = len(words) + 1
        pair = codes[at].astype(np.int64) * wide + codes[at + 1]
        if k == 2:
            pairs, n = np.unique(pair, return_counts=True)
            return [words[pairs // wide - 1], words[pairs % wide - 1]], n
        often = np.zeros(len(codes), bool)
        often[at] = among(below.value, [words[codes[at] - 1], words[codes[at + 1] - 1]])
        at = np.flatnonzero(often[:-1] & often[1:])
        pair = codes[at].astype(np.int64) * wide + codes[at + 1]
        named = None
        if wide > 1 << 21:  # numbers of pairs, as three words don't fit 64 bits
            named, pair = np.unique(pair, return_inverse=True)
        triples, n = np.unique(pair * wide + codes[at + 2], return_counts=True)
        pairs = triples // wide if named is None else named[triples // wide]
        return [words[pairs // wide - 1], words[pairs % wide - 1], words[triples % wide - 1]], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def together() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            return summed([np.concatenate([h[0][i] for h in held]) for i in range(k)], np.concatenate([h[1] for h in held]))

        def out() -> Iterator[pa.RecordBatch]:
            columns, n, m = together()
            shard = (m >> shift).astype(np.int64)
            starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(m) else []
            for a, b in zip(starts, [*starts, len(m)][1:], strict=True):
                order = np.argsort(columns[0][a:b], kind="stable")
                data = {x: [_planes(c[a:b][order])] for x, c in zip(names, columns, strict=True)}
                yield pa.RecordBatch.from_pydict({"shard": [int(shard[a])], "n": [_planes(n[a:b][order].astype(np.uint64))], **data}, schema=fields)

        for words, codes in slabs(batches):
            held.append(count(words, codes))
            size += len(held[-1][1])
            if size > HELD:
                columns, n, _ = together()
                held[:] = [(columns, n)]
                size = len(n)
                if size > HELD // 2:
                    yield from out()
                    held.clear()
                    size = 0
        if held:
            yield from out()

    def add(table: pa.Table) -> Iterator[dict]:
        columns = [np.concatenate([_unplaned(b, np.uint64) for b in table.column(x)]) for x in names]
        columns, n, _ = summed(columns, np.concatenate([_unplaned(b, np.int64) for b in table.column("n")]))
        often = n >= least
        yield {x: _signed(c[often]) for x, c in zip(names, columns, strict=True)} | {"a": n[often]}

    sent = encoded.mapInArrow(run, schema)
    return grouped(sent, "shard", add, ", ".join(f"{x} long" for x in names) + ", a long")


# --- tries ---------------------------------------------------------------------------------------------------------


class Trie:
    """A double array over phrases of two or three words (h: one row of hashes a phrase, 0 for no third word).

    A state is a place in the arrays; the step by a digit d leads from s to base[s] + d, if check there is s. A word is
    two digits, the halves of its number in `words`.
    """

    def __init__(self, h: np.ndarray, seed: int = 1):
        self.h = h
        self.words = np.unique(h[h != 0])
        half = max(1, math.ceil(math.log2(max(2, len(self.words))) / 2))
        self.radix = 1 << half
        label = np.searchsorted(self.words, h)
        node, made = np.zeros(len(h), np.int64), 1
        parents, digits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level in range(h.shape[1]):
            on = h[:, level] != 0
            for digit in (label[on, level] >> half, label[on, level] & (self.radix - 1)):
                edges, inverse = np.unique(node[on] * self.radix + digit, return_inverse=True)
                parents.append(edges >> half)
                digits.append(edges & (self.radix - 1))
                node[on] = made + inverse
                made += len(edges)
        self._place(np.concatenate(parents), np.concatenate(digits), made, np.random.default_rng(seed))
        self.accepts = self.slot[node]
        del self.slot

    def _place(self, parent: np.ndarray, digit: np.ndarray, nodes: int, rng: np.random.Generator) -> None:
        """Gives each node's children a base under which none of their places is taken; nodes 1, 2 ... are the edges' ends.

        Nodes with many children get places of their own; of the rest those with more go first, each tried at random
        places until all are placed; only children fill what is free.
        """
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(parent)))
        base = np.zeros(nodes, np.int64)
        wide = 1 + self.radix * int((count > self.radix // 8).sum())
        taken = np.zeros(wide + 3 * len(parent) + 4 * self.radix, bool)
        taken[0] = True

        def settle(rows: np.ndarray, at: np.ndarray) -> None:
            base[parent[starts[rows]]] = at
            edges, _ = self._edges(starts, count, rows)
            taken[base[parent[edges]] + digit[edges]] = True

        def apart(rows: np.ndarray, start: int) -> None:
            settle(rows, start + self.radix * np.arange(len(rows)))

        big = np.flatnonzero(count > self.radix // 8)
        apart(big, 1)
        most = max(2, self.radix // 8)
        while most >= 2:
            rows = np.flatnonzero((count <= self.radix // 8) & (count <= most) & (count > most // 2) & (count > 1))
            for _ in range(200):
                if not len(rows):
                    break
                at = rng.integers(wide, len(taken) - self.radix, len(rows))
                edges, row = self._edges(starts, count, rows)
                place = at[row] + digit[edges]
                free = ~taken[place]
                first = np.zeros(len(place), bool)
                first[np.unique(place, return_index=True)[1]] = True
                good = np.bincount(row[free & first], minlength=len(rows)) == count[rows]
                if good.any():
                    settle(rows[good], at[good])
                rows = rows[~good]
            if len(rows):
                end = len(taken)
                taken = np.append(taken, np.zeros(self.radix * len(rows), bool))
                apart(rows, end)
            most //= 2
        single = np.flatnonzero((count == 1) & (count <= self.radix // 8)) if self.radix >= 8 else np.zeros(0, np.int64)
        free = np.flatnonzero(~taken)
        free = free[free >= self.radix][: len(single)]
        settle(single, free - digit[starts[single]])
        slot = np.zeros(nodes, np.int64)
        slot[1:] = base[parent] + digit
        self.base = np.zeros(len(taken) + self.radix, np.int32)
        self.check = np.full(len(self.base), -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.slot = slot

    @staticmethod
    def _edges(starts: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges of some rows, and which of the rows each is of."""
        row = np.repeat(np.arange(len(rows)), count[rows])
        ahead = np.cumsum(count[rows]) - count[rows]
        return starts[rows][row] + np.arange(len(row)) - ahead[row], row

    def states(self, words: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """The states that the positions of encoded texts (two zeros at the end) are in after two words and after three."""
        label = np.searchsorted(self.words, words)
        known = np.append(False, self.words[np.minimum(label, len(self.words) - 1)] == words) if len(self.words) else np.zeros(len(words) + 1, bool)
        label = np.append(0, label)
        digits = [(label >> (self.radix.bit_length() - 1)).astype(np.int32), (label & (self.radix - 1)).astype(np.int32)]
        at = np.flatnonzero(known[codes[:-2]])
        state = np.zeros(len(at), np.int32)
        out = []
        for level in range(3):
            word = codes[at + level]
            alive = known[word]
            at, state, word = at[alive], state[alive], word[alive]
            for d in digits:
                to = self.base[state] + d[word]
                alive = self.check[to] == state
                at, state, word = at[alive], to[alive], word[alive]
            if level:
                out.append(state)
        return out


def count_phrases(spark: SparkSession, encoded: DataFrame, trie) -> DataFrame:
    """h1, h2, h3 (0: none), a: occurrences of the phrases of a broadcast trie, in one pass."""
    step = 1 << 14
    schema = "shard long, n binary"
    fields = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        found = np.zeros(len(t.accepts), np.int64)
        held, size = [], 0
        for words, codes in slabs(batches):
            held += t.states(words, codes)
            size += sum(map(len, held[-2:]))
            if size > HELD:
                found += np.bincount(np.concatenate(held), minlength=len(t.base))[t.accepts]
                held, size = [], 0
        if held:
            found += np.bincount(np.concatenate(held), minlength=len(t.base))[t.accepts]
        for i in range(0, len(found), step):
            if found[i : i + step].any():
                yield pa.RecordBatch.from_pydict({"shard": [i // step], "n": [_planes(found[i : i + step])]}, schema=fields)

    def add(table: pa.Table) -> Iterator[dict]:
        shards = table.column("shard").to_numpy()
        for s in np.unique(shards).tolist():
            n = np.sum([_unplaned(table.column("n")[int(i)], np.int64) for i in np.flatnonzero(shards == s)], axis=0)
            rows = trie.value.h[s * step : (s + 1) * step]
            yield {f"h{i + 1}": _signed(rows[:, i]) for i in range(3)} | {"a": n}

    return grouped(encoded.mapInArrow(run, schema), "shard", add, "h1 long, h2 long, h3 long, a long")


# --- scores --------------------------------------------------------------------------------------------------------


def score(a: Column, left: Column, right: Column) -> Column:
    """1000000 * a * a / (left * right), rounded down, in exact numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, most: int = ROWS, part: int = PART) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer phrase covers."""
    spark = docs.sparkSession
    paths: list[str] = []

    def table(rows: DataFrame, name: str) -> DataFrame:
        found, path = written(rows, name)
        paths.append(path)
        return found

    try:
        words, seed, path = vocabulary(docs)
        paths.append(path)
        n_words, n_often = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") >= least)).first()
        often = words.filter(F.col("n") >= least)
        encoded = table(encode(docs, seed, spark.sparkContext.broadcast(bitmap(often, ["h"], n_often))), "encoded")
        shards = 1 << max(6, math.ceil(math.log2(n_words / SHARD + 1)))
        pairs = table(frequent_phrases(encoded, 2, None, shards, least), "pairs")
        n_pairs = pairs.count()
        triples = table(frequent_phrases(encoded, 3, spark.sparkContext.broadcast(bitmap(pairs, ["h1", "h2"], n_pairs)), shards, least), "triples")
        parts = -(-(n_pairs + triples.count()) // part)
        candidates = pairs.select("h1", "h2", F.lit(0).cast("long").alias("h3")).unionByName(triples.select("h1", "h2", "h3"))
        counted = candidates.withColumn("a", F.lit(0).cast("long")).filter("h1 IS NULL")
        for i in range(parts):
            mine = candidates if parts == 1 else candidates.filter(F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(parts)) == i)
            got = mine.toArrow()  # one trie's phrases, `part` about
            trie = spark.sparkContext.broadcast(Trie(np.stack([got.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2", "h3")], axis=1)))
            found = table(count_phrases(spark, encoded, trie), "counted")
            trie.destroy()
            counted = counted.unionByName(found) if i else found
        named = table(_named(counted.filter("h3 = 0").select("h1", "h2", "a"), often, n_pairs), "named")
        result, _ = written(_ranked(words, named, counted.filter("h3 != 0"), covered, most), "collocations")
        return result
    finally:
        for path in paths:
            removed(spark, path)


def _named(pairs: DataFrame, often: DataFrame, n: int) -> DataFrame:
    """h1, h2, a, lang, w1, n1, w2, n2: n pairs with their words; a word that begins or ends many is split."""
    of = lambda i, *more: often.select(F.col("h").alias(f"h{i}"), *more, F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"))
    of_second = pairs.groupBy("h2").agg(F.count(F.lit(1)).alias("__m"))
    return spread_join(spread_join(pairs, of(1, "lang"), ["h1"], rows=n), of(2), ["h2"], counts=of_second, rows=n)


def _ranked(words: DataFrame, named: DataFrame, triples: DataFrame, covered: int, most: int) -> DataFrame:
    longest = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    two = named.join(longest, ["h1", "h2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r")).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    first = named.select("h1", "h2", "lang", "w1", "n1", F.col("a").alias("a12"))
    last = named.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n2").alias("n3"), F.col("a").alias("a23"))
    of_last = triples.groupBy("h2", "h3").agg(F.count(F.lit(1)).alias("__m"))
    three = spread_join(spread_join(triples, first, ["h1", "h2"]), last, ["h2", "h3"], counts=of_last)
    three = three.withColumn("s1", score(F.col("a"), F.col("n1"), F.col("a23"))).withColumn("s2", score(F.col("a"), F.col("a12"), F.col("n3")))
    late = F.col("s2") < F.col("s1")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(late, F.col("a12")).otherwise(F.col("n1")).alias("l"),
        F.when(late, F.col("n3")).otherwise(F.col("a23")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return best.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), found AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM lists WHERE len(w) > 1
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM lists WHERE len(w) > 2
), grams AS (
  SELECT lang, k, phrase, count(*) AS n FROM found GROUP BY lang, k, phrase
), sizes AS (
  SELECT lang, sum(n)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND n >= 10
), halves AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
  UNION ALL
  SELECT lang, k, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE k = 3
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.n AS l, r.n AS r, (1000000::HUGEINT * c.a * c.a // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM halves c JOIN grams l ON l.lang = c.lang AND l.phrase = c.head JOIN grams r ON r.lang = c.lang AND r.phrase = c.tail
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS c FROM cuts
), longer AS (
  SELECT lang, inner_phrase AS phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT x.* FROM lowest x LEFT JOIN longer y ON x.k = 2 AND y.lang = x.lang AND y.phrase = x.phrase WHERE x.c = 1 AND (y.a IS NULL OR 100 * y.a < 50 * x.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, sizes.n AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
