"""Hierarchical multi-length packing: documents become pieces of sequences of several context sizes, without padding.

A document longer than the largest context gives full sequences; what remains, and every shorter document, is routed to
the smallest tier (a power of two) that holds it. Each tier packs its documents, one to a sequence as each fills over
half of it; the gap of a sequence is filled with the longest documents of shorter tiers that fit, and when none fits, by
cutting the next shorter one. What a task has left at its end goes into sequences of smaller powers of two, so every
sequence is exactly full. Sequences of each tier are dealt to step groups in serpentine order by attention cost (the sum
of squared piece lengths), so the groups stay balanced in tokens and in work.

Packing is local to a task: it needs no shuffle, a lost task is done again alone, and a task holds at most a bounded
number of waiting tokens. Partitions of the input decide the sequences, so a rerun over other partitions packs otherwise.

Defined results: a null text counts as empty, a document of its end id alone; a null doc_id is returned as null; repeated
rows are packed each; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pa_schema, texts
from .tokens import ChunkTokenizer, default_path

#: Context sizes; powers of two.
TIERS = (256, 512, 1024, 2048, 4096)
END = 2
STEP_GROUPS = 64
#: Tokens that wait in a task before its tiers are packed.
WAITING = 1 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size int, step_group int"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Packs documents that are added into full sequences; a piece is (length, number of the document, start)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.waiting: list[tuple[int, int, int]] = []  # ascending by length
        self.tokens = 0

    def add(self, doc: int, n: int) -> list[list[tuple[int, int, int]]]:
        """Full sequences of the largest size; the rest of the document waits."""
        top = self.tiers[-1]
        full = [[(top, doc, at)] for at in range(0, n - top + 1, top)]
        if rest := n % top:
            insort(self.waiting, (rest, doc, n - rest))
            self.tokens += rest
        return full

    def pack(self, all_of_it: bool) -> list[list[tuple[int, int, int]]]:
        """Sequences of what waits, longest documents first; all but the last ones unless all_of_it."""
        out = []
        top = self.tiers[-1]
        while self.waiting and (self.tokens >= top or all_of_it):
            n, doc, at = self.waiting.pop()
            size = next(t for t in self.tiers if t >= n)
            if size - n > self.tokens - n:  # too little is left for this tier: only at the end
                self.waiting.append((n, doc, at))
                break
            self.tokens -= size
            sequence, gap = [(n, doc, at)], size - n
            while gap:
                i = bisect_right(self.waiting, (gap, 1 << 62, 0))
                if i:
                    piece = self.waiting.pop(i - 1)
                else:  # all that wait are longer: cut the shortest
                    m, d, s = self.waiting.pop(0)
                    piece = (gap, d, s)
                    insort(self.waiting, (m - gap, d, s + gap))
                sequence.append(piece)
                gap -= piece[0]
            out.append(sequence)
        return out + (self._tail() if all_of_it else [])

    def _tail(self) -> list[list[tuple[int, int, int]]]:
        """What no tier can be filled with: one run of tokens, cut at powers of two."""
        out, pieces = [], self.waiting[::-1]
        while self.tokens:
            gap = 1 << (self.tokens.bit_length() - 1)
            self.tokens -= gap
            sequence = []
            while gap:
                n, doc, at = pieces.pop(0)
                m = min(n, gap)
                sequence.append((m, doc, at))
                gap -= m
                if m < n:
                    pieces.insert(0, (n - m, doc, at + m))
            out.append(sequence)
        self.waiting = []
        return out


def serpentine(costs: list[int], groups: int, turn: int) -> list[int]:
    """A group for each sequence: dealt forth and back from the costliest, starting at another group each turn."""
    out = [0] * len(costs)
    for rank, i in enumerate(sorted(range(len(costs)), key=lambda i: (-costs[i], i))):
        lap, at = divmod(rank, groups)
        out[i] = ((at if lap % 2 == 0 else groups - 1 - at) + turn) % groups
    return out


def pack_documents(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end: int = END, step_groups: int = STEP_GROUPS, waiting: int = WAITING) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length, ids (little-endian unsigned 32-bit), the
    sequence and the offset there, the sequence's context size and its step group."""
    path = path or default_path()
    fields = pa_schema(docs.sparkSession, SCHEMA)
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer, packer, held = ChunkTokenizer(path), Packer(tiers), {}
        count, turn = 0, part

        def rows(sequences: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal count, turn
            sizes = [sum(p[0] for p in s) for s in sequences]
            group = [0] * len(sequences)
            for size in set(sizes):
                own = [i for i, x in enumerate(sizes) if x == size]
                for i, g in zip(own, serpentine([sum(p[0] ** 2 for p in sequences[i]) for i in own], step_groups, turn), strict=True):
                    group[i] = g
                turn += len(own)
            out: list[tuple] = []
            for size, g, sequence in zip(sizes, group, sequences, strict=True):
                offset = 0
                for n, doc, at in sequence:
                    doc_id, ids, left = held[doc]
                    piece = ids[4 * at : 4 * (at + n)]
                    out.append((doc_id, at, n, piece, crc32(piece), len(ids) // 4, (part << 36) + count, offset, size, g))
                    offset += n
                    left -= n
                    if left:
                        held[doc] = (doc_id, ids, left)
                    else:
                        del held[doc]
                count += 1
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields.types, strict=True)], schema=fields)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields.types, strict=True)], schema=fields)

        number, full, ready = 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokenizer.ids([text.as_py()])[0] + last
                held[number] = (doc_id.as_py(), ids, len(ids) // 4)
                new = packer.add(number, len(ids) // 4)
                full += new
                ready += len(new)
                number += 1
                if packer.tokens + ready * tiers[-1] >= waiting:
                    yield from rows(full + packer.pack(False))
                    full, ready = [], 0
        yield from rows(full + packer.pack(True))

    return texts(docs).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.drop("ids")
