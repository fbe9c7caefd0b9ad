"""License scans: fuzzy search for short notices in whole texts.

A text is lower-cased (A-Z) and reduced to its words joined by single spaces, so case, punctuation and line breaks never
count as edits. A notice may differ by up to k edits. It is split into k + 1 pieces: k edits leave at least one piece
intact (the pigeonhole principle), so exact occurrences of the pieces locate every candidate. Around each candidate the
regex library matches the whole notice with at most k edits, which gives the span and the number of edits. Besides, the
places where a base phrase's words stand one after another are counted exactly.

Defined results: a null text counts as empty; an empty text has no words, no places and score 0; a null doc_id is
returned as null; repeated rows each give a row; other columns are ignored; an empty table gives an empty result. Of
overlapping spans the one with fewest edits stays, then the longer, then the first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices as normalised words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under the eclipse public license": "epl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under a creative commons attribution": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}

#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, notice: string, start: long, end: long, first_word: long, n_words: long, edits: int>>"
)

_LOWER = bytes(range(256)).lower()
_TO_WORDS = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in _LOWER)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Notice:
    """A notice, its exact seeds with their places, and the bounded-error pattern."""

    def __init__(self, text: str, label: str):
        self.text, self.label, self.edits = text, label, len(text) // CHARS_PER_EDIT
        n, parts = len(text), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        self.seeds = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?e)(?:{regex.escape(text, special_only=True)}){{e<={self.edits}}}")

    def windows(self, raw: bytes) -> list[tuple[int, int]]:
        """Merged windows of bytes that hold every occurrence with at most `edits` edits. An edit moves at most four bytes."""
        found = []
        slack = 4 * self.edits
        for seed, at in self.seeds:
            p = raw.find(seed)
            while p >= 0:
                found.append((max(0, p - at - slack), p - at + len(self.text) + slack))
                p = raw.find(seed, p + 1)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) in bytes of the normalised text, without overlaps."""
        out = []
        for a, b in self.windows(raw):
            while a < len(raw) and raw[a] & 0xC0 == 0x80:
                a += 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
            piece = raw[a:b].decode("utf-8", "surrogatepass")
            before, start = 0, a
            for m in self.pattern.finditer(piece):
                start += len(piece[before : m.start()].encode("utf-8", "surrogatepass"))
                before = m.start()
                out.append((start, start + len(m[0].encode("utf-8", "surrogatepass")), sum(m.fuzzy_counts)))
        return out


def best(found: list[tuple]) -> list[tuple]:
    """Of overlapping (notice, start, end, edits) those with fewest edits, then the longer, then the first."""
    # Those chosen never overlap, so only the last one that starts before x ends can meet it.
    starts: list[int] = []
    chosen: dict[int, tuple] = {}
    for x in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1])):
        i = bisect_left(starts, x[2])
        if not i or chosen[starts[i - 1]][2] <= x[1]:
            insort(starts, x[1])
            chosen[x[1]] = x
    return [chosen[a] for a in starts]


def normalised(text: str) -> bytes:
    """The words, lower-cased, joined by single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split())


def base_places(raw: bytes, n_words: int, base: dict[str, str] = BASE) -> tuple[list[int], list[str]]:
    """First words of all places of the base phrases, and the labels found."""
    if not n_words:
        return [], []
    padded, places, labels = b" " + raw + b" ", [], []
    for phrase, label in base.items():
        wanted = b" " + phrase.encode() + b" "
        p, before, word = padded.find(wanted), 0, 0
        if p >= 0:
            labels.append(label)
        while p >= 0:
            word += padded.count(b" ", before, p)
            before = p
            places.append(word)
            p = padded.find(wanted, p + 1)
    return places, labels


def scan(notices: list[Notice], base: dict[str, str]):
    def each(batch: dict[str, list]) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {k.split()[0]: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            raw = normalised(text)
            n_words = raw.count(b" ") + 1 if raw else 0
            places, labels = base_places(raw, n_words, base)
            found = [(n, *s) for n in notices for s in n.spans(raw)]
            spans = []
            if found:
                words = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_UPPER))]
                spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
                for n, a, b, edits in best(found):
                    first, last = np.searchsorted(spaces, [a, max(a, b - 1)]).tolist()
                    spans.append({"label": n.label, "notice": n.text, "start": words[first][0], "end": words[last][1], "first_word": first, "n_words": last - first + 1, "edits": edits})
            score = max([1.0] * bool(places) + [1 - x["edits"] / len(x["notice"]) for x in spans], default=0.0)
            for k, v in (
                ("doc_id", doc_id), ("n_words", n_words), ("n_base", len(places)), ("first_word", min(places, default=None)), ("last_word", max(places, default=None)),
                ("base_labels", ",".join(sorted(set(labels)))), ("labels", ",".join(sorted({*labels, *(x["label"] for x in spans)}))), ("score", score), ("spans", spans),
            ):
                out[k].append(v)
        yield out

    return each


def license_scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: n_words, the exact places of base phrases, labels, score and the spans found (characters and words of the text)."""
    chosen, phrases = NOTICES if notices is None else notices, BASE if base is None else base
    return map_batches(texts(docs), lambda: scan([Notice(t, x) for t, x in chosen.items()], phrases), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
