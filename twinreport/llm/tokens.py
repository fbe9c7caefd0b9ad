"""Token ids of whole texts by a public tokenizer's file, exact and fast.

The tokenizer drops white space and never lets a token cross it, so a text's ids are those of its space-separated chunks
in a row; a chunk that ends in a letter and punctuation marks splits there too, as the tokenizer does. Chunks repeat a
lot; a bounded cache holds the ids of those seen, and only new words go through the library. Chunks over LONGEST
characters are never held, so the cache is bounded in bytes, too.

The tokenizer ignores case. A text of Latin-1 characters is lower-cased as a whole, which is exact there: each has one
lower-case form, and composing (NFC) changes none of them. A word of lower-case Latin-1 letters is left as it is by the
tokenizer's normalizer and its splits, so its ids are those of the library's BPE model alone.
"""

from __future__ import annotations

import os
from array import array

#: Chunks and words held by a worker as new ones; beyond it they become the old ones, and those that were are let go.
CACHED = 400_000
LONGEST = 64
MARKS = ".,;:!?*#$%&|<>()[]{}=+-_/\\^~`@"
#: Latin-1 in lower case, with spaces for \t, \n and \r.
LOWER = bytes(32 if i in b"\t\n\r" else ord(chr(i).lower()) for i in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known(dict[str, bytes]):
    """The ids of chunks; those of a new one are found as it is asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        probe = "\tÀÉ b, 'sc"
        normal = self.tokenizer.normalizer and self.tokenizer.normalizer.normalize_str(probe)
        if normal != " àé b, 'sc" or self.tokenizer.encode(probe, add_special_tokens=False).ids != self.tokenizer.encode("àé b , 's c", add_special_tokens=False).ids:
            raise ValueError(f"{path}: not a tokenizer that ignores case and splits at spaces and marks")
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The model's characters for the bytes of a letter's UTF-8.
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._found(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _found(self, chunk: str) -> bytes:
        """A word and the marks after it are two chunks."""
        word = chunk.rstrip(MARKS)
        if len(word) < len(chunk) and word and word[-1].isalpha() and len(word[-1].lower()) == 1 and "<|" not in chunk:
            return self[word] + self[chunk[len(word) :]]
        if chunk.isalpha() and max(chunk) <= "\xff":
            low = chunk.lower()
            return array("I", [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))]).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()


class ChunkTokenizer:
    #: What a worker process knows by file: it serves all its tasks.
    caches: dict[str, Known] = {}

    def __init__(self, path: str):
        if path not in self.caches:
            self.caches[path] = Known(path)
        self.cache = self.caches[path]
        self.tokenizer = self.cache.tokenizer

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            try:
                text = text.encode("latin-1").translate(LOWER).decode("latin-1")
            except UnicodeEncodeError:
                text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            out.append(b"".join(map(self.cache.__getitem__, text.split(" "))))
        return out


def let_go() -> None:
    """Frees what this worker process holds of token ids."""
    ChunkTokenizer.caches.clear()
