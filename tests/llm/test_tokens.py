"""Token ids by chunks: exact for all of Latin-1, each word learned once, common words outlive a full cache."""

import random

import numpy as np
import pytest

from twinreport.llm import tokens


@pytest.fixture
def fresh():
    tokens.let_go()
    yield tokens.ChunkTokenizer(tokens.default_path())
    tokens.let_go()


def library(t, text):
    return t.tokenizer.encode(text, add_special_tokens=False).ids


def ids(t, text):
    return np.frombuffer(t.ids([text])[0], "<u4").tolist()


def test_latin_1_and_other_letters_are_exact(fresh):
    r = random.Random(8)
    letters = [chr(i) for i in range(256)]
    alphabetic = [c for c in letters if c.isalpha()]
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 8))) + " " + "".join(r.choice(alphabetic) for _ in range(r.randint(0, 12))) + r.choice(["", " ΑΣ", "Ł", "é"])
        assert ids(fresh, x) == library(fresh, x), repr(x)


def test_forms_of_a_word_are_one_chunk(fresh):
    want = library(fresh, "Straße STRASSE Élan ÉLAN élan")
    assert ids(fresh, "Straße STRASSE Élan ÉLAN élan") == want
    assert set(fresh.cache) == {"straße", "strasse", "élan"}


def test_common_words_outlive_a_full_cache(fresh, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 8)
    learned = []
    found = tokens.Known._found
    monkeypatch.setattr(tokens.Known, "_found", lambda self, chunk: learned.append(chunk) or found(self, chunk))
    for i in range(40):
        x = f"common w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}"
        assert ids(fresh, x) == library(fresh, x)
    assert learned.count("common") == 1 and len(fresh.cache) <= 8 and len(fresh.cache.old) <= 8


def test_other_kinds_of_tokenizers_are_refused():
    path = tokens.default_path().replace("word_bpe_49k", "byte_bpe_50k")
    with pytest.raises(ValueError, match="not a tokenizer"):
        tokens.ChunkTokenizer(path)
