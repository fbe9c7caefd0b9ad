"""English stemmers from their published descriptions: Porter2 (snowball), Porter, and Paice/Husk (Lancaster).

They run as an Arrow batch function over the distinct vocabulary, whose stems are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOWELS = "aeiouy"

# ---- Porter2 -------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SPECIAL_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def porter2(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.lstrip("'") if word.startswith("'") else word
    if w in SPECIAL:
        return SPECIAL[w]
    if w[:1] == "y":
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in SPECIAL_1A:
        return w.replace("Y", "y")
    for s in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(s):
            if s.startswith("ee"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(DOUBLES):
                    w = w[:-1]
                elif len(w) <= r1 and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for s, t in STEP_2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + t
            break
    for s, t in STEP_3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + t
            break
    for s in STEP_4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# ---- Porter --------------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm.
P_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
P_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
P_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """v and c for each letter: y is a vowel after a consonant."""
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        s = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else ""
        if s and "v" in _shape(w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in ((P_STEP_2, 0), (P_STEP_3, 0), (tuple((s, "") for s in P_STEP_4), 1)):
        match = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if match:
            stem = w[: -len(match[0])]
            if _measure(stem) > least and (match[0] != "ion" or stem[-1:] in ("s", "t")):
                w = stem + match[1]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# ---- Lancaster -----------------------------------------------------------------------------------------------------

# Fixed values of the published algorithm: reversed ending, * only for an intact word, letters removed, appended, > go on.
LANCASTER = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y>
ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3.
mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4>
ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j>
vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.
""".split()  # noqa: SIM905
_RULE = re.compile(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])")
_RULES: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _r in LANCASTER:
    _m = _RULE.fullmatch(_r)
    _RULES.setdefault(_m[1][0], []).append((_m[1][::-1], bool(_m[2]), int(_m[3]), _m[4], _m[5] == ">"))


def lancaster(word: str) -> str:
    w = word
    while w:
        for ending, intact, removed, added, on in _RULES.get(w[-1], []):
            if not w.endswith(ending) or (intact and w != word):
                continue
            stem = w[: len(w) - removed]
            enough = len(stem) >= 2 if w[0] in VOWELS else len(stem) >= 3 and (w[1] in VOWELS or w[2] in VOWELS)
            if enough:
                w = stem + added
                if not on:
                    return w
                break
        else:
            return w
    return w


STEMMERS: dict[str, Callable[[str], str]] = {"porter2": porter2, "snowball": porter2, "porter": porter, "lancaster": lancaster, "none": lambda w: w}


def stem_table(words: DataFrame, stemmer: str) -> DataFrame:
    """word, stem for the distinct words of a one-column DataFrame; words are stemmed in lower case."""
    if stemmer not in STEMMERS:
        raise ValueError(f"no such stemmer: {stemmer}")
    stem = STEMMERS[stemmer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w is None else stem(w.lower()) for w in batch.column(0).to_pylist()], pa.string())], names=["word", "stem"])

    return words.toDF("word").distinct().mapInArrow(run, "word string, stem string")
