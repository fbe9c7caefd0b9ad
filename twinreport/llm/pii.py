"""Personal data in whole texts: exact base spans, and spans that boosted trees select among high-recall candidates.

Generators propose candidates liberally and may overlap: loose telephone numbers, social security numbers, bank accounts,
spelled-out e-mail addresses, long random strings. Trees boosted on features of a candidate's format (length, digits,
separators, entropy, check digits) and of its context (words and characters beside it) score each; the scores are
calibrated and cut at the threshold that reached a set precision on sentences whose whole template was held out of
training. Of overlapping selected spans the likeliest stays. Base spans always stay, and a selected span never overlaps one.

No table has labels for spans, so the trees learn from sentences composed by a seeded rule (`examples`) from templates of
personal data and of look-alikes; their number is the parameter EXAMPLES. Templates fall into FOLDS parts: scores for
calibration and threshold come from trees that saw no sentence of the template (`held_out_scores`, which also gives the
precision by kind). Texts of the corpus are never used to fit.

Defined results: a null text counts as empty; an empty text has no spans; a null doc_id is returned as null; repeated rows
each give a row; other columns are ignored by `find_pii` and returned by `redacted`, where n_chars (if there) follows the
new text and a null text stays null; an empty table gives an empty result. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, platt, threshold
from .common import map_batches, texts

#: Base kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds; listed after the base ones.
MORE = ("account", "secret", "ssn")
ORDER = {k: i for i, k in enumerate(KINDS + MORE)}

EXAMPLES = 4000
PRECISION = 0.99
FOLDS = 4
CONTEXT = 24

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Maximal areas of the characters of numbers; every number lies within one.
_AREA = re.compile(r"[0-9+][0-9+() .-]*")
#: The same with the slash of loose numbers.
_LOOSE_AREA = re.compile(r"[0-9+][0-9+() ./-]*")
#: What a run of digits doesn't begin, no later digit of it begins either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\+?1[ .-])?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_RANDOM = re.compile(r"[A-Za-z0-9_-]{20,}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+", re.I | re.A)
_SIGN = re.compile(r" ?[\[(]at[\])]", re.I | re.A)
_WORD = re.compile(r"[a-z]+")
_PERSONAL = frozenset("phone tel telephone call mobile cell fax sms whatsapp contact".split())
_NUMBERS = frozenset("ssn social security iban account bank transfer pay".split())
_SECRET = frozenset("token secret key password passwd apikey bearer auth credential pwd".split())
_OTHER = frozenset("commit version sha md5 checksum order invoice part isbn build serial ticket page id date model hash".split())

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each at sign outwards, which finds the same as the pattern from left to right but in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    found: dict[str, list[Span]] = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    for area in _AREA.finditer(text):
        a, b = area.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found["ip"].append(("ip", *m.span()))
        for m in _CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(("card", *m.span()))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found["phone"].append(("phone", *m.span()))
    return [s for k in KINDS for s in found[k]]


def candidates(text: str) -> list[Span]:
    """Proposed spans of any kind, overlaps included, from the whole text."""
    out: set[Span] = {("secret", *m.span()) for m in _RANDOM.finditer(text)}
    out.update(("account", *m.span()) for m in _ACCOUNT.finditer(text))
    for area in _LOOSE_AREA.finditer(text):
        a, b = area.span()
        if b - a >= 7:
            for kind, pattern in _LOOSE:
                out.update((kind, *m.span()) for m in pattern.finditer(text, max(0, a - 1), b))
    for sign in _SIGN.finditer(text):
        start = sign.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        m = _SPELLED.match(text, start)
        if m:
            out.add(("email", *m.span()))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    n = len(s)
    counts = Counter(s)
    digits = [c for c in s if "0" <= c <= "9"]
    left, right = text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    near = set(_WORD.findall(left))
    beside = near | set(_WORD.findall(right))
    shapes = len(set("".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in s)))
    return [
        float(ORDER[kind]),
        float(n),
        len(digits) / n,
        sum(c in " .-()/" for c in s) / n,
        sum(c.isupper() for c in s) / n,
        sum(c in "0123456789abcdef" for c in s) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        float(shapes),
        float(len(set(digits))),
        float(luhn("".join(digits))) if digits else 0.0,
        float(s[:1] == "+" or s[:1] == "("),
        float(bool(beside & _PERSONAL)),
        float(bool(beside & _NUMBERS)),
        float(bool(near & _SECRET)),
        float(bool(near & _OTHER)),
        float(left[-1:] in ("\"", "'", "=", ":")),
        float(left[-1:] in "#/_.-$" and bool(left)),
        float("=" in left[-6:] or ":" in left[-6:]),
        float(right[:1].isalnum()),
        float(s[-2:].isalpha()),
        float(s[:1].isalpha()),
    ]


def templates(r: random.Random) -> list[tuple[int, str, Callable[[], tuple[str, str]]]]:
    """(1 if personal or secret, kind, what makes a lead and a span of it): each is held out as a whole."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(k))
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    area = lambda: f"{r.randint(2, 9)}{d(2)}"
    digest = lambda: hexes(r.choice((32, 40, 64)))
    one = r.choice
    return [
        (1, "phone", lambda: (one(("call ", "phone: ", "tel ", "")), f"({area()}) {d(3)}-{d(4)}")),
        (1, "phone", lambda: (one(("mobile ", "contact us at ", "cell: ")), f"{area()}-{d(3)}-{d(4)}")),
        (1, "phone", lambda: (one(("call ", "whatsapp ", "sms to ")), f"{area()}.{d(3)}.{d(4)}")),
        (1, "phone", lambda: (one(("call ", "phone ", "", "or ")), f"+1 ({area()}) {d(3)}-{d(4)}")),
        (1, "phone", lambda: (one(("tel ", "fax: ", "telephone ")), f"0{d(3)} {d(3)} {d(4)}")),
        (1, "phone", lambda: (one(("phone ", "tel: ", "contact ")), f"0{d(3)}/{d(3)}{d(4)}")),
        (0, "phone", lambda: (one(("order ", "part no ", "invoice #")), f"{area()}{d(7)}")),
        (0, "phone", lambda: (one(("isbn ", "serial ", "build ")), f"{area()}-{d(3)}-{d(4)}")),
        (0, "phone", lambda: (one(("ticket ", "model ", "version ")), f"{area()}.{d(3)}.{d(4)}")),
        (0, "phone", lambda: (one(("id ", "page ", "invoice ")), f"0{d(3)} {d(4)}{d(3)}")),
        (0, "phone", lambda: (one(("order ", "date ", "build ")), f"0{d(2)}/{d(3)}{d(4)}")),
        (1, "ssn", lambda: (one(("ssn ", "ssn: ", "SSN = ")), f"{d(3)}-{d(2)}-{d(4)}")),
        (1, "ssn", lambda: (one(("social security number: ", "social security no ")), f"{d(3)}-{d(2)}-{d(4)}")),
        (0, "ssn", lambda: (one(("part ", "model ", "serial ")), f"{d(3)}-{d(2)}-{d(4)}")),
        (0, "ssn", lambda: (one(("ticket ", "id ", "order ")), f"{d(3)}-{d(2)}-{d(4)}")),
        (1, "secret", lambda: (one(("token = ", "secret: ", "token: ")), one((digest(), mixed(r.randint(20, 48)))))),
        (1, "secret", lambda: (one(("api key = ", "password=", "passwd: ")), one((digest(), mixed(r.randint(20, 48)))))),
        (1, "secret", lambda: (one(("auth token ", "bearer ", "credential ")), one((digest(), mixed(r.randint(24, 48)))))),
        (1, "secret", lambda: (one(("secret key: ", "key=", "pwd = ")), letters(r.randint(24, 40)))),
        (1, "secret", lambda: (f"{word()}_{one(('key', 'token', 'secret'))}=", one((digest(), mixed(r.randint(20, 48)))))),
        (0, "secret", lambda: (one(("commit ", "sha ", "md5 ")), digest())),
        (0, "secret", lambda: (one(("checksum: ", "hash ", "sha: ")), digest())),
        (0, "secret", lambda: (one(("version ", "build ", "see ")), "-".join(word() + d(1) for _ in range(5)) + word() * 3)),
        (0, "secret", lambda: (one(("", "/", "the ")), "-".join(word() for _ in range(8)).ljust(20, "e"))),
        (0, "secret", lambda: (one(("", "call ", "def ")), "_".join(word() for _ in range(8)).ljust(20, "e"))),
        (0, "secret", lambda: ("", "".join(word() for _ in range(9)).ljust(20, "a"))),
        (0, "secret", lambda: ("", (word() * 9 + d(2))[: r.randint(20, 30)].ljust(20, "a") + d(1))),
        (0, "secret", lambda: ("", one("-_=") * r.randint(20, 60) if r.random() < 0.7 else one("aehmox") * r.randint(20, 60))),
        (0, "secret", lambda: (one(("id ", "uuid ", "page ")), "-".join((hexes(8), hexes(4), hexes(4), hexes(4), hexes(12))))),
        (1, "account", lambda: (one(("iban ", "account: ", "")), one(COUNTRIES) + d(2) + "".join(" " + d(4) for _ in range(r.randint(3, 5))))),
        (1, "account", lambda: (one(("bank transfer to ", "pay to ", "IBAN: ")), one(COUNTRIES) + d(2) + d(4) * r.randint(3, 5))),
        (0, "account", lambda: (one(("model ", "part ")), one(("XK", "ZZ", "QA")) + d(2) + mixed(4).upper() + mixed(4).upper())),
        (0, "account", lambda: (one(("serial ", "build ", "version ")), one(("XK", "ZZ", "QA")) + d(2) + " " + mixed(4).upper() + " " + d(4))),
        (1, "email", lambda: ("", f"{word()}{one(('', '.' + d(2), '.' + word()))} (at) {word()}{one(('.com', '.example.net'))}")),
        (1, "email", lambda: (one(("mail ", "")), f"{word()}{one(('', '_' + word()))} [at] {word()}{one((' [dot] org', '.net'))}")),
        (1, "email", lambda: (one(("write to ", "")), f"{word()}.{word()} (at) {word()} [dot] {word()}.org")),
        (0, "email", lambda: ("", f"{word()} (at) {d(1)}.{d(1)}.{d(2)}")),
        (0, "email", lambda: (one(("version ", "build ")), f"{word()} [at] {d(2)}.{d(1)}")),
        (0, "email", lambda: (one(("page ", "see ")), f"{d(2)} (at) {d(2)}.{d(2)}")),
    ]


#: Parts of made-up words, and countries of made-up accounts.
SYLLABLES = ("an", "er", "th", "le", "on", "de", "is", "to", "re", "qu", "en", "st")
COUNTRIES = ("DE", "FR", "ES", "GB")


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, Span, int, int]]:
    """(text, span, whether it is personal or secret, template) composed by a seeded rule."""
    r = random.Random(seed)
    made = templates(r)
    prose = lambda: " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        y, kind, make = made[i % len(made)]
        lead, s = make()
        mark = r.choice(('"', "'", "")) if lead.endswith(("= ", ": ", "=")) else ""
        before = f"{prose()} {lead}{mark}"
        out.append((f"{before}{s}{mark} {prose()}", (kind, len(before), len(before) + len(s)), y, i % len(made)))
    return out


@cache
def held_out_scores(n: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Raw scores, truth and kind of every example by trees that were fitted without its template."""
    made = examples(n)
    x, y = np.array([features(t, s) for t, s, *_ in made]), np.array([v for *_, v, _ in made], float)
    template, raw = np.array([t for *_, t in made]), np.zeros(n)
    for fold in range(FOLDS):
        held = template % FOLDS == fold
        raw[held] = Boosted().fit(x[~held], y[~held]).raw(x[held])
    return raw, y, [s[0] for _, s, *_ in made]


@cache
def model(n: int = EXAMPLES, precision: float = PRECISION) -> tuple[Boosted, float, float, float]:
    """The trees, fitted on all examples; calibration a, b and threshold, set on the held-out scores."""
    made = examples(n)
    trees = Boosted().fit(np.array([features(t, s) for t, s, *_ in made]), np.array([v for *_, v, _ in made], float))
    raw, y, _ = held_out_scores(n)
    a, b = platt(raw, y)
    return trees, a, b, threshold(1 / (1 + np.exp(-(a * raw + b))), y, precision)


def free(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a:b meets none of the disjoint spans starts:ends, which ascend."""
    i = bisect_left(starts, b)
    return not i or ends[i - 1] <= a


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint areas that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def selected(text: str, base: list[Span], fitted: tuple[Boosted, float, float, float]) -> list[tuple[Span, float]]:
    """Added spans and their probabilities, without overlaps among themselves or with base spans."""
    starts, ends = merged(base)
    found = [s for s in candidates(text) if free(starts, ends, s[1], s[2])]
    if not found:
        return []
    trees, a, b, least = fitted
    p = 1 / (1 + np.exp(-np.clip(a * trees.raw(np.array([features(text, s) for s in found])) + b, -500, 500)))
    out: list[tuple[Span, float]] = []
    starts, ends = [], []
    for i in sorted(np.flatnonzero(p >= least), key=lambda i: (-p[i], found[i][1], found[i])):
        if free(starts, ends, found[i][1], found[i][2]):
            insort(starts, found[i][1])
            insort(ends, found[i][2])
            out.append((found[i], float(p[i])))
    return out


def spans_of(text: str, fitted: tuple[Boosted, float, float, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by kind, then start."""
    base = base_spans(text)
    return base, sorted(base + [s for s, _ in selected(text, base, fitted)], key=lambda s: (ORDER[s[0]], s[1], s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row per row of docs: base counts, the digest of the base spans, all spans as kind:start:end, how many the trees
    added and how many there are."""
    fitted = model(EXAMPLES, precision)

    def each(batch: dict[str, list]) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            base, spans = spans_of(text, fitted)
            n = Counter(s[0] for s in base)
            out["doc_id"].append(doc_id)
            for k in KINDS:
                out[f"n_{k}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(spans))
            out["n_added"].append(len(spans) - len(base))
            out["n_spans"].append(len(spans))
        yield out

    return map_batches(texts(docs), lambda: each, SCHEMA)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, and each run of overlapping ones, replaced by its first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """The rows of docs, all their columns, with personal data replaced in text."""
    fitted = model(EXAMPLES, precision)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            new = [None if t is None else redact(t, spans_of(t, fitted)[1]) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
