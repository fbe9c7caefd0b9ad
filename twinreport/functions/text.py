"""Functions of text columns: decoding, template removal, tokens, sentences, messages. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order matters, &amp; comes last.
ENTITIES = (
    ("NEWLINE", "\n"),
    ("SEMICOLON", ";"),
    ("EQUAL", ";"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)

# Phrases of report templates, in the order in which they are removed.
TEMPLATES = (
    r"what were you doing when the application crashed\?",
    r"version:",
    r"description:",
    r"distribution:",
    r"package:",
    r"severity:",
    r"priority:[^\n]*\n",
    r"gnome-distributor:",
    r"version:",
    r"synopsis:",
    r"bugzilla-product:",
    r"bugzilla-component:[^\n]*\n",
    r"bugzilla-version:",
    r"description:",
    r"description of problem:",
    r"description of the crash:",
    r"steps to reproduce",
    r"additional information:",
    r"unknown reporter: [^,]*, changed to [^\.]*\.",
    r"setting qa contact to the default for this product.",
    r"this bug either had no qa contact or an invalid one.",
)

# Tails of a token after its first letter.
TOKEN_TAILS = {"full": "(?:[-_]?[a-zA-Z0-9])*", "hyphen": "(?:-?[a-zA-Z0-9])*", "letters": "[-a-zA-Z]*"}

# Messages to the author of a report.
TIPS = (
    "Some existing reports are quite alike.",
    "Could you give us more information?",
    "Your report is perfect! Please submit!",
)


def decode_entities(text: Column, legacy_equal: bool = True) -> Column:
    """Markers and HTML entities decoded, in order; EQUAL becomes a semicolon as in old dumps unless legacy_equal is false."""
    for marker, plain in ENTITIES:
        text = F.replace(text, F.lit(marker), F.lit("=" if marker == "EQUAL" and not legacy_equal else plain))
    return text


def strip_template(text: Column) -> Column:
    """Each phrase of a template, in any case, becomes a space.

    A text in which none occurs, as most are, is read once or twice instead of once for each phrase.
    """
    union = lambda colon: text.rlike("(?i)" + "|".join(p for p in TEMPLATES if (":" in p) == colon))
    out = text
    for pattern in TEMPLATES:
        out = F.regexp_replace(out, f"(?i){pattern}", " ")
    return F.when((F.contains(text, F.lit(":")) & union(True)) | union(False), out).otherwise(text)


def tokens(text: Column, tokenizer: str = "full", ascii_boundary: bool = False) -> Column:
    """Tokens in order: a letter at a word boundary (Unicode words unless ascii_boundary) and the tail of the variant."""
    tail = TOKEN_TAILS.get(tokenizer)
    pattern = tokenizer if tail is None else (r"(?<![0-9A-Za-z_])" if ascii_boundary else r"\b") + "[a-zA-Z]" + tail
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between full stops with a space or line break, and between blank lines; empty pieces stay."""
    return F.split(text, r"\.[ \n]|\n\n", -1)


def drops_report(description: Column, pattern: str) -> Column:
    return F.coalesce(description.rlike(pattern), F.lit(False))


def truncated(text: Column, limit: int = 512) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ..."))).otherwise(text)


def tip(n_duplicates: Column, n_sentences: Column) -> Column:
    return F.when(n_duplicates > 0, TIPS[0]).when(n_sentences > 0, TIPS[1]).otherwise(TIPS[2])


def encode_special(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("[[NEWLINE]]")), F.lit(";"), F.lit("[[SEMICOLON]]"))


def decode_special(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[[NEWLINE]]"), F.lit("\n")), F.lit("[[SEMICOLON]]"), F.lit(";"))


def date_seconds(date: Column) -> Column:
    """Seconds of the epoch at the day's midnight in the session's time zone."""
    return F.unix_timestamp(F.to_date(date, "yyyy-M-d"))


def drop_words(words: Column, key: Column, rate: float, seed: str = "drop") -> Column:
    """Words that stay when each is dropped with the rate: chosen by a hash of key and position, so reruns agree."""
    unit = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.filter(words, lambda w, i: unit(i) >= F.lit(rate))


def added_penalty(raw: Column, term: Column) -> Column:
    """A comma-separated list of penalty terms with one more; a null or empty list holds none."""
    return F.when(F.coalesce(raw, F.lit("")) == "", term).otherwise(F.concat_ws(",", raw, term))
