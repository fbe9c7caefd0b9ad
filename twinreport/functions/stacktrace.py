"""Stack traces in report descriptions: where they start, their frames, and how alike two are. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The header under which a stack trace is written back, and the frame around a function's name.
HEADER = "Distribution: Ubuntu 6.10 (edgy)\nGnome Release: 2.16.1 2006-10-02 (Ubuntu)\nBugBuddy Version: 2.16.0\n\n"
FRAME = ("#2  0xb588f19f in ", " ()")
UNKNOWN = ("??", "unknown")
RAISING = ("abort", "raise", "kernel_vsyscall", "??", "unknown")
HANDLER = "<signal handler called>"
TRACEBACK = "traceback (most recent call last)"

TRACE = "array<array<string>>"


def _at(text: Column, word: str) -> Column:
    return F.instr(text, word)


def stack_position(text: Column) -> Column:
    """struct(at: 1-based position of the trace's text or null, keep: whether what follows is a trace that can be read)."""
    low = F.lower(text)
    dis, rel, bby = (_at(low, w) for w in ("distribution", "gnome release", "bugbuddy"))
    buddy = (dis > 0) & (rel > 0) & (bby > 0) & (rel - dis < 100) & (bby - rel < 100)
    info = _at(low, "debugging information")
    form = (info > 0) & (_at(low, "package") > 0) & (_at(low, "version") > 0) & (_at(low, "synopsis") > 0)
    thread = F.regexp_instr(low, F.lit(r"thread \d+ \(thread"))
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(False).alias("keep"))
    made = lambda p, keep: F.struct(p.cast("int").alias("at"), F.lit(keep).alias("keep"))
    return F.when(buddy, made(dis, True)).when(form, made(info, True)).when(thread > 0, made(thread, False)).otherwise(none)


def split_description(text: Column, algorithm: str = "weight") -> tuple[Column, Column]:
    """The description before the trace, and the trace as threads of function names."""
    place = stack_position(text)
    before = F.when(place["at"].isNotNull(), F.substring(text, F.lit(1), place["at"] - 1)).otherwise(text)
    trace = F.when(place["keep"], stack_info(F.substring(F.lower(text), place["at"], F.length(text)), algorithm))
    return before, F.coalesce(trace, F.array().cast(TRACE))


def stack_info(text: Column, algorithm: str = "weight") -> Column:
    """Threads of function names of a trace's lower-case text."""
    at = _at(text, "\n#")
    # Without a frame only the last character is looked at.
    body = F.substring(text, F.when(at > 0, at).otherwise(F.greatest(F.length(text), F.lit(1))), F.length(text))
    threads = F.split(body, "\n\n", -1)
    gdb = F.array(signal_frames(threads)) if algorithm == "signal" else F.transform(threads, thread_frames)
    start = _at(text, TRACEBACK)
    return F.when(start > 0, F.array(python_frames(F.substring(text, start, F.length(text))))).otherwise(gdb)


def python_frames(text: Column) -> Column:
    """The word after each `in` of a traceback, without line breaks at its ends."""
    words = F.split(text, " ", -1)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(a == "in", F.regexp_replace(b, r"^\n+|\n+$", "")))
    return F.filter(pairs, lambda x: x.isNotNull())


def frame_name(record: Column) -> Column:
    """The function of one frame: after the first `in`, else the second word if there is an `at`, else unknown."""
    words = F.split(record, " ", -1)
    after_in = F.try_element_at(words, F.array_position(words, "in").cast("int") + 1)
    second = F.try_element_at(words, F.lit(2))
    name = F.when(F.array_contains(words, "in"), after_in).when(F.array_contains(words, "at"), second)
    return F.coalesce(name, F.lit("unknown"))


def _records(thread: Column) -> Column:
    """The text after each # from the first frame on; without a frame 0 what stands before the first # is a record too."""
    at = _at(thread, "#0")
    return F.split(F.when(at > 0, F.substring(thread, at + 1, F.length(thread))).otherwise(thread), "#", -1)


def thread_frames(thread: Column) -> Column:
    return F.transform(_records(thread), frame_name)


def signal_frames(threads: Column) -> Column:
    """Frames of the first thread after its last signal handler, without those that only raise."""
    records = _records(F.get(threads, 0))
    marks = F.transform(records, lambda r: F.contains(r, F.lit(HANDLER)))
    last = F.size(records) - F.array_position(F.reverse(marks), True).cast("int") + 1
    after = F.when(F.array_contains(marks, True) & (last > 1), F.slice(records, last + 1, F.greatest(F.size(records) - last, F.lit(0)))).otherwise(records)
    return F.filter(F.transform(after, frame_name), lambda f: ~f.isin(*RAISING))


def stack_text(trace: Column) -> Column:
    """A trace written so that it can be read again; empty for an empty trace."""
    threads = F.transform(trace, lambda t: F.when(F.size(t) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(t, lambda f: F.concat(F.lit(FRAME[0]), f, F.lit(FRAME[1]))), "\n"))).otherwise(""))
    return F.when(F.size(F.coalesce(trace, F.array().cast(TRACE))) == 0, "").otherwise(F.concat(F.lit(HEADER), F.array_join(threads, "\n")))


def _known(thread: Column) -> Column:
    return F.array_except(thread, F.array(*map(F.lit, UNKNOWN)))


def _no_trace(trace: Column) -> Column:
    return trace.isNull() | (F.size(trace) == 0)


def stack_similarity(primary: Column, secondary: Column, algorithm: str = "weight") -> Column:
    """How alike two traces are, from 0 to 1. signal: 1 if the primary is empty; weight and max: 0 if either is."""
    if algorithm == "signal":
        first, second = F.array_distinct(F.get(primary, 0)), F.get(secondary, 0)
        shared = F.size(F.array_intersect(first, second)) / F.size(first)
        return F.when(_no_trace(primary) | (F.size(F.coalesce(first, F.array().cast("array<string>"))) == 0), 1.0).when(_no_trace(secondary), 0.0).otherwise(shared)
    n = F.least(F.size(primary), F.size(secondary))
    pairs = F.zip_with(F.slice(primary, F.lit(1), n), F.slice(secondary, F.lit(1), n), lambda a, b: F.struct(F.size(F.array_intersect(_known(a), _known(b))).alias("i"), F.size(F.array_union(_known(a), _known(b))).alias("u")))
    if algorithm == "weight":
        shared = F.aggregate(pairs, F.lit(0), lambda s, p: s + p["i"])
        every = F.aggregate(pairs, F.lit(0), lambda s, p: s + p["u"])
        value = F.when(every == 0, 0.0).otherwise(shared / F.nullif(every, F.lit(0)))
    elif algorithm == "max":
        # One pair of threads without known frames makes the whole comparison 0.
        value = F.when(F.exists(pairs, lambda p: p["u"] == 0), 0.0).otherwise(F.array_max(F.transform(pairs, lambda p: p["i"] / F.nullif(p["u"], F.lit(0)))))
    else:
        value = F.lit(0.0)
    return F.when(_no_trace(primary) | _no_trace(secondary), 0.0).otherwise(value)
