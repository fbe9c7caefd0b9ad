"""Settings of the report analytics, and the reader of `key:=value` files."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields, replace

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    stemmer: str = "none"  # none, porter2 (or snowball), porter, lancaster
    tokenizer: str = "full"  # full, hyphen, letters; or a pattern
    ascii_boundary: bool = False
    tfidf_algorithm: str = "bidf"  # tfidf, bidf
    stacktrace_algorithm: str = "weight"  # weight, max, signal
    scoring_strategy: str = "heuristic"  # weighted, heuristic, distweighted
    bug_summary_ratio: float = 0.5
    bug_description_ratio: float = 0.5
    bug_stacktrace_ratio: float = 0.0
    bug_primary_ratio: float = 0.7
    bug_nl_threshold: float = 0.5
    bug_stacktrace_threshold: float = 0.5
    bug_no_similar_threshold: float = 0.65
    bug_similar_percent: float = 0.8
    bug_similar_max: int = 10_000_000
    bug_duplicate_threshold: int = 10
    bug_duplicate_number: int = 5
    bug_sentence_number: int = 5
    penalty_weight: float = 100.0
    window_seconds: int = 2 * 365 * 86400
    drop_report_regexp: str = r"(#[0-9]+.*0x[0-9a-fA-F]{8})|(0x[0-9a-fA-F]{8}.*#[0-9]+)"
    small_group: int = 10
    middle_group: int = 30
    text_limit: int = 512


def parse_settings(text: str) -> dict[str, str]:
    """The pairs of a `key:=value` text. Comments start with #; blank lines are skipped; other lines are logged and skipped."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        parts = line.split(":=")
        if len(parts) != 2:
            log.warning("not a setting: %s", line)
            continue
        found[parts[0].strip()] = parts[1].strip()
    return found


def settings(values: dict[str, str], base: Settings | None = None) -> Settings:
    """Settings from the pairs that name one; others are ignored. Booleans: 1, true, yes, on."""
    base = base or Settings()
    made = {}
    for f in fields(Settings):
        if f.name in values:
            raw, kind = values[f.name], type(getattr(base, f.name))
            made[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return replace(base, **made)
