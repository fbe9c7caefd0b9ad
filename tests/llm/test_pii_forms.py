"""Personal data: forms that are proposed whole, overlaps, many spans in one text, and precision on templates never seen."""

import random
import time

import numpy as np

from twinreport.llm import pii


def test_slash_long_spelled_and_letter_forms_are_candidates():
    local, domain, letters = "a" * 90, "b" * 150 + ".org", "QwErTyUiOpAsDfGhJkLzXcVb"
    text = f"call 0211/123456 or {local} [AT] {domain} or ann (at) site.org, key {letters} and DE12 3456 7890 1234 5678"
    found = {(k, text[a:b]) for k, a, b in pii.candidates(text)}
    assert {("phone", "0211/123456"), ("email", f"{local} [AT] {domain}"), ("email", "ann (at) site.org")} <= found
    assert {("secret", letters), ("account", "DE12 3456 7890 1234 5678")} <= found


def test_free_against_brute_force():
    """A long span before many short ones counts, however many there are."""
    r = random.Random(3)
    for n in (1, 5, 80, 300):
        spans = [("ip", a := r.randint(0, 900), a + r.randint(1, 8)) for _ in range(n)] + [("email", 40, 300)]
        starts, ends = pii.merged(spans)
        for _ in range(300):
            a = r.randint(0, 920)
            b = a + r.randint(1, 30)
            assert pii.free(starts, ends, a, b) == all(b <= x or y <= a for _, x, y in spans)


def test_many_spans_in_one_text():
    fitted = pii.model()
    text = "call (415) 555-1234, mail a@b.cd from 10.0.0.1\n" * 20_000
    started = time.monotonic()
    base, spans = pii.spans_of(text, fitted)
    assert time.monotonic() - started < 60
    assert len(base) == 40_000 and len(spans) == 60_000
    ordered = sorted(spans, key=lambda s: s[1])
    assert all(a[2] <= b[1] for a, b in zip(ordered, ordered[1:], strict=False))


def test_precision_on_unseen_templates():
    raw, y, kinds = pii.held_out_scores()
    trees, a, b, least = pii.model()
    p, kinds = 1 / (1 + np.exp(-(a * raw + b))), np.array(kinds)
    chosen = p >= least
    assert y[chosen].mean() >= 0.985
    for kind in sorted(set(kinds.tolist())):
        own = kinds == kind
        assert y[own & chosen].mean() > 0.9, kind
        assert y[own & chosen].sum() > 0.5 * y[own].sum(), kind
    made = pii.examples()
    assert len({t for *_, t in made}) == len(pii.templates(random.Random(1)))
    # Calibrated: among held-out spans, probabilities mean what they say.
    for low, high in ((0, 0.2), (0.8, 1.01)):
        part = (p >= low) & (p < high)
        assert abs(y[part].mean() - p[part].mean()) < 0.1
