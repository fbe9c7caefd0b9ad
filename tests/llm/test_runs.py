"""The n-gram join repeats its runs for all the levels that it takes."""

from twinreport.llm import ngram_join


def test_recall_holds_at_the_deepest_level():
    assert (1 - ngram_join.SIMILARITY**ngram_join.LEVELS) ** ngram_join.RUNS <= 1 - ngram_join.RECALL + 1e-12
