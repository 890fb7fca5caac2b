import pytest

from sitegrain.llm import toxicity


@pytest.mark.parametrize("n", [10, 500, 5_000])
def test_clauses_begin_at_the_last_break_however_far(n):
    grammar = toxicity.Grammar()
    long = "word " * n
    assert set(grammar.outcomes(f"the clerk said so. {long}idiot")) == {("insult",)}
    assert set(grammar.outcomes(f"the clerk said so {long}idiot")) == {("insult", "reported")}
    assert set(grammar.outcomes(f"idiot. he said so. {long}idiot. the clerk wrote {long}idiot")) == {("insult",), ("insult", "reported")}
    assert grammar.outcomes(f"the clerk said so. {long}idiot") == grammar.outcomes("idiot")
