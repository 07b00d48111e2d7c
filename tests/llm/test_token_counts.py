"""Token counts: limits, quantiles and the lengths themselves."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts as tc
from tidemark.llm.bpe import vocabulary


def test_any_limit_and_any_quantile(spark):
    lengths = [0, 0, 3, 5, 5, 5, 2000, 1023, 1024, 1025]
    histogram = tc.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    for r in tc.at_limits(histogram, [0, 4, 512, 1024, 4096, 4, 10**9]).collect():
        x = r.context_limit
        assert (r.n_within, r.n_longer) == (sum(n <= x for n in lengths), sum(n > x for n in lengths))
        assert (r.tokens_truncated, r.tokens_cut) == (sum(min(n, x) for n in lengths), sum(max(n - x, 0) for n in lengths))
    shares = [0.05, 0.2, 0.5, 0.61, 0.99, 1.0]
    got = {r.quantile: r.n_tokens for r in tc.quantiles(tc.suffix_sums(histogram), shares).collect()}
    assert got == {q: int(np.quantile(lengths, q, method="inverted_cdf")) for q in shares}
    none = histogram.where("false")
    assert [tuple(r) for r in tc.at_limits(none, [7]).collect()] == [(7, 0, 0, 0, 0)]
    assert [tuple(r) for r in tc.quantiles(tc.suffix_sums(none), [0.5]).collect()] == [(0.5, None)]
    assert tc.at_limits(histogram, []).count() == tc.quantiles(tc.suffix_sums(histogram), []).count() == 0
    with pytest.raises(ValueError, match="shares"):
        tc.quantiles(none, [0.0])


def test_lengths_are_those_of_the_library(spark):
    texts = [None, "", "a b", "a b", "x" * 5000, "word " * 30_000, "\u65e5\u672c <|endoftext|>"]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long, n_docs long")
    theirs = Tokenizer.from_file(vocabulary())
    want = sorted(len(theirs.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r.n_tokens for r in tc.token_lengths(df, vocabulary()).collect()) == want
    assert tc.token_lengths(df.where("false"), vocabulary()).count() == 0
    told = {r.context_limit: r.n_docs for r in tc.suffix_sums(tc.length_histogram(tc.token_lengths(df, vocabulary()))).collect()}
    assert told == {n: want.count(n) for n in want}
