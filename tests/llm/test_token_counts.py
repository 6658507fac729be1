import random

import pytest

from codelattice.llm import token_counts as op

tiktoken = pytest.importorskip("tiktoken")


def test_histogram_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>", "x" * 9000, "don't  stop\n\n now", "été 123"] + [" ".join(rng.choice(["alpha", "beta", "  ", "7"]) for _ in range(rng.randrange(90))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[6:20])], "doc_id bigint, text string")
    enc = op._encoder(open(op.TOKENIZER, "rb").read(), op.PATTERN)
    n = [len(enc.encode_ordinary(t or "")) for t in texts + texts[6:20]]
    for by in (op.RANGE, 7):
        rows = op.length_histogram(op.encoded_lengths(docs), by).collect()
        assert {r["length"]: r["n_docs"] for r in rows} == {x: n.count(x) for x in n}
        for r in rows:
            limit = r["length"]
            assert r["docs_from"] == sum(x >= limit for x in n) and r["tokens_from"] == sum(x for x in n if x >= limit)
            assert r["truncated_tokens"] == sum(min(x, limit) for x in n)
            assert abs(r["quantile"] - sum(x <= limit for x in n) / len(n)) < 1e-12
    histogram = op.token_counts(docs)
    for r in op.answer(histogram, [0, 5, 10**6]).collect():
        assert (r["n_docs"], r["n_tokens"], r["n_longer"], r["truncated_tokens"]) == (len(n), sum(n), sum(x > r["max_length"] for x in n), sum(min(x, r["max_length"]) for x in n))
    for r in op.quantiles(histogram, [0.5, 1.0]).collect():
        assert r["length"] == sorted(n)[max(0, -(-int(r["share"] * 1000) * len(n) // 1000) - 1)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, length int")
    assert op.token_counts(docs).count() == 0
    assert op.answer(op.token_counts(docs), [4]).first()["n_tokens"] == 0
