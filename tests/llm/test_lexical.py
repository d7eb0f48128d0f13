"""Ranked search against scores of every document."""

import random
import re
from collections import Counter
from math import floor, log

import pytest

from shorewatch.llm.lexical import rank_documents


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def brute_force(docs, items, k=10):
    texts = [(key, Counter(terms(t))) for key, t in docs]
    texts = [(key, c) for key, c in texts if c]
    every, words = len(texts), sum(sum(c.values()) for _, c in texts)
    held = Counter(t for _, c in texts for t in c)
    weight = {t: floor(1000 * log((2 * every + 2) / (2 * df + 1))) for t, df in held.items()}
    own = {}
    for key, text in items:
        if key is not None:
            own.setdefault(key, set()).update(terms(text))
    out = []
    for item, wanted in own.items():
        scored = []
        for key, c in texts:
            m = 10 + 90 * sum(c.values()) * every // words
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return sorted(map(repr, out))


def sample(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "CaSe", "42"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(pick.choices(vocabulary, weights, k=n))
    docs = [(i, text(pick.choice([1, 3, 10, 60, 400]))) for i in range(n)]
    docs += [(None, text(5)), (3, text(8)), (n, None), (n + 1, ""), (n + 2, "?!"), *[(n + 10 + i, docs[0][1]) for i in range(30)]]
    items = [(i, text(pick.choice([1, 4, 20]))) for i in range(15)]
    return docs, [*items, (2, text(4)), (None, text(4)), (30, None), (31, ""), (32, "nowhere at all"), (33, docs[0][1])]


@pytest.mark.parametrize(("seed", "n", "options"), [(1, 300, {}), (2, 200, {"first": 8, "growth": 2}), (3, 80, {"query_bytes": 150, "first": 16})])
def test_ranks_equal_brute_force(spark, seed, n, options):
    docs, items = sample(seed, n)
    found = rank_documents(
        spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, score int").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
        **options,
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_force(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    query = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert rank_documents(docs, query).count() == rank_documents(one, items).count() == 0
    assert [r.doc_id for r in rank_documents(one, query).collect()] == [1]


def test_very_long_text(spark):
    docs = [(1, "the same word " * 200_000 + "needle"), (2, "needle"), (3, "hay")]
    items = [(1, "needle word")]
    found = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute_force(docs, items)
