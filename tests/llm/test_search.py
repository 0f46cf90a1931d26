"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from genloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, term string, item long, score int")
    return d, spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["W%d" % i for i in range(60)] + ["é%dÉ" % i for i in range(10)] + ["a_b", "naïve"]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, pick(rng.randint(1, 80))) for i in range(300)]
    docs += [(None, pick(20)), (None, None), (7, pick(30)), (7, docs[7][1]), (500, ""), (501, " .\n"), (502, "W1 " * 40_000)]
    docs += [(600 + i, docs[3][1]) for i in range(90)]  # ties
    items = [(i, pick(rng.randint(1, 12))) for i in range(25)] + [(3, pick(4)), (None, "W2 w3"), (90, None), (91, ""), (92, "absent"), (93, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("most_places", "triples"), [(500_000, 2_000_000), (40, 500)])
def test_search_equals_brute_force(spark, corpus, monkeypatch, most_places, triples):
    monkeypatch.setattr(lexical, "TRIPLES", triples)
    docs, items = corpus
    d, i = tables(spark, docs, items)
    found = lexical.search(d.repartition(3), i, 20, most_places).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(docs, items, 20)


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    for d, i in (([], items[:3]), (docs[:3], []), ([], []), ([(1, None), (2, "")], items[:3])):
        found = lexical.search(*tables(spark, d, i))
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_radix_order_and_large_document_weights():
    keys = np.random.default_rng(1).integers(0, 1 << 45, 5000)
    assert (np.diff(keys[lexical.radix_order(keys)]) >= 0).all()
    assert lexical.radix_order(np.array([3, 3, 1, 3])).tolist() == [2, 0, 1, 3]
    assert lexical.document_weight(np.array([10**7]), 10**13, 10**16).tolist() == [50 + 50 * 10**7 * 10**13 // 10**16]
