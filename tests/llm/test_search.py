"""Ranked search against a plain scoring of every document, by one block of items and by several."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = {}
    for item, mine in asked.items():
        rows = []
        for i, c, n in held:
            m = 50 + 50 * n * count // length
            rows.append((-sum(weight(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if t in c), i is None, i or 0))
        out[item] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(x for x in rows if x[0])[:k])]
    return {i: rows for i, rows in out.items() if rows}


def tables(spark):
    pick = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Größe", "naïve", "東京", "a1", "ß"]
    some = lambda n: " ".join(pick.choice(vocabulary[: pick.choice([5, 20, 45])]) for _ in range(n))
    docs = [(i, some(pick.randint(0, 30))) for i in range(300)] + [(1000 - i, "w1 w2; w2\tW3") for i in range(90)] + [(2000, None), (2001, ""), (2002, " .,! "), (7, "w1 w1"), (7, "w1 w1"), (None, "w4 w4 w4 w5"), (None, "w6"), (3000, "w7 x y " * 4000)]
    items = [(i, some(12)) for i in range(9)] + [(20, None), (21, "..."), (22, "nowhere"), (3, "w1 w44 東京"), (None, "w6 w7"), (30, "W1 w1 w2")]
    made = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id long, text string, n int, bag int, h int, rank int").repartition(5)
    return docs, items, made, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, term int")


@pytest.mark.parametrize("block, stretch, k, sent", [(200_000, 1 << 15, 50, 200_000), (20, 16, 50, 0), (200_000, 1, 3, 200_000)])
def test_search_equals_brute_force(spark, monkeypatch, block, stretch, k, sent):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "_STRETCH", stretch)
    monkeypatch.setattr(search, "BROADCAST_KEYS", sent)
    docs, items, made, asked = tables(spark)
    found = defaultdict(list)
    for r in search.search(made, asked, k).collect():
        found[r.item_id].append((r.rank, r.doc_id, r.score))
    assert {i: sorted(rows) for i, rows in found.items()} == brute(docs, items, k)


def test_search_without_rows(spark):
    _, _, docs, items = tables(spark)
    assert search.search(docs.limit(0), items).count() == search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, items.where("item_id in (20, 21, 22)")).count() == 0
