"""Spelling groups against every pair of words, in one cell and in many, and the words against a plain count."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import spelling


def at_one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [u for u in counts if u != w and at_one_error(w, u)]
        best = min(((-counts[u], u) for u in near), default=None)
        out[w] = (n, len(near), *((best[1], -best[0]) if best and -best[0] >= 2 * n else (None, None)))
    rooted = {}
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rooted[w] = (*row, root)
    return rooted


def some_words(seed, alphabet, count, low=5, high=11):
    pick = random.Random(seed)
    return sorted({"".join(pick.choice(alphabet) for _ in range(pick.randint(low, high))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(12))
def test_both_searches_find_each_pair_once(seed):
    words = some_words(seed, "abcé"[: 2 + seed % 3], [1, 4, 200, 0][seed % 4], high=9)
    pick = random.Random(seed)
    counts = np.array([pick.randint(3, 40) for _ in words], np.int64)
    want = brute(dict(zip(words, counts.tolist())))
    found, best, all_ = Counter(), {}, np.ones(len(words), bool)
    for side in (0, 1):
        for row, near, form in zip(*spelling.near_words(words, counts, all_, all_, side)):
            found[words[row]] += near
            if form >= 0:
                best[words[row]] = min(best.get(words[row], (0, "")), (-counts[form], words[form]))
    assert {w: found[w] for w in words} == {w: row[1] for w, row in want.items()}
    assert {w: best.get(w, (0, None))[1] for w in words} == {w: row[2] for w, row in want.items()}


@pytest.mark.parametrize("cell", [1 << 15, 64, 10])
def test_cells_and_chunks_give_the_same(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    words = some_words(3, "abc", 300) + [f"same{w}" for w in some_words(4, "xyz", 60, 3, 6)] + ["münchen", "munchen", "muenchen"]
    counts = {w: 3 * 2 ** (zlib.crc32(w.encode()) % 5) for w in words}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.with_roots(spelling.variants(rows)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == brute(counts) and len(found) == len(counts)


def test_groups_of_texts(spark):
    pick = random.Random(5)
    vocabulary = some_words(6, "abcdÀé", 40, 4, 8)
    rows = [(i, " ".join(pick.choice(vocabulary).upper() if pick.random() < 0.2 else pick.choice(vocabulary) for _ in range(60)) + "; ab1cd-efghi") for i in range(80)]
    rows += [(None, "without without without wizhout"), (None, "without an id"), (3, None), (4, ""), (5, "long " + "verylongword" * 2000), (6, rows[6][1]), (6, rows[6][1])]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, word int, n int, root int")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = brute({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    found = spelling.groups(docs).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == want and len(found) == len(want) > 30
    assert spelling.groups(docs.limit(0)).count() == 0


def test_long_chains_of_forms_end_at_one_root(spark):
    rows = [(f"w{i:05d}", f"w{i + 1:05d}" if i < 40 else None) for i in range(41)]
    found = spelling.with_roots(spark.createDataFrame(rows, "word string, form string"))
    assert {r.root for r in found.collect()} == {"w00040"}
    assert found.where(F.col("word") == "w00000").count() == 1
