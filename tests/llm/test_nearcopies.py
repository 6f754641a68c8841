"""Near copies of the pipeline against brute force over whole shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import nearcopies, simhash
from ledgerlens.llm.shared import spanning_forest


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def edited_texts():
    """Texts with copies in which 0 to 12 words of 150 are changed, a chain of copies, short texts and texts without words."""
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 8)))

    def edited(words, n):
        words = list(words)
        for at in pick.sample(range(len(words)), n):
            words[at] = word()
        return words

    bases = [[word() for _ in range(pick.choice([60, 150, 400]))] for _ in range(40)]
    texts = [w for b in bases for w in (b, edited(b, max(1, len(b) // 50)), edited(b, len(b) // 30), edited(b, len(b) // 12))]
    for _ in range(12):
        texts.append(edited(texts[-1] if len(texts) > 161 else bases[0], 1))
    odd = [[], ["a"], ["a", "b"], ["A", "b"], ["a", "b", "c", "d", "e"], [x.upper() for x in bases[1]], bases[2][:-3]]
    return [" ".join(t) for t in texts + odd] + [" \n ", None]


@pytest.mark.parametrize("band_chunk, group_chunk", [(4096, 1 << 20), (2, 300)])
def test_stage_drops_every_near_copy(spark, monkeypatch, band_chunk, group_chunk):
    monkeypatch.setattr(nearcopies, "BAND_CHUNK", band_chunk)
    monkeypatch.setattr(nearcopies, "GROUP_CHUNK", group_chunk)
    texts = edited_texts()
    sets, bits = [shingles_of(t or "") for t in texts], [simhash.fingerprint((t or "").encode(), 4) for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    least = list(range(len(texts)))
    by_jaccard = 0
    for i in range(len(texts)):
        for j in range(i):
            near, close = jaccard(sets[i], sets[j]) >= 0.8, (bits[i] ^ bits[j]).bit_count() <= 4
            by_jaccard += near and not close
            if near or close:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert by_jaccard > 30
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, bits long")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least))


def test_one_set_for_each_text(spark, monkeypatch):
    """Rows of one text make one set, wherever they are read."""
    pick = random.Random(4)
    base = [f"w{pick.randrange(5000)}" for _ in range(120)]
    near = [*base[:60], "changed", *base[60:]]
    rows = [(i, " ".join(base)) for i in range(3000)] + [(5000, " ".join(near)), (6000, "quite another text of its own words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counted, plain = [], nearcopies._one_each

    def watched(sets):
        once = plain(sets)
        counted.append((sets.count(), once.count()))
        return once

    monkeypatch.setattr(nearcopies, "_one_each", watched)
    found = nearcopies.components(docs).collect()
    assert {r.component_id for r in found} == {0, 6000} and len(found) == len(rows)
    assert counted == [(counted[0][0], 2)] and counted[0][0] <= 2 * 4  # of each text at most one a task


def test_work_of_a_chain_grows_with_its_links(spark, monkeypatch):
    """Texts that are alike at 0.7 from one to the next are one group of candidates, but never brought together."""
    monkeypatch.setattr(nearcopies, "GROUP_CHUNK", 2000)
    words = [f"w{k}" for k in range(120 + 20 * 400)]
    texts = [" ".join(words[20 * i : 20 * i + 120]) for i in range(400)]  # neighbours share 96 of 136 shingles
    texts += [" ".join([*t.split()[:-1], "end"]) for t in texts[::50]]
    plain = nearcopies._verified
    acc = spark.sparkContext.accumulator(0)

    def counting(percent):
        run = plain(percent)

        def wrapped(batches):
            for batch in batches:
                acc.add(batch.num_rows)
                yield from run([batch])

        return wrapped

    monkeypatch.setattr(nearcopies, "_verified", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nearcopies.components(docs).collect()}
    assert found == {i: i if i < 400 else (i - 400) * 50 for i in range(len(texts))}
    assert 100 < acc.value <= 2 * len(texts)


def test_a_forest_connects_what_the_pairs_connect(spark):
    pick = random.Random(8)
    pairs = [(pick.randrange(60) + 100 * k, pick.randrange(60) + 100 * k) for k in range(5) for _ in range([0, 20, 60, 300, 1500][k])]
    pairs += [(1000, n) for n in range(1001, 1200)]  # a star
    table = spark.createDataFrame([(*p, *p) for p in pairs], "a long, b long, src long, dst long")

    def parts(edges):
        root = {n: n for p in pairs for n in p}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in edges:
            root[find(a)] = find(b)
        return {n: find(n) for n in root}

    def same(a, b):
        return {frozenset(n for n in a if a[n] == r) for r in a.values()} == {frozenset(n for n in b if b[n] == r) for r in b.values()}

    found = [tuple(r) for r in spanning_forest(table).collect()]
    assert set(found) <= set(pairs) and same(parts(found), parts(pairs)) and len(found) <= 1.3 * len({n for p in pairs for n in p})
    assert spanning_forest(table.where("a = b")).count() == 0


def test_least_values_of_blocks(monkeypatch):
    sets = [np.random.default_rng(i).integers(0, 1 << 63, n).astype(np.uint64) for i, n in enumerate([3, 1, 40, 7, 100])]
    whole = nearcopies.least_values(sets)
    monkeypatch.setattr(nearcopies, "_BLOCK", 16)
    assert (nearcopies.least_values(sets) == whole).all() and (whole[:, [2]] == nearcopies.least_values(sets[2:3])).all()
    assert nearcopies.least_values([]).shape == (128, 0) and nearcopies.band_keys(whole).shape == (32, 5)


def test_near_copies_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nearcopies.drop_near_copies(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (4, "a b"), (5, "A  b"), (None, "z y x w v")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in nearcopies.drop_near_copies(odd).collect()) == [0, 4]
