"""Exact, near and vector duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import embeddings, exact, shared, simhash


def labels(nodes, linked):
    """Least node of each one's component."""
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- components --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3), (7, 9)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, None), (-3, 5)]])
def test_components(spark, edges):
    found = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert found == labels({n for e in real for n in e}, real)


def test_components_of_a_random_graph(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)]
    found = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert found == labels({n for e in real for n in e}, real)


# -- exact -------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "a  b", "a\tb", "a b", "x" * 5000, "x" * 5001, "x" * 5000, "ab" * 3000 + " \n end", "ab" * 3000 + " end", "é" * 700, "é" * 701, " ", "a\xa0b"]


def docs_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))[::-1]
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in zip(ids, texts)], "doc_id long, text string, name string, row long")


@pytest.mark.parametrize("block", [8, 1024])
def test_exact_groups(spark, block):
    found = {r.doc_id: r for r in exact.groups(docs_of(spark, TEXTS), block_bytes=block).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in zip(range(len(TEXTS) - 1, -1, -1), TEXTS)}
    assert len(found) == len(TEXTS)
    for i, text in norm.items():
        same = [j for j, other in norm.items() if other == text]
        row = found[i]
        assert (row.keep_id, row.group_size, row.kept) == (min(same), len(same), i == min(same))
        assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_ties_and_rows_without_id(spark):
    docs = docs_of(spark, ["t", "t", "t", "t", "u"], [3, 3, None, 5, None])
    rows = exact.groups(docs).collect()
    assert sum(r.kept for r in rows) == 2 and {r.keep_id for r in rows} == {3, None}
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "u"), (3, "t")]
    assert exact.groups(docs.limit(0)).count() == 0


def test_names_of_one_level_are_distinct(spark):
    blocks = spark.range(500).selectExpr("cast(id % 300 as string) as block").distinct()
    named = exact._named(blocks, ["block"], 300)
    assert named.select("name").distinct().count() == named.count() == 300


# -- near --------------------------------------------------------------------------------------------------------


def by_hand(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "One two", "one TWO", "a b c d", "İ É ß word"]
    for _ in range(12):
        base = [pick.choice(words) for _ in range(250)]
        for _ in range(8):
            copy = list(base)
            for _ in range(pick.randint(0, 4)):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            out.append(" ".join(copy))
    out += [out[-1], out[-1], "long " * 30000]
    return out


@pytest.mark.parametrize("chunk", [4096, 3])
def test_near_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, bits long, key long")
    found = {r.doc_id: r for r in simhash.components(docs).collect()}
    prints = {i: by_hand(t) for i, t in enumerate(texts)}
    linked = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    want = labels(prints, linked)
    assert {i: (r.bits & (1 << 64) - 1, r.component_id) for i, r in found.items()} == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(texts) - 20
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_large_cells_give_a_link_to_each_member():
    base = np.uint64(0x123456789ABCDEF0)
    bits = np.array([base ^ np.uint64(1 << i) for i in range(40)] + [base, ~base], np.uint64)
    a, b = simhash._compared(bits, np.zeros(1, np.int64), 4)
    assert len(a) == 40 and set(np.concatenate([a, b]).tolist()) == set(bits[:-1].tolist())


def test_near_copies_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (None, "z y x w v")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.components(odd).collect()) == [(0, 0), (0, 4), (0, 4), (4, 4)]


# -- vectors -----------------------------------------------------------------------------------------------------


def vectors_of(dims, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    rows = [c + s * rng.standard_normal(dims) for c in centres for s in (0.0, 0.1, 0.2, 0.3, 0.35, 0.4) for _ in range(5)] + list(rng.standard_normal((40, dims)))
    rows += [rows[0], rows[0], 3 * rows[1], -rows[2]]
    return [list(map(float, r)) for r in rows] + [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] * dims, [1.0, 2.0]]


@pytest.mark.parametrize("dims, chunk", [(64, 16384), (64, 16), (20, 16384), (3, 7)])
def test_vector_components(spark, monkeypatch, dims, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    given = vectors_of(dims)
    table = spark.createDataFrame([(i, v, "label") for i, v in enumerate(given)], "vec_id long, embedding array<double>, weight string")
    sound = {i: np.array(v) for i, v in enumerate(given) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    linked = [(i, j) for i in sound for j in sound if i < j and len(sound[i]) == len(sound[j]) and cosine(sound[i], sound[j]) >= 0.9]
    want = labels(range(len(given)), linked)
    degree = {i: sum(i in e for e in linked) for i in range(len(given))}
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.components(table).collect()}
    assert len(linked) > 30
    assert found == {i: (degree[i], want[i]) for i in range(len(given))}


def test_vectors_empty_table(spark):
    assert embeddings.components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("coords", [1, 2, 4])
def test_cells_and_grids_find_every_pair_once(coords):
    rng = np.random.default_rng(coords)
    unit = embeddings._unit(np.concatenate([rng.standard_normal((150, 16)), np.repeat(rng.standard_normal((10, 16)), 20, axis=0) + 0.2 * rng.standard_normal((200, 16))]))
    layout = embeddings.Layout(16, 0.8, unit, 350)
    assert np.allclose(layout.rotation @ layout.rotation.T, np.eye(16)) and [b.stop - b.start for b in layout.blocks] == [8, 8]
    turned = unit @ layout.rotation
    for block in layout.blocks:
        here = turned[:, block]
        want = {(i, j) for i, j in zip(*np.nonzero(((here[:, None] - here[None]) ** 2).sum(-1) <= layout.budget(block))) if i < j}
        row, cell, visit = layout.cells(turned, block, coords)
        found = []
        for c in np.unique(cell):
            at = row[cell == c]
            for chunks in (1, 3):
                mine = at % chunks
                pairs = [(i, j) for i in range(chunks) for j in range(i, chunks)]
                met = []
                for i, j in pairs:
                    part = np.flatnonzero((mine == i) | (mine == j))
                    for a, b in embeddings._near(here[at[part]], visit[cell == c][part], mine[part], i << 32 | j, layout.budget(block)):
                        met += [tuple(sorted(p)) for p in zip(at[part][a].tolist(), at[part][b].tolist())]
                assert len(met) == len(set(met))
            found += met
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 500
