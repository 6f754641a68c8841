"""Toxicity, fixity audit, URL lists and line dedup."""

import math
import random
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import lines, toxicity, urllists, warc

# -- toxicity ----------------------------------------------------------------------------------------------------


def prose(pick, words, count):
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) if pick.random() < 0.7 else pick.choice(words) for _ in range(count))


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(11)
    mild, rude = ["the", "and", "house", "tree"], ["zorgish", "zorgful", "blaxy"]
    rows = []
    for i in range(600):
        words = prose(pick, mild, pick.randint(5, 80)).split()
        toxic = int(i % 4 == 0)
        for _ in range(toxic * pick.randint(1, 3)):
            words.insert(pick.randrange(len(words)), pick.choice(rude))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i < 400] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    return docs, labels, rows


def test_toxicity_on_held_out_texts(labelled):
    docs, labels, rows = labelled
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((found[i] >= 0.5) == bool(k) for i, _, k in rows if i >= 400)
    assert right >= 0.98 * 200 and all(0 <= s <= 1 for s in found.values())


def test_toxicity_of_odd_texts(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "zorgiest thing"), (None, "the house"), (4, "the house and the tree " * 20000)], "doc_id long, text string")
    rows = [(r.doc_id, r.score) for r in toxicity.score(odd, model).collect()]
    assert len(rows) == 6 and rows[0] == rows[1] and rows[0][1] == rows[2][1] < 0.5 and rows[3][1] > 0.5 and rows[5][1] < 0.5
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == 5
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_one_of_the_classes(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert [r.score for r in toxicity.score(docs, model).limit(3).collect()] == pytest.approx([1 / (1 + 301)] * 3, abs=1e-6)


def grams(text):
    """The buckets of a text, and in how many of its distinct words each stands, character by character."""
    held = {}
    for word in {w for w in re.split(r"[\x20\x09-\x0D]+", text) if w}:
        marked = "\n" + word.lower() + "\n"
        found = set()
        for n in range(3, 7):
            for i in range(len(marked) - n + 1):
                value = 0
                for c in marked[i : i + n]:
                    value = (value * 0x01000193 + ord(c)) % (1 << 32)
                found.add((value ^ n) * 0x9E3779B1 % (1 << 32) >> 32 - toxicity.BUCKET_BITS)
        for bucket in found:
            held[bucket] = held.get(bucket, 0) + 1
    return held


def test_ratios_fit_and_scores_equal_brute_force(spark, labelled):
    docs, labels, rows = labelled
    model = toxicity.train(docs, labels)
    known = [(grams(t), k) for i, t, k in rows if i < 400]
    positive, negative = sum(k for _, k in known), sum(1 - k for _, k in known)
    ratios = {}
    for bucket in {b for g, _ in known for b in g}:
        p, n = sum(bucket in g for g, k in known if k), sum(bucket in g for g, k in known if not k)
        ratio = math.log((p + 1) / (positive + 2)) - math.log((n + 1) / (negative + 2))
        if abs(ratio / math.sqrt(1 / (p + 1) + 1 / (n + 1))) >= toxicity.CLEAR:
            ratios[bucket] = ratio
    names = sorted(ratios)
    assert len(names) > 20 and set(np.flatnonzero(model.weight)) <= set(names)
    x = np.array([[math.log1p(g.get(b, 0)) * ratios[b] for b in names] for g, _ in known])
    y, coefficients = np.array([k for _, k in known]), np.array([model.weight[b] / ratios[b] for b in names])
    # at the optimum the slope of the balanced loss is that of the weight decay
    off = (1 / (1 + np.exp(-(x @ coefficients + model.bias))) - y) * np.where(y == 1, 0.5 / positive, 0.5 / negative)
    assert abs(off.sum()) < 1e-3 and np.abs(x.T @ off + toxicity.DECAY * coefficients).max() < 1e-3
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t, _ in rows[::7]:
        raw = model.bias + sum(math.log1p(n) * model.weight[b] for b, n in grams(t).items())
        assert found[i] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def test_all_clear_buckets_take_part(spark):
    """Far more telling n-grams than any fixed number of features."""
    pick = random.Random(21)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rude = [word() for _ in range(400)]
    rows = [(i, " ".join([*(word() for _ in range(30)), *(rude if i % 2 else [])]), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int"))
    assert np.count_nonzero(model.weight) > 4096
    assert all((r.score >= 0.5) == r.doc_id % 2 for r in toxicity.score(docs, model).collect())


def test_ngrams_of_words():
    owner, bucket = toxicity.word_features(pa.array(["ab", "", "abc", "ab"]))
    for k, word in enumerate(["ab", "", "abc", "ab"]):
        assert set(bucket[owner == k]) == set(grams(word))
    assert [int((owner == k).sum()) for k in range(4)] == [3, 0, 6, 3]


# -- fixity ------------------------------------------------------------------------------------------------------


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "archive string, offset long, payload string, digest string")


def test_audit_equals_comparing_everything(spark):
    pick = random.Random(12)
    left = [(f"a{k % 3}", k * 50, f"payload {k} " * pick.randint(1, 4)) for k in range(900)]
    right = [(a, o, p + "?" if o % 1700 == 0 else p) for a, o, p in left if o % 4100 != 50] + [("a0", 10**6, "extra"), ("new", 0, "n")]
    found = {(r.archive, r.offset): r.status for r in warc.audit(records(spark, left), records(spark, right), 512).collect()}
    l, r = ({(a, o): p for a, o, p in side} for side in (left, right))
    want = {k: "missing" if k not in r else "extra" if k not in l else "changed" for k in {*l, *r} if l.get(k) != r.get(k)}
    assert found == want and {"missing", "extra", "changed"} == set(want.values())


def test_audit_of_equal_odd_and_empty_replicas(spark):
    left = records(spark, [("a", 0, None), ("a", 0, "two at one place"), ("a", 9, ""), (None, 1, "x"), ("b", None, "x"), ("c", 70000 * 20, "far")])
    assert warc.audit(left, left).count() == 0
    assert warc.audit(left.limit(0), left.limit(0)).count() == 0
    assert {r.status for r in warc.audit(left, left.limit(0)).collect()} == {"missing"}
    swapped = records(spark, [("a", 0, ""), ("a", 0, "two at one place"), ("a", 9, None), ("c", 70000 * 20, "far?")])
    assert [(r.archive, r.status) for r in warc.audit(left, swapped).collect()] == [("c", "changed")]


def test_upper_levels_are_only_as_high_as_needed(spark):
    leaves = spark.createDataFrame([("a", n, str(n)) for n in range(40)], "archive string, node long, digest string")
    levels = warc.tree(leaves)
    assert [x.count() for x in levels] == [40, 3, 1]


# -- URL lists ---------------------------------------------------------------------------------------------------


def test_hosts(spark):
    urls = ["http://A.example.com/x", "https://me@b.org:80?q", "ftp://c.org", None, "", "https://d.net#x", " https://e.net"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(urllists.host_of("u")).collect()
    assert [r[0] for r in rows] == ["a.example.com", "b.org", None, None, None, "d.net", "e.net"]


def test_lists_as_of_fetch_time(spark):
    pick = random.Random(13)
    hosts = ["x.com", "a.x.com", "b.a.x.com", "y.org", "z.net"]
    day = lambda: datetime(2024, pick.randint(1, 12), pick.randint(1, 28), pick.randint(0, 23))
    entries = [(pick.choice(hosts), day(), pick.random() < 0.6) for _ in range(30)] + [(None, day(), True), ("x.com", None, True), ("y.org", datetime(2024, 5, 5), True), ("y.org", datetime(2024, 5, 5), False)]
    captures = [(i, f"http://{pick.choice(hosts)}/p{i}", day()) for i in range(200)] + [(900, None, day()), (901, "http://x.com/", None), (902, "http://y.org/", datetime(2024, 5, 5)), (902, "http://y.org/", datetime(2024, 5, 5))]
    rows = urllists.judge(spark.createDataFrame([(*c, 1) for c in captures], "id long, url string, fetched timestamp, listed int"), spark.createDataFrame(entries, "domain string, since timestamp, listed boolean")).collect()
    assert len(rows) == len(captures)
    best = {}
    for domain, since, listed in entries:
        if domain and since:
            best[domain, since] = listed or best.get((domain, since), False)
    for row in rows:
        host = row.url and row.url.split("/")[2]
        fits = [(d.count("."), len(d), s, k) for (d, s), k in best.items() if host and row.fetched and (host == d or host.endswith("." + d)) and s <= row.fetched]
        want = max(fits)[3] if fits else False
        assert row.listed is want, row
        assert row.list_since == (max(fits)[2] if fits else None)


def test_empty_lists_and_captures(spark):
    captures = spark.createDataFrame([(1, "http://x.com", datetime(2024, 1, 1))], "id long, url string, fetched timestamp")
    entries = spark.createDataFrame([("x.com", datetime(2023, 1, 1), True)], "domain string, since timestamp, listed boolean")
    assert urllists.judge(captures, entries).first().listed is True
    assert urllists.judge(captures, entries.limit(0)).first().listed is False
    assert urllists.judge(captures.limit(0), entries).count() == 0


# -- lines -------------------------------------------------------------------------------------------------------


def test_boilerplate_lines_equal_brute_force(spark):
    pick = random.Random(14)
    rows = []
    for i in range(240):
        host = pick.choice(["h1", "h1", "h2", None])
        body = [pick.choice(["menu", "login", "", f"own {i}", "rare", "rare2"]) for _ in range(pick.randint(0, 9))]
        rows.append((i, host, "\n".join(body) if i % 11 else None))
    rows += [rows[3], rows[3], (999, "h3", "only\nmenu"), (1000, "h1", "menu\n" * 20000)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, host string, text string, pos int")
    found = lines.drop_boilerplate(table, "host", "text", 0.3, 3)
    assert found.columns == [*table.columns, "dropped_lines"]
    drop = set()
    for host in {h for _, h, _ in rows}:
        pages = [set((t or "").split("\n")) for _, h, t in rows if h == host]
        for line in set().union(*pages) - {""}:
            n = sum(line in p for p in pages)
            if n >= 3 and n / len(pages) > 0.3:
                drop.add((host, line))
    assert drop
    clean = lambda h, t: None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in drop)
    assert sorted(map(str, ((r.doc_id, r.text, r.pos) for r in found.collect()))) == sorted(map(str, ((i, clean(h, t), 5) for i, h, t in rows)))
    assert lines.drop_boilerplate(table.limit(0), "host", "text").count() == 0


def test_audit_of_pages_with_null_and_repeated_ids(spark, tmp_path):
    from ledgerlens.llm import queries

    rows = [(None, "u", "a" * 10), (None, "u", "b" * 20), (5, "u", "c"), (5, "u", "d" * 30), (5, "u", "e" * 7), (7, "u", "f"), (8, "u", "g")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted((r.archive, r.status, r.left_length) for r in queries.op3_warc_audit(spark, str(tmp_path)).collect())
    head = len("WARC-Target-URI: u\r\n\r\n")
    assert found[:1] == [("archive-0", "missing", head + 1)] and sorted(r[2] for r in found[1:]) == [head + 10, head + 20]
    assert all(r[0].startswith("archive-none-") and r[1] == "missing" for r in found[1:])
