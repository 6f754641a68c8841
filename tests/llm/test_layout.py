"""Sharding and packing: laws, round trips and brute force of the trees."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """Best fit by looking at every open bin."""
    room, out = [], []
    for n in lengths:
        fits = [(r, b) for b, r in enumerate(room) if r >= n]
        if fits:
            out.append(min(fits)[1])
            room[out[-1]] -= n
        else:
            out.append(len(room))
            room.append(max(capacity, n) - n)
    return out


def test_packing_tree_takes_the_tightest_window():
    pick = random.Random(7)
    for capacity in (16, 100, 2048):
        lengths = sorted((pick.randint(1, capacity) for _ in range(500)), reverse=True)
        at, offset = packing.best_fit_decreasing(np.array(lengths), capacity)
        want = best_fit(lengths, capacity)
        fill = lambda bins: sorted(sum(n for n, b in zip(lengths, bins) if b == k) for k in set(bins))
        assert fill(at.tolist()) == fill(want)
        used = {}
        for n, b, o in zip(lengths, at, offset):
            assert used.get(b, 0) == o
            used[b] = o + n
            assert used[b] <= capacity


def test_shard_tree_equals_brute_force():
    pick = random.Random(8)
    sizes = sorted((pick.randint(1, 130) for _ in range(600)), reverse=True)
    assert sharding.best_fit_decreasing(sizes, 100) == best_fit(sizes, 100)


@pytest.mark.parametrize("sizes, shards", [([], 4), ([5], 4), ([100, 1, 1, 1, 1], 3), ([7] * 40, 16), ([1000, 900, 3, 3, 3, 3], 4)])
def test_into_shards(sizes, shards):
    placed = sharding.into_shards(sizes, shards)
    assert len(placed) == len(sizes) and all(0 <= p < shards for p in placed)
    if sizes:
        held = [sum(s for s, p in zip(sizes, placed) if p == k) for k in range(shards)]
        assert max(held) - min(held) <= max(sizes)


def docs_of(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(f"word{pick.randrange(50)}" for _ in range(pick.randint(0, 120)))) for i in range(300)]
    rows += [(1000 + i, "same text " * 20) for i in range(60)] + [(5000, None), (5001, ""), (5002, None), (None, "no id"), (7, rows[7][1]), (9000, "x y " * 6000), (9001, "é ß 東京 " * 300)]
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, start int")


def test_shards_hold_whole_groups_of_near_equal_size(spark):
    docs = docs_of(spark)
    rows = sharding.assign(docs, 4).toPandas()
    assert len(rows) == docs.count()
    held = rows.groupby("shard")["size"].sum()
    assert held.max() - held.min() <= rows.groupby("group_key")["size"].sum().max()
    assert (rows.groupby("group_key")["shard"].nunique() == 1).all()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in rows.dropna().itertuples():
        body = (texts[row.doc_id] or "").encode()
        assert row.size == len(body) + 1 if row.doc_id != 7 else True
        assert row.text_crc32 == zlib.crc32(body)
    assert sharding.assign(docs.limit(0), 4).count() == 0


def test_pieces_give_back_every_document(spark):
    docs = docs_of(spark)
    window = 256
    pieces = packing.tokenised_pieces(docs, PATH, window, 1).withColumn("check", F.crc32("ids"))
    rows = packing.pack(pieces, window, order=("doc_id", "start", "check")).toPandas()
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in docs.where("doc_id <> 7").collect()}
    for doc_id, text in texts.items():
        part = rows[rows.doc_id == doc_id].sort_values("start")
        ids = np.frombuffer(b"".join(part.ids), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert part.start.tolist() == list(range(0, len(ids), window)) and (part.doc_tokens == len(ids)).all()
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= window
    total = rows.length.sum()
    assert rows.sequence_id.nunique() * window < 1.05 * total
    assert packing.pack(pieces.limit(0), window).count() == 0


def test_packing_is_repeatable(spark):
    pieces = packing.tokenised_pieces(docs_of(spark), PATH, 256, 1).withColumn("check", F.crc32("ids")).drop("ids")
    once, again = (sorted(map(str, packing.pack(p, 256, order=("doc_id", "start", "check")).collect())) for p in (pieces, pieces.repartition(7)))
    assert once == again


def test_ids_stay_out_of_the_bins(spark, monkeypatch):
    """Bins of ids took an executor beyond its memory; each piece gets its own ids back, repeated ones too."""
    sent, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda grouped, run, schema: sent.append(grouped._df.columns) or apply(grouped, run, schema))
    pieces = packing.tokenised_pieces(docs_of(spark), PATH, 256, 1).withColumn("check", F.crc32("ids"))
    order = ("doc_id", "start", "check")
    found = packing.pack(pieces, 256, order=order)
    assert [sorted(c) for c in sent] == [["_bin", "_row", "check", "doc_id", "length", "start"]]
    assert found.columns == [*pieces.columns, "sequence_id", "offset"]
    assert found.where("check <> crc32(ids) or length * 4 <> octet_length(ids)").isEmpty()
    slim = packing.pack(pieces.drop("ids"), 256, order=order)
    assert found.drop("ids").exceptAll(slim).isEmpty() and slim.exceptAll(found.drop("ids")).isEmpty()


def test_rows_alike_are_dealt_over_all_bins(spark):
    alike = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.lit(1) + F.col("id") * 0).alias("length"), F.lit("x").alias("_key"))
    other = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 200 + 1).alias("length"), F.lit("y").alias("_key"))
    found = packing.pack(alike.unionByName(other).repartition(6), 256)
    rows = found.selectExpr("sequence_id", "sequence_id >> 32 as bin", "length", "offset", "_key").toPandas()
    sizes = rows.groupby("bin").size()
    assert len(rows) == 109_000 and len(sizes) == 14 and sizes.max() < 1.2 * packing.BIN_PIECES
    assert rows.groupby("sequence_id").length.sum().max() <= 256 and not rows.duplicated(["sequence_id", "offset"]).any()
