"""Ranked lexical search of a set of items over all documents, by bag deduplication.

For the search a document is its bag: how often each term of the items occurs in it, and the length norm m.  Documents
of one bag and m make up a class: they are brought together by a hash of both, and told apart by both.  A class is scored
once for all items, whatever its size, and of its members, by ascending id, the first ones stand for it in the ranking.

A term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's norm m = 50 + (50 n N) div L, and a score sums
w ((1000000000 tf) div (1000 tf + 20 m)) over the item's terms, once each: N counts the documents with a term, L all terms,
n those of the document, df the documents with the term, tf its occurrences in the document.

Items are taken in blocks of about `BLOCK_TERMS` distinct terms, so what is sent to the tasks is bounded; each block reads all
documents.  A task hands on, of every stretch of classes, those of each item's first `k` by score and least id: what comes before
one of the first `k` documents has fewer than `k` classes, so none is missed.

Defined results: a null or empty text has no terms, such a document counts in nothing and such an item has no rows; rows
that share an item id are one item with the terms of all; an item without an id is one too; documents that share an id
are ranked each, those without an id come last among equal scores; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import _slices
from ledgerlens.llm.shared import BROADCAST_KEYS, buckets_for, for_python, lean
from ledgerlens.scratch import scope, written

#: Distinct terms of the items of one block, about.
BLOCK_TERMS = 200_000
#: Classes that are scored at once, about.
_STRETCH = 1 << 15
#: Bytes of text that are cut into terms at once, about.
_TEXT_BYTES = 1 << 20
#: Fixed values of the contract: a byte of a term stands for itself, A-Z for a-z, any other ASCII character ends a term.
_FOLDED = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_FOLDED[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Row and number of each term of the texts, in order, and the distinct terms that these numbers mean."""
    texts = pa.array(pc.fill_null(texts.cast(pa.large_string()), ""))
    held = texts.buffers()[2]
    if held is None or not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    folded = pa.py_buffer(_FOLDED[np.frombuffer(held, np.uint8)])
    texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], folded], offset=texts.offset)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = words.dictionary.to_pylist()
    if "" in distinct:
        some = number != distinct.index("")
        row, number = row[some], number[some]
    return row, number, distinct


def _packed(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each stretch of rows of a table of numbers as the bytes of unsigned 32-bit integers."""
    offsets = np.concatenate([[0], ends]) * 4 * parts.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(parts, "<u4"))]).cast(pa.binary())


def _item_terms(batches):
    for batch in batches:
        done = 0
        for part in _slices(batch.column(1), _TEXT_BYTES):
            row, number, distinct = terms_of(part)
            pairs = np.unique(row << 32 | number)
            item = batch.column(0).slice(done, len(part)).take(pa.array(pairs >> 32))
            done += len(part)
            yield pa.RecordBatch.from_arrays([item, pa.array(distinct, pa.string()).take(pa.array(pairs & 0xFFFFFFFF))], names=["item", "term"])


def bags(docs: DataFrame, places: dict[str, int]) -> DataFrame:
    """Rows (doc_id, n, bag) of documents (doc_id, text) with a term: how many they have, and pairs (place, count) of those in `places`, packed."""
    held = docs.sparkSession.sparkContext.broadcast(places)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = 0
            for part in _slices(batch.column(1), _TEXT_BYTES):
                row, number, distinct = terms_of(part)
                n = np.bincount(row, minlength=len(part))
                place = np.fromiter((held.value.get(w, -1) for w in distinct), np.int64, len(distinct))[number]
                pairs, count = np.unique((row << 32 | place)[place >= 0], return_counts=True)
                ends = np.searchsorted(pairs >> 32, np.arange(len(part)), "right")
                ids = batch.column(0).slice(done, len(part))
                done += len(part)
                made = pa.RecordBatch.from_arrays([ids, pa.array(n), _packed(np.stack([pairs & 0xFFFFFFFF, count], axis=1), ends)], names=["doc_id", "n", "bag"])
                yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(lean(run), f"doc_id {kind}, n long, bag binary")


def _unpacked(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and count of each pair of these bags."""
    size = pc.binary_length(bags).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    pairs = np.frombuffer(b"".join(bags.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), size), pairs[:, 0], pairs[:, 1]


def _documents_with(size: int):
    """Of batches (bag, copies) the number of documents that have each of `size` terms."""

    def run(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            row, place, _ = _unpacked(batch.column(0))
            np.add.at(seen, place, batch.column(1).to_numpy()[row])
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["place", "df"])

    return run


def _firsts(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """The rows of the `k` largest scores above 0, of equal ones those of least rank."""
    rows = np.flatnonzero(scores)
    if len(rows) > k:
        least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= least]
    return rows[np.lexsort((rank[rows], -scores[rows]))[:k]]


def _scores(items, weights: np.ndarray, k: int):
    """Rows (item, score, h, m, bag, least) of the classes (h, m, bag, least) that may be among an item's first `k`.

    `items` holds the places of each item's terms.
    """

    def of_stretch(held: pa.Table, floor: list[int]) -> pa.RecordBatch:
        # scores count exactly in 64 bits: a term adds to each of its rows once
        row, place, tf = _unpacked(held["bag"].combine_chunks())
        order = np.argsort(place, kind="stable")
        row, place, tf = row[order], place[order], tf[order]
        gain = weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * held["m"].to_numpy()[row]))
        first = np.searchsorted(place, np.arange(len(weights) + 1))
        rank = np.empty(held.num_rows, np.int64)
        rank[pc.sort_indices(held["least"], null_placement="at_end").to_numpy()] = np.arange(held.num_rows)
        found, whose, points = [], [], []
        total = np.zeros(held.num_rows, np.int64)
        for number, mine in enumerate(items.value):
            total[:] = 0
            for p in mine:
                a, b = first[p], first[p + 1]
                total[row[a:b]] += gain[a:b]
            best = _firsts(total, rank, k)
            best = best[total[best] >= floor[number]]
            if len(best) == k:
                floor[number] = total[best[-1]]
            found.append(best)
            whose.append(np.full(len(best), number))
            points.append(total[best])
        rows = held.take(pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (whose, points)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [rows[c].combine_chunks() for c in ("h", "m", "bag", "least")], names=["item", "score", "h", "m", "bag", "least"])

    def run(batches):
        held, rows, floor = [], 0, [1] * len(items.value)
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _STRETCH:
                yield of_stretch(pa.Table.from_batches(held), floor)
                held, rows = [], 0
        if held:
            yield of_stretch(pa.Table.from_batches(held), floor)

    return run


def _ranked(docs: DataFrame, terms: list, k: int) -> DataFrame:
    """Rows (item_id, rank, doc_id, score) for the items of collected rows (item_id, term)."""
    spark = docs.sparkSession
    names = list(dict.fromkeys(r.item for r in terms))
    numbers = {name: i for i, name in enumerate(names)}
    places = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in terms))}
    mine = [[] for _ in names]
    for r in terms:
        mine[numbers[r.item]].append(places[r.term])
    own = written(bags(docs, places))
    documents, length = own.agg(F.count("*"), F.sum("n")).first()
    # div of Spark's SQL, as / would give doubles
    some = own.where("octet_length(bag) > 0").withColumn("m", F.expr(f"cast(50 + (50 * n * {documents}L) div {length or 1}L as bigint)")).withColumn("h", F.xxhash64("m", "bag"))
    classes = written(some.groupBy("h", "m", "bag").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    df = np.zeros(len(places), np.int64)
    counted = classes.select("bag", "copies").mapInArrow(lean(_documents_with(len(places))), "place long, df long")
    for r in counted.groupBy("place").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block at most
        df[r.place] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one broadcast for all tasks: items and weights are bounded by the block
    scored = classes.select("h", "m", "bag", "least").mapInArrow(lean(_scores(spark.sparkContext.broadcast(mine), weights, k)), f"item long, score long, h long, m long, bag binary, least {kind}")
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("least"), "h"))
    top = written(scored.withColumn("at", best).where(F.col("at") <= k).drop("at", "least"))
    chosen = top.select("h", "m").distinct()  # bags that share both with a chosen one drop out below
    chosen = F.broadcast(chosen) if len(names) * k <= BROADCAST_KEYS else chosen
    within = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id")))
    members = some.join(chosen, ["h", "m"], "left_semi").select("h", "m", "bag", "doc_id").withColumn("at", within).where(F.col("at") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "h"))
    ranked = top.join(members.drop("at"), ["h", "m", "bag"]).withColumn("rank", rank).where(F.col("rank") <= k)
    item = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {terms[0].kind}")
    return ranked.join(F.broadcast(item), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's first `k` documents with a score above 0, equal scores by ascending id."""
    for_python(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    with scope(docs.sparkSession) as lasting:
        terms = written(asked.mapInArrow(lean(_item_terms), f"item {kind}, term string").distinct())
        blocks = buckets_for(terms.count(), BLOCK_TERMS)
        found = None
        for number in range(blocks):
            block = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).withColumn("kind", F.lit(kind))
            rows = block.orderBy("item", "term").collect()  # about `BLOCK_TERMS` rows
            if rows:
                part = _ranked(source, rows, k)
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = source.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {source.schema['doc_id'].dataType.simpleString()}, score long")
        return lasting(found)
