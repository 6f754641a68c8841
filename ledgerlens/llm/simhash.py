"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has bit i set if more than half of its shingles' 64-bit hashes have it set.  Two
fingerprints are linked if they differ in at most `radius` bits.  To find the links, the 64 bits are cut
into two segments of 32: of fingerprints within five bits at least one segment differs in at most two.  In the
table of each segment a fingerprint stands under every value of the Hamming ball of radius one around its own,
so two whose segments differ in up to two bits meet under some value.  What meets is compared in full.

Only distinct fingerprints take part.  The rows of a fingerprint's lookups are shuffled once, by value.  A value under
which very many may meet is known beforehand from the counts of the segments near it; it is dealt into cells, each
holding two of its chunks, so every pair still meets in some cell but no task holds more than two chunks; in large
cells a search from each found member over those not yet found gives a link to the first of each component
instead of all pairs.

Defined results: a null text counts as empty; a text without words has fingerprint 0; texts are read whole;
copies and repeated rows share a fingerprint and a component; a component's id is its smallest non-null
document id (null if none has one); other columns are not read; an empty table gives no rows.  Where one row of
each component is to stay, it is the one with the smallest document id, rows without an id come last, and of rows
that share the id the one whose text has the least hash; rows that repeat both id and text go down to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import BROADCAST_KEYS, buckets_for, connected_components, for_python, lean, one_of_each
from ledgerlens.scratch import scope, written

#: First bit and width of each segment.
SEGMENTS = ((0, 32), (32, 32))
#: Rows of one value in one cell's chunk, about.
CHUNK = 4096
#: Fingerprints whose lookups one task makes, about, and rows of cells that are compared at once.
LOOKED, COMPARED = 1 << 14, 1 << 16
#: Cells of at most this many rows are compared pair by pair.
SMALL = 24
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Fingerprint of a text in UTF-8: A-Z lower-cased, words between ASCII white space, XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), _BLOCK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4) -> DataFrame:
    """Rows (doc_id, h, bits): each document's text hash and its fingerprint as a signed long."""
    for_python(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bits = np.fromiter((fingerprint(t or b"", shingle_words) for t in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits.view(np.int64))], names=["doc_id", "h", "bits"])

    return source.mapInArrow(lean(run), f"doc_id {kind}, h long, bits long")


def _value(segment: int) -> Column:
    """The value of one segment, with the segment's number above it."""
    first, width = SEGMENTS[segment]
    return F.shiftrightunsigned("bits", first).bitwiseAND((1 << width) - 1).bitwiseOR(F.lit(segment << width).cast("long"))


def _lookups(batches):
    """Every fingerprint under the values of the ball of radius one around its own, for each segment.

    The key holds the segment's number above the value.
    """
    for batch in batches:
        bits = batch.column(0).to_numpy().view(np.uint64)
        for s, (first, width) in enumerate(SEGMENTS):
            value = (bits >> np.uint64(first)) & np.uint64((1 << width) - 1) | np.uint64(s << width)
            for flip in (0, *(1 << i for i in range(width))):
                yield pa.RecordBatch.from_arrays([pa.array((value ^ np.uint64(flip)).view(np.int64)), batch.column(0)], names=["key", "bits"])


def _star(bits: np.ndarray, radius: int) -> tuple[list, list]:
    """Links from the first of each component of these fingerprints to its others."""
    roots, others = [], []
    left = np.unique(bits)
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                roots.append(np.full(len(found), root))
                others.append(found)
                front.extend(found)
    return roots, others


def _compared(bits: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each stretch of `bits` that begins at `starts`."""
    size = np.diff(starts, append=len(bits))
    roots, others = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k in np.flatnonzero(size > SMALL):
        a, b = _star(bits[starts[k] : starts[k] + size[k]], radius)
        roots += a
        others += b
    small = size <= SMALL
    at = np.flatnonzero(np.repeat(small, size))
    ends = np.repeat(starts + size, size)[at]
    for step in range(1, SMALL):
        keep = at + step < ends
        at, ends = at[keep], ends[keep]
        if not len(at):
            break
        a, b = bits[at], bits[at + step]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        roots.append(a[near])
        others.append(b[near])
    return np.concatenate(roots), np.concatenate(others)


def _balls(batches):
    """Every value and count of `batches` under each value of the ball of radius one around its own."""
    for batch in batches:
        value = batch.column(0).to_numpy()
        for flip in (0, *(1 << i for i in range(max(width for _, width in SEGMENTS)))):
            yield pa.RecordBatch.from_arrays([pa.array(value ^ np.int64(flip)), batch.column(1)], names=["key", "count"])


def _links_of_cells(radius: int):
    """Links within each stretch of rows (key, cell, bits) that share key and cell; the rows come sorted by both."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in range(3)])
            rows += batch.num_rows
            if rows >= COMPARED:
                key, cell, bits = map(np.concatenate, zip(*held))
                starts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
                held, rows = [[key, cell, bits]], 0
                if len(starts):  # the last cell may go on in the next batch
                    last = starts[-1]
                    yield _batch(*_compared(bits[:last].view(np.uint64), np.concatenate([[0], starts[:-1]]), radius))
                    held, rows = [[key[last:], cell[last:], bits[last:]]], len(bits) - last
        if held:
            key, cell, bits = map(np.concatenate, zip(*held))
            starts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            yield _batch(*_compared(bits.view(np.uint64), np.concatenate([[0], starts]), radius))

    return run


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])


def _dealt(looked: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Rows (key, cell, bits) of lookups (key, bits): each in the cells of its key.

    The members of a key are those of the values near it.  Values with less than a ball's part of a chunk make up one chunk
    at most, so only the others, of which there are few, need to be counted by key.
    """
    ball = 1 + max(width for _, width in SEGMENTS)
    values = fingerprints.select(F.explode(F.array(_value(0), _value(1))).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    many = written(values.where(F.col("count") > CHUNK // ball))
    chunks = many.mapInArrow(_balls, "key long, count long").groupBy("key").agg((F.ceil(F.sum("count") / CHUNK) + 1).cast("long").alias("chunks"))
    chunks = written(chunks)
    few = chunks.count() <= BROADCAST_KEYS
    held = looked.join(F.broadcast(chunks) if few else chunks.hint("merge"), "key", "left")
    mine = F.pmod(F.xxhash64("bits"), F.col("chunks"))
    cell = lambda other: F.shiftleft(F.least(mine, other), 32).bitwiseOR(F.greatest(mine, other))
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), cell))
    return held.select("key", F.explode(cells).alias("cell"), "bits")


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (src, dst) that connect exactly the fingerprints (column bits, distinct) reachable by steps of `radius` bits.

    `radius` may be at most 5: up to there one of the two segments differs in at most two bits.
    """
    if not 0 <= radius <= 5:
        raise ValueError("two segments with balls of radius one on both sides reach five bits at most")
    for_python(distinct.sparkSession)
    rows = distinct.select("bits")
    looked = rows.repartition(buckets_for(rows.count(), LOOKED), "bits").mapInArrow(_lookups, "key long, bits long")
    cells = _dealt(looked, rows).repartition("key", "cell").sortWithinPartitions("key", "cell", "bits")
    return cells.mapInArrow(lean(_links_of_cells(radius)), "src long, dst long").distinct()


def rooted(marked: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (doc_id, h, bits, first), one per row of `marked`: first is the struct (none, doc_id, h) of its component's first row.

    `marked` has rows (doc_id, h, bits), `distinct` (bits, first) each fingerprint once, `linked` the links (src, dst).
    """
    of = connected_components(linked).select(F.col("node").alias("bits"), "component")
    found = written(distinct.join(of, "bits", "left").select("bits", "first", F.coalesce("component", "bits").alias("root")))
    firsts = written(found.groupBy("root").agg(F.min("first").alias("first")))
    named = found.select("bits", "root").join(firsts, "root").select("bits", "first")
    return marked.select("doc_id", "h", "bits").join(named, "bits")


def firsts_of(marked: DataFrame) -> DataFrame:
    """Rows (bits, first): of each fingerprint the first row, those without an id last."""
    return written(marked.groupBy("bits").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")))


def kept_of(found: DataFrame) -> DataFrame:
    """What `one_of_each` asks for, from `rooted`."""
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    return found.select(F.col("doc_id").alias("id"), F.col("h").alias("mark"), kept.alias("kept"))


def _found(docs: DataFrame, doc_id: str, text: str, shingle_words: int, radius: int) -> DataFrame:
    with scope(docs.sparkSession) as lasting:
        marked = written(fingerprints(docs, doc_id, text, shingle_words))
        distinct = firsts_of(marked)
        return lasting(rooted(marked, distinct, links(distinct, radius)))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """Rows (doc_id, bits, component_id), one per document."""
    return _found(docs, doc_id, text, shingle_words, radius).select("doc_id", "bits", F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """`docs` with one row of each component."""
    found = _found(docs, doc_id, text, shingle_words, radius)
    return one_of_each(docs, doc_id, F.xxhash64(F.col(text).cast("string")), kept_of(found))
