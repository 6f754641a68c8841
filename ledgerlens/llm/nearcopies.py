"""Near copies: documents linked by their fingerprints or by the Jaccard index of their word shingles.

Two documents are linked if their SimHash fingerprints link them (see `simhash`) or if at least `PERCENT` of the
distinct five-word shingles of both are shared.  Pairs of the second kind are found in three steps.  The least
values of a text's shingles under 128 permutations are cut into 32 bands of four: texts that share four fifths of
their shingles have no band in common in 5 of 100 million cases.  Texts that meet in a band are compared by their
128 values; those that agree in 75 or more (four fifths would give 102, with a deviation of 4.5) are candidates.  Whole
sets of shingles are then compared, so no link rests on an estimate.

Candidates are found by a search from each found member over those not yet found, which gives a tree of pairs instead of all.
Groups that these pairs connect are compared in one task each, to which every text is sent once, as long as the group's
shingles make up one chunk.  A larger group, which may be a long chain of texts that are alike only from one to the next,
is never brought together: of its pairs as many as connect it are verified, which joins what is truly alike, then as many as could
join what is still apart, and only the texts that meet a candidate of another component in a band are compared further, among
those of that band.  So work grows with the candidate
pairs, not with the square of a group.  Bands in which very many meet are dealt into cells of two chunks, as in `simhash`.

Defined results: words are those of the fingerprint; a text of fewer words than a shingle has is one shingle; texts
without words are linked by their fingerprint 0; shingles are told apart by 64 bits; null, repeated and missing input as
in `simhash`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import simhash
from ledgerlens.llm.shared import BROADCAST_KEYS, connected_components, for_python, lean, one_of_each, spanning_forest
from ledgerlens.scratch import scope, written

SHINGLE_WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 4
#: Of the values of two texts, how many agree at least in candidates.
AGREE = 75
#: Texts of one band in one cell's chunk, and shingles that are compared in one chunk.
BAND_CHUNK, GROUP_CHUNK = 4096, 1 << 20
#: Pairs of one node that one task verifies, about, and rounds in which pairs of large groups are verified.
PAIRS, TREES = 4096, 3
_BLOCK = 1 << 12
_draw = np.random.default_rng(5)
_XOR = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _draw.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the shingles in their order."""
    n = len(words) - shingle_words + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    found = np.zeros(n, np.uint64)
    for i in range(shingle_words):
        found = found * _A + each[i : i + n]
    return _mixed(found)


def least_values(sets: list[np.ndarray]) -> np.ndarray:
    """Least value of each non-empty set (columns) under each permutation (rows)."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    high = (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(32)).astype(np.uint32)
    found = np.full((BANDS * ROWS, len(sets)), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), _BLOCK):
        part = high[at : at + _BLOCK]
        a, b = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(part))
        least = np.minimum.reduceat((part ^ _XOR) * _TIMES, np.maximum(starts[a:b] - at, 0), axis=1)
        found[:, a:b] = np.minimum(found[:, a:b], least)
    return found


def band_keys(least: np.ndarray) -> np.ndarray:
    """Key of each band (rows) of each text (columns)."""
    bands = least.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * _A
    for r in range(ROWS):
        key = _mixed((key ^ bands[:, r]) * _A)
    return key


def _print(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def _marks(batches):
    """Each document's fingerprint and, if it has words, their hash, its sketch (one byte of each least value) and its bands."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            bits = np.fromiter((simhash.fingerprint(t, 4) for t in texts), np.uint64, len(texts))
            prints, sets = [], []
            for t in texts:
                words = t.lower().split()
                prints.append(_print(words) if words else None)
                if words:
                    sets.append(shingles(words))
            least = least_values(sets)
            sketches, keys = iter(least.T.astype(np.uint8)), iter(band_keys(least).T.copy().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(bits.view(np.int64)), pa.array(prints, pa.binary()), pa.array([p and next(sketches).tobytes() for p in prints], pa.binary()), pa.array([p and next(keys) for p in prints], pa.list_(pa.int64()))],
                names=["doc_id", "h", "bits", "print", "sketch", "bands"],
            )


def _cells(rows: DataFrame, mine, by: str) -> DataFrame:
    """Rows with the number of chunks of `by`, once for each cell of two chunks that holds them."""
    dealt = rows.withColumn("mine", F.pmod(mine, F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("mine", "other", "chunks")
    return dealt.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def _per_cell(of_cell):
    """`of_cell` of each stretch of rows (key, i, j, ...) that share the first three; the rows come sorted by these.

    It takes the key and the lists of the other columns, and gives two lists of longs.
    """

    def run(batches):
        cell, held = None, []

        def done():
            return of_cell(cell[0], [list(c) for c in zip(*held)]) if held else ([], [])

        for batch in batches:
            src, dst = [], []
            for row in (row for k in range(0, batch.num_rows, 256) for row in zip(*(c.slice(k, 256).to_pylist() for c in batch.columns))):
                if row[:3] != cell:  # the last cell may go on in the next batch
                    for out, more in zip((src, dst), done()):
                        out += more
                    cell, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        src, dst = done()
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return lean(run)


def _tree_of(near_of):
    """Pairs of near members that connect what is near in a cell of rows (name, value).

    `near_of` of a cell's values gives a function of one member and the members left that tells which are near.
    """

    def of_cell(_, columns: list) -> tuple[list, list]:
        names, values = columns
        src, dst = [], []
        near, left = near_of(values), np.arange(len(names))
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                member = front.pop()
                found = near(member, left)
                if found.any():
                    src += [names[member]] * int(found.sum())
                    dst += [names[k] for k in left[found]]
                    front.extend(left[found])
                    left = left[~found]
        return src, dst

    return of_cell


def _sketches_near(values: list):
    held = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    return lambda k, left: (held[left] == held[k]).sum(axis=1) >= AGREE


def _sets_near(percent: int):
    def near_of(values: list):
        sizes = np.array([len(v) // 8 for v in values])
        ends = np.cumsum(sizes)
        distinct, flat = np.unique(np.frombuffer(b"".join(values), np.uint64), return_inverse=True)
        mark = np.zeros(len(distinct), bool)

        def near(k, left):
            own = flat[ends[k] - sizes[k] : ends[k]]
            mark[own] = True
            alike = 100 * np.minimum(sizes[left], sizes[k]) >= percent * np.maximum(sizes[left], sizes[k])
            shared = np.array([np.count_nonzero(mark[flat[ends[m] - sizes[m] : ends[m]]]) if ok else 0 for m, ok in zip(left, alike)], np.int64)
            mark[own] = False
            return 100 * shared >= percent * (sizes[left] + sizes[k] - shared)

        return near

    return near_of


def _unresolved(key: int, columns: list) -> tuple[list, list]:
    """The key and the name of each row (name, label, sketch) of a cell that has a candidate of another label there."""
    names, labels, sketches = columns
    labels = np.array(labels)
    if (labels == labels[0]).all():
        return [], []
    near, all_ = _sketches_near(sketches), np.arange(len(names))
    open_ = [n for k, n in enumerate(names) if (near(k, all_) & (labels != labels[k])).any()]
    return [key] * len(open_), open_


def _across(percent: int):
    """Links between the labels of a cell's rows (name, label, sketch, set): one from each member to each other label that it joins."""

    def of_cell(_, columns: list) -> tuple[list, list]:
        names, labels, sketches, sets = columns
        labels, src, dst = np.array(labels), [], []
        near, alike = _sketches_near(sketches), _sets_near(percent)(sets)
        for k in range(len(names) - 1):
            left = np.arange(k + 1, len(names))
            left = left[labels[left] != labels[k]]
            left = left[near(k, left)]
            for m in left[alike(k, left)] if len(left) else ():
                if labels[m] != labels[k]:
                    src.append(names[k])
                    dst.append(names[m])
                    labels[labels == labels[m]] = labels[k]
        return src, dst

    return of_cell


def _verified(percent: int):
    """Of rows (src, dst, set, set) the pairs whose sets are near."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(*(c.to_pylist() for c in batch.columns[2:])):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                alike = 100 * min(len(a), len(b)) >= percent * max(len(a), len(b))
                shared = len(np.intersect1d(a, b, assume_unique=True)) if alike else 0
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


_PAIR = "src long, dst long"


def _met(texts: DataFrame) -> DataFrame:
    """Rows (key, node, chunks) of the texts (node, bands) that meet another in a band."""
    looked = texts.select("node", F.explode("bands").alias("key"))
    counts = looked.groupBy("key").count().where("count > 1")
    chunks = written(counts.select("key", F.ceil(F.col("count") / BAND_CHUNK).cast("long").alias("chunks")))
    return looked.join(chunks.hint("merge"), "key")  # merged at every size, as in simhash


def candidates(texts: DataFrame) -> DataFrame:
    """Pairs (src, dst) of the texts (node, sketch, bands) that connect all candidates."""
    cells = _cells(written(_met(texts)).join(texts.select("node", "sketch"), "node"), F.xxhash64("node"), "key")
    return cells.select("key", "i", "j", "node", "sketch").mapInArrow(_per_cell(_tree_of(_sketches_near)), _PAIR)


def _sets(batches):
    """The shingles of the texts whose words are those that the row names, once for each in one task."""
    seen = set()
    for batch in batches:
        node, group, prints, texts = (batch.column(c) for c in range(4))
        for at in range(0, batch.num_rows, 256):
            rows = []
            for k, g, p, t in zip(*(c.slice(at, 256).to_pylist() for c in (node, group, prints, texts.cast(pa.binary())))):
                words = t.lower().split()
                if p not in seen and _print(words) == p:
                    seen.add(p)
                    found = np.unique(shingles(words))
                    rows.append((k, g, len(found), found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["node", "group", "n", "shingles"])


def _one_each(sets: DataFrame) -> DataFrame:
    """`sets` with one row for each node, though rows of one text may have been read by several tasks."""
    repeated = written(sets.groupBy("node").count().where("count > 1").select("node"))
    if repeated.isEmpty():
        return sets
    once = sets.join(repeated, "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in ("group", "n", "shingles")])
    return written(sets.join(repeated, "node", "left_anti").unionByName(once))


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """`pairs` with the set of one end; a node of very many pairs is sent to several tasks."""
    many = written(pairs.groupBy(end).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")).where("parts > 1"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int")
    dealt = pairs.join(many, end, "left").withColumn("part", part).drop("parts")
    held = sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")).join(many, end, "left")
    return dealt.join(held.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"), [end, "part"]).drop("part")


def _links_of_large(texts: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) of nodes that connect what is near in groups of more than one chunk.

    `sets` has the rows (node, n, shingles) of these groups, `pairs` the candidate pairs.  Pairs are verified in rounds, in each only as
    many as could connect what is not connected yet.
    """
    labels = sets.select("node", F.col("node").alias("label"))
    left, linked = pairs.join(sets.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"), None
    for _ in range(TREES):
        of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))  # noqa: E731, B023
        tree = written(spanning_forest(left.join(of("src", "a"), "src").join(of("dst", "b"), "dst")))
        if tree.isEmpty():
            break
        found = written(_with_sets(_with_sets(tree, sets, "src", "dst"), sets, "dst", "src").select("src", "dst", "src_set", "dst_set").mapInArrow(_verified(percent), _PAIR))
        linked = found if linked is None else linked.unionByName(found)
        joined = connected_components(linked).withColumnRenamed("component", "label")
        labels = written(sets.select("node").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")))
        left = written(left.join(tree, ["src", "dst"], "left_anti"))
    own = written(texts.select("node", "sketch", "bands").join(labels, "node"))
    cells = _cells(_met(own).join(own.select("node", "label", "sketch"), "node"), F.xxhash64("node"), "key")
    open_ = written(cells.select("key", "i", "j", "node", "label", "sketch").mapInArrow(_per_cell(_unresolved), "key long, node long").distinct())
    if open_.isEmpty():
        return open_.selectExpr("key as src", "node as dst") if linked is None else linked
    rows = written(open_.join(sets, "node").join(own.select("node", "label", "sketch"), "node"))
    chunks = written(rows.groupBy("key").agg(F.ceil(F.sum("n") / GROUP_CHUNK).cast("long").alias("chunks")))
    cells = _cells(rows.join(chunks, "key"), F.xxhash64("node"), "key").select("key", "i", "j", "node", "label", "sketch", "shingles")
    across = cells.mapInArrow(_per_cell(_across(percent)), _PAIR)
    return across if linked is None else linked.unionByName(across)


def links(docs: DataFrame, marked: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Links (src, dst) of fingerprints that connect the documents with at least `percent` of their shingles in common."""
    some = marked.where("print is not null").groupBy("print").agg(*[F.first(c).alias(c) for c in ("h", "bits", "sketch", "bands")])
    texts = written(some.withColumn("node", F.xxhash64("print")))
    pairs = written(candidates(texts.select("node", "sketch", "bands")).distinct())
    grouped = written(connected_components(pairs).withColumnRenamed("component", "group"))
    wanted = written(texts.select("node", "h", "print").join(grouped, "node"))
    few = wanted.count() <= BROADCAST_KEYS
    source = docs.select(F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    held = source.join(F.broadcast(wanted) if few else wanted, "h").select("node", "group", "print", "text")
    sets = _one_each(written(held.mapInArrow(lean(_sets), "node long, group long, n long, shingles binary")))
    sizes = written(sets.groupBy("group").agg(F.sum("n").alias("all"), F.count("*").alias("count")))
    small = sizes.where(f"count > 1 and all <= {GROUP_CHUNK}").select("group", F.lit(1).cast("long").alias("chunks"))
    cells = _cells(sets.join(small, "group"), F.lit(0).cast("long"), "group").select("group", "i", "j", "node", "shingles")
    found = cells.mapInArrow(_per_cell(_tree_of(_sets_near(percent))), _PAIR)
    large = sizes.where(F.col("all") > GROUP_CHUNK)
    if not large.isEmpty():
        own = written(sets.join(large.select("group"), "group", "left_semi").select("node", "n", "shingles"))
        found = found.unionByName(_links_of_large(texts, own, pairs, percent))
    bits = lambda name: texts.select(F.col("node").alias(name), F.col("bits").alias(f"{name}_bits"))
    named = written(found).join(bits("src"), "src").join(bits("dst"), "dst")
    return named.select(F.col("src_bits").alias("src"), F.col("dst_bits").alias("dst")).where("src <> dst").distinct()


def _found(docs: DataFrame, doc_id: str, text: str, percent: int, radius: int) -> DataFrame:
    for_python(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    with scope(docs.sparkSession) as lasting:
        marked = written(source.mapInArrow(lean(_marks), f"doc_id {kind}, h long, bits long, print binary, sketch binary, bands array<long>"))
        distinct = simhash.firsts_of(marked)
        linked = simhash.links(distinct, radius).unionByName(links(docs, marked, text, percent))
        return lasting(simhash.rooted(marked, distinct, linked))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, radius: int = 4) -> DataFrame:
    """Rows (doc_id, component_id), one per document."""
    return _found(docs, doc_id, text, percent, radius).select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, radius: int = 4) -> DataFrame:
    """`docs` with one row of each component, as in `simhash`."""
    found = _found(docs, doc_id, text, percent, radius)
    return one_of_each(docs, doc_id, F.xxhash64(F.col(text).cast("string")), simhash.kept_of(found))
