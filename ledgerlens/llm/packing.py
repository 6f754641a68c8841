"""Packing of tokenised documents into windows of a fixed number of tokens by best-fit decreasing.

A document longer than a window is first cut into full windows and a rest.  Rests and short documents are
then placed, longest first, in the open window with the least room that still holds them, found in a segment
tree indexed by remaining capacity.  Documents are dealt by hash into bins of some thousand pieces that are
packed independently; a bin this large leaves little padding, and its packing depends on its rows alone, so a
repeated task gives the same windows.  Of rows that are alike in all that orders them, where there are very many, each is
dealt by itself, so no bin outgrows its size.  Only what orders pieces goes into the bins if ids, texts or the like are
carried along; these join the places by a number given to each stored piece.

Defined results: a null text counts as empty and has the end token only; whole texts are packed, no
token is dropped or repeated; repeated rows are packed each; columns beside those named are carried along; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.bpe import WordBpe, _slices, loaded, read_definition
from ledgerlens.llm.shared import buckets_for, for_python, lean, unused
from ledgerlens.scratch import written

#: Pieces that one bin is to hold.
BIN_PIECES = 8192


class RoomTree:
    """Open windows by remaining capacity: the leaf of each capacity holds a stack of windows, inner nodes count them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A window with the smallest room of at least `least`, which is removed; None if there is none."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; `lengths` descend and none exceeds `window`."""
    tree = RoomTree(window)
    at, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found = window, opened
            opened += 1
        room, number = found
        at[i], offset[i] = number, window - room
        if room > n:
            tree.put(room - n, number)
    return at, offset


def tokenised_pieces(docs: DataFrame, path: str, window: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids): each document's ids and `end_id`, cut into windows and a rest.

    `ids` is packed as little-endian unsigned 32-bit integers.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    for_python(docs.sparkSession)
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        bpe = loaded(WordBpe, definition.value)
        for batch in batches:
            done = 0
            for part in _slices(batch.column(1)):
                whole = [ids + end for ids in bpe.encode_column(part).to_pylist()]
                tokens = np.fromiter(map(len, whole), np.int64, len(whole)) >> 2
                pieces = -(-tokens // window)
                row = np.repeat(np.arange(len(whole)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, tokens[row] - start)
                ids = [whole[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
                key = batch.column(0).slice(done, len(whole)).take(pa.array(row))
                done += len(whole)
                yield pa.RecordBatch.from_arrays([key, pa.array(start), pa.array(length), pa.array(tokens[row]), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return source.mapInArrow(lean(run), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


#: Values of these types are a few bytes each.
SMALL = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def pack(pieces: DataFrame, window: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """`pieces` with sequence_id and offset, which replace columns of these names.

    Pieces are at least 1 and at most `window` long; `order` breaks ties of length.
    """
    for_python(pieces.sparkSession)
    own = pieces.drop("sequence_id", "offset")
    name, key, again, row = unused(own.columns, "_bin", "_key", "_again", "_row")
    needed = dict.fromkeys([length, *order])
    # a bin of ids or texts is tens of MB, held several times over in Arrow by its task and worker: such columns stay out of the bins
    apart = any(not isinstance(f.dataType, SMALL) for f in own.schema if f.name not in needed)
    table = written(own.withColumn(row, F.monotonically_increasing_id()) if apart else own)
    placed = _placed(table.select(row, *needed) if apart else table, window, length, order, (name, key, again))
    if not apart:
        return placed
    return table.join(written(placed.select(row, "sequence_id", "offset")), row).drop(row)


def _placed(table: DataFrame, window: int, length: str, order: tuple[str, ...], names: tuple[str, str, str]) -> DataFrame:
    """A stored table of pieces with sequence_id and offset; `names` are of no column of it."""
    bins = buckets_for(table.count(), BIN_PIECES)
    schema = T.StructType([*table.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    name, key, again = names

    def run(key: tuple, held: pa.Table) -> pa.Table:
        held = held.drop_columns(name)
        # only what orders the pieces is sorted; what they carry along is taken once
        held = held.take(pc.sort_indices(held.select([length, *order]), [(length, "descending"), *((c, "ascending") for c in order)]))
        at, offset = best_fit_decreasing(held[length].to_numpy(), window)
        return held.append_column("sequence_id", pa.array((key[0].as_py() << 32) + at)).append_column("offset", pa.array(offset))

    mark = F.xxhash64(*order)
    many = written(table.groupBy(mark.alias(key)).count().where(F.col("count") > BIN_PIECES // 8).select(key))
    if many.isEmpty():
        dealt = table.withColumn(name, F.pmod(mark, F.lit(bins)))
    else:  # rows alike by the thousand are dealt by their place in the stored table too, which a repeated task finds again
        hot = table.withColumn(key, mark).join(many.withColumn(again, F.lit(True)), key, "left")
        spread = F.when(F.col(again), F.xxhash64(key, F.monotonically_increasing_id())).otherwise(F.col(key))
        dealt = hot.withColumn(name, F.pmod(spread, F.lit(bins))).drop(key, again)
    return dealt.groupBy(name).applyInArrow(run, schema)
