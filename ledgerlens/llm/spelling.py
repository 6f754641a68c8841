"""Grouping of spelling variants: words of a vocabulary that differ by one code point, found by bidirectional FM-index search schemes.

A word is cut in two halves.  Of two words that differ by one inserted, deleted or replaced code point, one half of the
first stands unchanged at that end of the other.  So there are two searches: one matches the left half exactly and then
extends to the right across the other half, allowing one error; the other matches the right half and extends to the
left.  Both walk over intervals of suffix ranks of the delimited vocabulary: the first in the index that is extended to
the right, the second in the one that is extended to the left.  Neither search turns back, so the two indexes' intervals
need not be kept in step; a word is named by its rank among the suffixes that begin with a delimiter.  Each pair is found
once: of several places for the same error one counts, and the second search leaves out what shares the left half.

The vocabulary is dealt by what a search matches exactly: a word stands under its first (last) code points, as many as the
words next to its length look up, and is looked up under its own.  Words of many ends share a cell of about `CELL` words
with an index of its own.  An end that very many words share is dealt into chunks, every one of which is searched by every
chunk of those that look there, in a cell for each two, so no cell holds more than two chunks.  A cell answers with one row
for each word: how many are near, and the best of them.

Defined results: a null or empty text has no words; rows without an id count as those of an empty id; repeated rows count
each; other columns are not read; an empty table gives no rows.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import BROADCAST_KEYS, buckets_for, for_python
from ledgerlens.scratch import scope, written

#: Fixed values of the contract: what a word is, which runs lose a code point.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORN = 97
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Words of one cell, about, and code points of an end under which words are dealt at most.
CELL, DEEPEST = 1 << 15, 4
#: Words that are searched at once, and ranks of an interval up to which its symbols are read one by one.
_AT_ONCE, _NARROW = 1 << 12, 256


def words_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): the runs of letters of all texts, lower-cased in A-Z; one run in 97 by a checksum loses a code point."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    worn = F.concat(F.expr("left(run, at)"), F.expr("substr(run, at + 2)"))
    words = runs.withColumn("h", h).withColumn("at", F.when(F.col("h") % WORN == 0, at)).select(F.when(F.col("at").isNull(), F.col("run")).otherwise(worn).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class SuffixRanks:
    """FM-index of delimited words that matches a word from its first code on.

    The text is a delimiter (0), the last word reversed, a delimiter and so on; a step puts one more code before what was matched.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """`codes` has a row of codes above 0 for each word, of which `lengths` count."""
        n, ends = len(lengths), np.cumsum(lengths + 1)
        size = self.size = int(ends[-1]) + 1 if n else 1
        text = np.zeros(size, np.int64)
        owner = np.repeat(np.arange(n), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[ends[owner] - 1 - within] = codes[owner, within]  # a word's first code stands before the delimiter at its end
        self.alphabet = int(text.max(initial=0)) + 1
        bits = self.alphabet.bit_length()
        rank, span = text, 1
        while 2 * span * bits < 63:  # first by several codes at once, then ranks double
            rank = rank << bits * span | _ahead(rank, span)
            span *= 2
        while True:
            distinct, rank = np.unique(rank, return_inverse=True)
            if len(distinct) == size:
                break
            rank, span = (rank + 1) * (size + 2) + _ahead(rank + 1, span), span * 2
        place = np.empty(size, np.int64)
        place[rank] = np.arange(size)
        self.before = text[place - 1]
        order = np.argsort(self.before, kind="stable")
        self.ranks = self.before[order] * size + order  # ranks by the symbol before them
        first = np.zeros(size, np.int64)
        first[np.concatenate([[0], ends[:-1]])[: max(n, 1)]] = np.arange(max(n, 1))
        self.word = first[place[: n + 1]]  # of the suffixes that begin with a delimiter

    def step(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = code * self.size
        return np.searchsorted(self.ranks, base + low), np.searchsorted(self.ranks, base + high)

    def steps(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All steps of each interval by a code other than the delimiter: (interval, code, low, high), by interval."""
        narrow = high - low <= _NARROW
        at = np.flatnonzero(narrow)
        size = (high - low)[at]
        place = np.repeat(low[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs, count = np.unique(np.repeat(at, size) * self.alphabet + self.before[place], return_counts=True)
        owner, code = np.divmod(pairs, self.alphabet)
        down = np.searchsorted(self.ranks, code * self.size + low[owner])
        wide = np.repeat(np.flatnonzero(~narrow), self.alphabet)
        tried = np.tile(np.arange(self.alphabet), len(wide) // max(self.alphabet, 1))
        below, above = self.step(low[wide], high[wide], tried)
        found = [np.concatenate(x) for x in ((owner, wide), (code, tried), (down, below), (down + count, above))]
        keep = np.flatnonzero((found[1] > 0) & (found[3] > found[2]))
        keep = keep[np.argsort(found[0][keep], kind="stable")]
        return tuple(x[keep] for x in found)


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """Each place's value `by` places on, 0 beyond the end."""
    return np.concatenate([values[by:], np.zeros(min(by, len(values)), values.dtype)])


def _near(index: SuffixRanks, codes: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, indexed word) at one error beyond the first `exact` codes of the row."""
    rows, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(index.word))
    for j in range(int(exact.max(initial=0))):
        on = np.flatnonzero(exact > j)
        low[on], high[on] = index.step(low[on], high[on], codes[on, j])
    live = np.flatnonzero(high > low)
    low, high = low[live], high[live]  # of the rows that match so far without an error
    one = (np.zeros(0, np.int64),) * 3  # row and interval of those with one
    for j in range(int((lengths - exact).max(initial=-1)) + 1):
        at = exact + j  # how many codes of a row are read
        code = lambda row: np.where(at[row] < lengths[row], codes[row, np.minimum(at[row], codes.shape[1] - 1)], 0)  # noqa: E731, B023
        later = lambda row: np.where(at[row] + 1 < lengths[row], codes[row, np.minimum(at[row] + 1, codes.shape[1] - 1)], 0)  # noqa: E731, B023
        own = code(live)
        spans, span = np.unique(low << 32 | high, return_inverse=True)
        owner, tried, below, above = index.steps(spans >> 32, spans & 0xFFFFFFFF)
        first = np.searchsorted(owner, np.arange(len(spans) + 1))
        size = np.diff(first)[span]
        which = np.repeat(np.arange(len(live)), size)
        child = np.repeat(first[span] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        other = np.flatnonzero(tried[child] != own[which])  # the row's own code is no error, and put in before itself it is one after
        which, child = which[other], child[other]
        put = live[which], below[child], above[child]
        # put in: the same place is still to be read, as it is for those with an earlier error
        row, a, b = (np.concatenate(x) for x in zip(one, put))
        need = code(row)
        ready = np.flatnonzero((b - a > 1) | (index.before[a] == need))
        row, (a, b), need = row[ready], index.step(a[ready], b[ready], need[ready]), need[ready]
        met = b > a
        done = met & (need == 0)
        rows.append(row[done])
        words.append(index.word[a[done]])
        gone = met & (need > 0)
        inside = own[which] > 0
        lost = np.flatnonzero((own > 0) & (later(live) != own))  # of a run of one code the last is left out
        one = tuple(np.concatenate(x) for x in zip((row[gone], a[gone], b[gone]), tuple(x[inside] for x in put), (live[lost], low[lost], high[lost])))
        on = own > 0
        live, low, high = live[on], low[on], high[on]
        low, high = index.step(low, high, own[on])
        on = high > low
        live, low, high = live[on], low[on], high[on]
    return np.concatenate(rows), np.concatenate(words)


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words as a matrix with zeros behind them, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    matrix = np.zeros((len(words), int(lengths.max(initial=1))), np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    matrix[owner, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return matrix, lengths


def _reversed(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = lengths[:, None] - 1 - np.arange(matrix.shape[1])
    return np.where(place >= 0, np.take_along_axis(matrix, np.maximum(place, 0), 1), 0)


def near_words(words: list[str], counts: np.ndarray, stands: np.ndarray, asks: np.ndarray, side: int, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that ask and have near words among those that stand here, how many, and the row of the best (-1 if none).

    `words` are in code-point order.  Side 0 matches left halves, side 1 right halves.  The best word has the largest count, at least
    `times` the row's own; of equal ones it is the first.
    """
    matrix, lengths = _coded(words)
    codes = np.searchsorted(np.unique(matrix[matrix > 0]), matrix) + 1
    codes[matrix == 0] = 0
    left = lengths // 2
    facing = codes if side == 0 else _reversed(codes, lengths)
    exact = left if side == 0 else lengths - left
    held, asked = np.flatnonzero(stands), np.flatnonzero(asks)
    index = SuffixRanks(facing[held], lengths[held])
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for k in range(0, len(asked), _AT_ONCE):
        part = asked[k : k + _AT_ONCE]
        row, word = _near(index, facing[part], lengths[part], exact[part])
        row, word = part[row], held[word]
        if side:
            shared = np.ones(len(row), bool)
            for j in range(int(left[part].max(initial=0))):
                shared &= (left[row] <= j) | (codes[row, j] == codes[word, j])
            row, word = row[~shared], word[~shared]
        near += np.bincount(row, minlength=len(words))
        large = counts[word] >= times * counts[row]
        row, word = row[large], word[large]
        order = np.lexsort((word, -counts[word], row))
        firsts = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        best[row[firsts]] = word[firsts]
    found = np.flatnonzero(near)
    return found, near[found], best[found]


def _ends(vocabulary: DataFrame, least_length: int) -> DataFrame:
    """Rows (word, n, side, depth, end, asks): each word under its ends, and whether it looks there itself."""
    depth = lambda m: F.least(F.floor(F.greatest(m, F.lit(least_length)) / 2), F.lit(DEEPEST)).cast("int")
    size = F.char_length("word")
    rows = vocabulary.withColumn("depth", F.explode(F.array_distinct(F.array(depth(size - 1), depth(size), depth(size + 1)))))
    rows = rows.withColumns({"asks": F.col("depth") == depth(size), "side": F.explode(F.array(F.lit(0), F.lit(1)))})
    return rows.withColumn("end", F.when(F.col("side") == 0, F.expr("left(word, depth)")).otherwise(F.expr("right(word, depth)")))


def _cells(vocabulary: DataFrame, least_length: int) -> DataFrame:
    """Rows (side, depth, bin, i, j, word, n, stands, asks), dealt into cells (side, depth, bin, i, j)."""
    rows = written(_ends(vocabulary, least_length))
    bins = buckets_for(rows.count(), 6 * CELL)  # two sides, up to three depths
    many = rows.groupBy("side", "depth", "end").count().where(F.col("count") > CELL // 2)
    many = written(many.select("side", "depth", "end", F.ceil(F.col("count") / CELL).cast("int").alias("chunks")))
    few = many.count() <= BROADCAST_KEYS
    rows = rows.join(F.broadcast(many) if few else many, ["side", "depth", "end"], "left")
    spread = F.pmod(F.xxhash64("end"), F.lit(bins))
    mine = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    cell = lambda i, j, stands, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(stands).alias("stands"), asks.alias("asks"))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    standing = F.transform(others, lambda j: cell(mine, j, True, F.col("asks") & (j == mine)))
    asking = F.transform(F.filter(others, lambda i: F.col("asks") & (i != mine)), lambda i: cell(i, mine, False, F.lit(True)))
    alone = F.array(cell(F.lit(-1), F.lit(-1), True, F.col("asks")))
    cells = F.when(F.col("chunks").isNull(), alone).otherwise(F.concat(standing, asking))
    place = F.when(F.col("chunks").isNull(), spread).otherwise(F.xxhash64("end"))
    return rows.select("side", "depth", place.alias("bin"), "word", "n", F.explode(cells).alias("cell")).select("side", "depth", "bin", "cell.i", "cell.j", "word", "n", "cell.stands", "cell.asks")


def variants(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES) -> DataFrame:
    """Rows (word, n, n_near, form, form_n) of a vocabulary (word, n) of distinct words of at least `least_length` (4 or more) code points.

    `form` is the near word of the largest count, if that is at least `times` the word's own.
    """
    for_python(vocabulary.sparkSession)

    def run(key: tuple, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held["word"]))  # bytes of UTF-8 are in code-point order
        words, counts = held["word"].to_pylist(), held["n"].to_numpy()
        row, near, best = near_words(words, counts, held["stands"].to_numpy(), held["asks"].to_numpy(), key[0].as_py(), times)
        forms = [words[b] if b >= 0 else None for b in best.tolist()]
        sizes = pa.array(counts[best], mask=best < 0)
        return pa.table({"word": pa.array([words[r] for r in row.tolist()], pa.string()), "near": near, "form": pa.array(forms, pa.string()), "form_n": sizes})

    cells = _cells(vocabulary, least_length).groupBy("side", "depth", "bin", "i", "j")
    found = cells.applyInArrow(run, "word string, near long, form string, form_n long")
    best = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form"))
    parts = found.select("word", F.lit(None).cast("long").alias("n"), "near", best.alias("best"))
    whole = vocabulary.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(parts.schema["best"].dataType).alias("best"))
    gathered = whole.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return gathered.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root: where a word's forms lead in the end; the word itself if it has none.  Each round doubles the steps taken."""
    reached = written(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return forms.join(reached, "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root), one for each word of the texts."""
    with scope(docs.sparkSession) as lasting:
        vocabulary = written(words_of(docs, doc_id, text, least_length, least_count))
        return lasting(with_roots(written(variants(vocabulary, least_length, times))))
