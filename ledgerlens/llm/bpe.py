"""Byte-pair encoding and decoding of whole texts.

Encoding is the backtracking form of BPE.  An Aho-Corasick pass marks the longest vocabulary token that
begins at each position of a word; the encoder walks the word taking those tokens, and before it keeps
one it looks the pair (previous token, this token) up in a pair-compatibility table: a pair is compatible
if merging the text of both from scratch gives back exactly these two tokens.  Where a pair clashes, the
next shorter token that begins there is tried, and where none is left the encoder steps back one token and
marks the position as dead, so every position is abandoned at most once and the walk is linear.  The result
equals that of applying the merges in order of rank.

Decoding concatenates slices of one byte table of all token texts, addressed by an offset table.

Defined results: a null text counts as the empty text and has no ids; texts are never truncated; special
tokens that stand in a text become their ids, as the tokenizers library does by default; rows that repeat
are each encoded; other columns pass through untouched, and the added columns replace columns of the same
name.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.shared import for_python, lean

#: The split of the word tokenizer, with `\s` spelt out as the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+|\n")
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+|\n")
_END = "</w>"

#: Longer words are encoded each time they occur, so that the cache holds small entries only.
CACHED_BYTES = 64
#: The cache of words drops its older half when its newer half holds this many entries.
CACHE_ENTRIES = 1 << 18


class HalfCache:
    """A bounded dict in two generations: entries that are not asked for while one generation fills are dropped."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.new, self.old = entries, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}
        self.new[key] = value


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _repeated(table: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a table in this order, as one array, and the bounds of each in it."""
    ends = np.zeros(len(order) + 1, np.int64)
    np.cumsum(size[order], out=ends[1:])
    return table[np.arange(ends[-1]) + np.repeat(start[order] - ends[:-1], size[order])], ends


def _gathered(packed: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_repeated`, from packed ids."""
    size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
    return _repeated(np.frombuffer(b"".join(packed), np.uint32), np.cumsum(size) - size, size, order)


class TokenTable:
    """Decoder: the texts of all tokens, each followed by a space, in one table of bytes with the offset of every id."""

    def __init__(self, text_of: dict[int, str]):
        texts = [(text_of.get(i, "") + " ").encode() for i in range(max(text_of) + 1)]
        self._offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self._offsets[1:])
        self._table = np.frombuffer(b"".join(texts), np.uint8)

    @classmethod
    def of(cls, definition: str) -> TokenTable:
        spec = json.loads(definition)
        return cls({i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]})

    def decode(self, packed: bytes, block: int = 1 << 16) -> bytes:
        """Text (UTF-8) of packed ids: the tokens joined by one space."""
        ids = np.frombuffer(packed, "<u4")
        out = []
        for i in range(0, len(ids), block):
            part = ids[i : i + block]
            start = self._offsets[part]
            size = self._offsets[part + 1] - start
            place = np.cumsum(size) - size
            out.append(self._table[np.arange(int(size.sum())) + np.repeat(start - place, size)].tobytes())
        return b"".join(out)[:-1]


class WordBpe:
    """Encoder and decoder of a tokenizers file of kind BPE with an end-of-word suffix.

    `definition` is the text of the JSON file.  Symbols are kept as Python strings in which one private
    character stands for the end-of-word suffix.
    """

    _MARK = ""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if suffix != _END:
            raise ValueError(f"not a vocabulary with the word end {_END}: {suffix!r}")
        self._text_of = {i: t for t, i in model["vocab"].items()}
        self._id_of = {self._marked(t): i for t, i in model["vocab"].items()}
        self._rank = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._rank.setdefault((self._marked(left), self._marked(right)), rank)
        self._symbol_of = {i: s for s, i in self._id_of.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_packed = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._text_of |= {i: t for t, i in special.items()}
        self._alphabet = byte_alphabet()
        self._size_of = {i: len(s) for s, i in self._id_of.items()}
        self._single = {s: i for s, i in self._id_of.items() if len(s) == 1}
        self._tokens = ahocorasick.Automaton()
        for symbol, i in self._id_of.items():
            if len(symbol) > 1:
                self._tokens.add_word(symbol, (len(symbol) - 1, i))
        self._tokens.make_automaton()
        self._split: dict[int, tuple[int, int, int]] = {}
        for (left, right), rank in self._rank.items():
            whole = self._id_of[left + right]
            if whole not in self._split or rank < self._split[whole][2]:
                self._split[whole] = (self._id_of[left], self._id_of[right], rank)
        self._pair_rank = {(self._id_of[a], self._id_of[b]): r for (a, b), r in self._rank.items()}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list] = {}
        self._shorter: dict[int, int] = {}
        self._words = HalfCache()

    def _marked(self, token: str) -> str:
        return token[: -len(_END)] + self._MARK if token.endswith(_END) else token

    # -- the tables, filled as entries are asked for --------------------------------------------------------

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied one at a time in order of rank; used on vocabulary tokens only."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self._rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self._rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def atoms(self, symbol: str) -> list[str]:
        if symbol.endswith(self._MARK):
            return [*symbol[:-2], symbol[-2:]]
        return list(symbol)

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at one edge of a token while it is merged: (symbol, rank that makes it, rank that ends it)."""
        known = self._edges.get((token, side))
        if known is None:
            known, ends = [], 1 << 60
            part = token
            while True:
                made = self._split.get(part)
                known.append((part, made[2] if made else -1, ends))
                if not made:
                    break
                part, ends = made[side], made[2]
            self._edges[token, side] = known
        return known

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two neighbours comes before the merges that make them.

        At each rank one symbol of the left token's right edge meets one of the right token's left edge.
        A merge of those two takes place if both exist at its rank; where the merge that ends the left
        symbol has the same rank it stands further left and goes first.
        """
        ranks = self._pair_rank
        for a, a_made, a_ends in self._edge(left, 1):
            for b, b_made, b_ends in self._edge(right, 0):
                if a_made < b_ends and b_made < a_ends and (rank := ranks.get((a, b))) is not None and a_made < rank < a_ends and b_made < rank <= b_ends:
                    return False
        return True

    def _fits(self, left: int, right: int) -> bool:
        """The entry of the pair-compatibility table; left is -1 at the start of a word."""
        if left < 0:
            symbol = self._symbol_of[right]
            fits = self.merged(self.atoms(symbol)) == [symbol]
        else:
            fits = self.pair_fits(left, right)
        self._compatible[left, right] = fits
        return fits

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self._shorter.get(token)
        if known is None:
            symbol = self._symbol_of[token]
            known = next((self._id_of[symbol[:n]] for n in range(len(symbol) - 1, 0, -1) if symbol[:n] in self._id_of), -1)
            self._shorter[token] = known
        return known

    # -- encoding ------------------------------------------------------------------------------------------

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of byte characters."""
        text = word + self._MARK
        n = len(text)
        longest = [*map(self._single.get, word), None]
        for end, (reach, token) in self._tokens.iter(text):
            longest[end - reach] = token  # ends ascend: the last one set is the longest
        compatible, size_of, shorter = self._compatible, self._size_of, self._shorter
        out: list[int] = []
        dead = None
        at, last, token = 0, -1, longest[0]
        while True:
            if token is None or token < 0:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of this word")
                if dead is None:
                    dead = bytearray(n + 1)
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= size_of[token]
            else:
                end = at + size_of[token]
                if dead is None or not dead[end]:
                    fits = compatible.get((last, token))
                    if fits or fits is None and self._fits(last, token):
                        out.append(token)
                        if end == n:
                            return out
                        at, last, token = end, token, longest[end]
                        continue
            short = shorter.get(token)
            token = self._next_shorter(token) if short is None else short

    def _encode_piece(self, piece: str) -> bytes:
        packed = b"" if piece == "\n" else self._words.get(piece)
        if packed is None:
            # printable ASCII stands for itself
            ids = self.encode_word(piece if piece.isascii() and piece.isprintable() else "".join([self._alphabet[x] for x in piece.encode()]))
            packed = array("I", ids).tobytes()
            if len(piece) <= CACHED_BYTES:
                self._words.put(piece, packed)
        return packed

    def _pieces(self, text: str, ascii_only: bool) -> list[str]:
        """The pieces of a text, line ends among them as pieces of their own."""
        if ascii_only:
            return _ASCII_PIECE.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by character: no final sigma
        return _PIECE.findall(text.lower())

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of one chunk in which special tokens may stand."""
        parts = self._special_split.split(chunk) if self._special_split else [chunk]
        return b"".join([self._special_packed[p] if p in self._special_packed else b"".join(map(self._encode_piece, self._pieces(p, False))) for p in parts])

    def _encode_lines(self, chunks: pa.Array, ascii_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk the start and number of its ids, and all ids.  The chunks are split as one text of lines."""
        pieces = pa.array(self._pieces(pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n")[0].as_py() + "\n", ascii_only), pa.string()).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        packed = list(map(self._words.new.get, words))
        for i in [i for i, held in enumerate(packed) if held is None]:
            packed[i] = self._encode_piece(words[i])
        order = pieces.indices.to_numpy(zero_copy_only=False)
        ids, ends = _gathered(packed, order)
        ends = ends[np.flatnonzero(order == packed.index(b"")) + 1]
        start = np.concatenate([[0], ends[:-1]])
        return start, ends - start, ids

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `_encode_lines`, for chunks of any kind."""
        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        special = pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(chunks).to_numpy(zero_copy_only=False)
        tables, held = [np.zeros(0, np.uint32)], 0
        for rows, ascii_only in ((~special & plain, True), (~special & ~plain, False)):
            if rows.any():
                start[rows], size[rows], ids = self._encode_lines(chunks.filter(pa.array(rows)), ascii_only)
                start[rows] += held
                tables.append(ids)
                held += len(ids)
        for i in np.flatnonzero(special):
            ids = np.frombuffer(self._encode_chunk(chunks[i].as_py()), np.uint32)
            start[i], size[i] = held, len(ids)
            tables.append(ids)
            held += len(ids)
        return start, size, np.concatenate(tables)

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Packed ids (little-endian unsigned 32-bit) of a column of whole texts; null counts as empty.

        No piece of the tokenizer's split spans ASCII white space, so each stretch between such spaces is
        encoded by itself, and each distinct stretch of the column once.
        """
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        start, size, table = self._encode_chunks(words.dictionary)
        order = words.indices.to_numpy(zero_copy_only=False)
        ids, ends = _repeated(table, start, size, order)
        bounds = lists.offsets.to_numpy()
        offsets = ends[bounds - bounds[0]] * 4
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())

    def encode(self, text: str | None) -> list[int]:
        """Ids of one whole text."""
        return np.frombuffer(self.encode_column(pa.array([text], pa.string()))[0].as_py(), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        return TokenTable(self._text_of).decode(packed)


_LOADED: dict[tuple, object] = {}


def loaded(make, definition: str):
    """`make(definition)`, built once in each Python worker."""
    key = make, hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make(definition)
    return _LOADED[key]


def read_definition(path: str) -> str:
    """The text of a vocabulary file, read on the driver; it is a fixed file of a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _slices(column: pa.Array, limit: int = 1 << 22):
    """Stretches of a column of about `limit` bytes each; a longer text is a stretch of its own."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = (np.cumsum(size) - size) // limit
    starts = np.flatnonzero(np.diff(cut, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(column)]):
        yield column.slice(i, j - i)


def _mapped(df: DataFrame, source: str, added: list[tuple[str, T.DataType]], make) -> DataFrame:
    """`df` with columns made from batches of one column; other columns pass through as Arrow arrays."""
    names = {n for n, _ in added}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        step = make()
        for batch in batches:
            made = step(batch.column(batch.schema.get_field_index(source)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + made, names=[*kept, *(n for n, _ in added)])

    return df.mapInArrow(lean(run), schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`: the packed ids (little-endian unsigned 32-bit) of each whole text.  Null: no ids."""
    for_python(docs.sparkSession)
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(path))

    def make():
        bpe = loaded(WordBpe, definition.value)
        return lambda column: [pa.concat_arrays([bpe.encode_column(part) for part in _slices(column)] or [pa.array([], pa.binary())])]

    return _mapped(docs, text, [(ids, T.BinaryType())], make)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds `text`: the decoded text of packed ids.  Null: the empty text."""
    for_python(encoded.sparkSession)
    definition = encoded.sparkSession.sparkContext.broadcast(read_definition(path))

    def make():
        table = loaded(TokenTable.of, definition.value)
        return lambda column: [pa.array((table.decode(p.as_py() or b"") for p in column), pa.binary()).cast(pa.string())]

    return _mapped(encoded, ids, [(text, T.StringType())], make)
