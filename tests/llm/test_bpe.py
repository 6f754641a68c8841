"""BPE against the tokenizers library and by round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Letters, marks, spaces and special tokens that are easily split or folded wrongly.
ALPHABET = [*"abcdefghij the ing er'stmdvrel0123 \t\n\x0b\x0c\x1c\x1f\x85!?.,;:-_<>/|w", "</w>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "ς", "é", "é", "ß", "東", "🎉", "̈", "ﬁ", "½", "Ⅷ", "\x00", "가", "K", "　", "\xa0"]


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(bpe.read_definition(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(count, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 50))) for _ in range(count)]


def test_ids_and_text_equal_the_library(own, library):
    for text in texts(4000):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(np.array(want, "<u4").tobytes()).decode() == library.decode(want, skip_special_tokens=False)


def test_long_word_is_exact(own, library):
    text = "a" * 20000 + "ing" * 5000 + "thethe" * 2000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pair_table_equals_merging_from_scratch(own):
    pick = random.Random(2)
    symbols = [s for s in own._symbol_of.values() if len(s) > 1]
    for _ in range(20000):
        whole = pick.choice(symbols)
        cut = pick.randint(1, len(whole) - 1)
        a, b = own._id_of.get(whole[:cut]), own._id_of.get(whole[cut:])
        if a is None or b is None:
            a, b = own._id_of[pick.choice(symbols)], own._id_of[pick.choice(symbols)]
        a_text, b_text = own._symbol_of[a], own._symbol_of[b]
        if not a_text.endswith(own._MARK):
            assert own.pair_fits(a, b) == (own.merged(own.atoms(a_text) + own.atoms(b_text)) == [a_text, b_text])


def test_cache_drops_old_entries_and_results_stay(own, library):
    small = bpe.WordBpe(bpe.read_definition(PATH))
    small._words = bpe.HalfCache(3)
    for text in texts(300, 3):
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(small._words.new) + len(small._words.old) <= 6


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "Hello  World!", "x"), (2, None, "y"), (2, None, "y"), (None, "", None), (3, "it's 2021 <|endoftext|> ok", "z"), (4, "word " * 40000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(done) == len(rows)
    for row in done:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
