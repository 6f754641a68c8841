"""Clashing names, repeated ids, odd and empty tables; the registered queries' columns, types and contract rows."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import exact, lines, packing, queries, simhash, urllists

PLACES = ("_h", "_host", "_p1", "_page1", "_firsts", "_bad", "_cut", "cut", "host_of", "l1", "dropped_lines", "line", "pos", "page1", "of", "total")


@pytest.mark.parametrize("few", [0, 200_000])
def test_lines_with_clashing_columns_by_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", few)
    rows = [(i, None if i % 5 == 0 else f"h{i % 3}", f"menu\nown {i}\n\nmenu" if i % 4 else ["", "menu", f"own {i}\n", None][i // 4 % 4]) for i in range(120)]
    table = spark.createDataFrame([(*r, *range(len(PLACES))) for r in rows], ", ".join(["doc_id long", "host string", "text string", *(f"{c} int" for c in PLACES)]))
    found = lines.drop_boilerplate(table, "host", "text", 0.3, 3)
    assert found.columns == [*(c for c in table.columns if c != "dropped_lines"), "dropped_lines"]
    want = [(i, t and "\n".join(x for x in t.split("\n") if x != "menu"), t.split("\n").count("menu") if t else 0) for i, _, t in rows]
    assert sorted((r.doc_id, r.text or "", r.dropped_lines) for r in found.collect()) == [(i, t or "", n) for i, t, n in want]


def test_url_lists_with_clashing_columns(spark):
    extra = ("_host", "_at", "_of", "_when", "_verdict", "verdict", "host", "at", "domain", "since", "month", "labels", "listed")
    captures = spark.sql("select id, if(id = 3, null, 'http://a.x.com/') url, if(id = 4, null, timestamp'2024-03-03 00:00:00') fetched from range(6)").select("*", *[F.lit(7).alias(c) for c in extra])
    entries = spark.sql("select 'x.com' domain, timestamp'2024-01-01 00:00:00' since, true listed")
    found = urllists.judge(captures, entries)
    assert found.columns == [*(c for c in captures.columns if c != "listed"), "listed", "list_domain", "list_since"]
    assert sorted((r.id, r.listed, r.list_domain, r._host, r.verdict) for r in found.collect()) == [(i, i not in (3, 4), None if i in (3, 4) else "x.com", 7, 7) for i in range(6)]


def test_packing_with_clashing_columns(spark):
    pieces = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 7 + 1).alias("length"), F.lit("a").alias("offset"), F.lit("b").alias("_bin"), F.lit(9).alias("SEQUENCE_ID"))
    found = packing.pack(pieces, 16)
    assert found.columns == ["doc_id", "start", "length", "_bin", "sequence_id", "offset"]
    rows = found.toPandas()
    assert sorted(rows.doc_id) == list(range(50)) and set(rows._bin) == {"b"} and rows.groupby("sequence_id").length.sum().max() <= 16


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = "one two three four five six seven eight", "quite another text of some words that stands alone"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (None, a, "x"), (None, "nobody else has these five words", "x")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, _sha string, _id int, _of int, _mark int, kept int")
    want = [(0, "nobody else has these five words"), (3, a), (5, b)]
    for kept in (exact.drop_duplicates(docs), simhash.drop_near_duplicates(docs), corpus_pipeline.near_copies(spark, docs, "")):
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == want


def test_names_beyond_many_buckets(spark):
    far = 1 << 43
    names = exact._named(spark.range(20).select(F.col("id").cast("string").alias("block")), ["block"], (far - 1) * exact.BUCKET_ROWS).collect()
    assert len({r.name for r in names}) == 20 and max(r.name for r in names) > 1 << 60
    tight = exact._SPAN
    try:
        exact._SPAN = 2
        with pytest.raises(Exception, match="span of names"):
            exact._named(spark.range(2000).select(F.col("id").cast("string").alias("block")), ["block"], 1).collect()
    finally:
        exact._SPAN = tight


# -- the registered queries --------------------------------------------------------------------------------------

TEXTS = [None, "", " \n ", "same text here", "same  text\there", "word " * 3000, "Ünï <|endoftext|> ok", "a b", "toxic zorgish words", "line one\nline two\nline one"]
SCHEMAS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op12_spelling": "word string, n bigint, n_near bigint, form string, form_n bigint, root string",
    "op13_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with nulls, ties, repeated rows and clashing columns, and the same tables without rows."""
    root = tmp_path_factory.mktemp("edges")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[8]), (None, "no id"), (None, TEXTS[3])] + [(100 + i, f"plain words number {i} of many" + " zorgish blaxy" * (i % 3 == 0)) for i in range(60)]
    made = {
        "documents": spark.createDataFrame([(i, t, None if i == 4 else "en", "s", 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, score int, offset int"),
        "labels": spark.createDataFrame([(i, 1, int(i % 3 == 1)) for i, _ in rows if i and i >= 100] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame([(i, [1.0, i / 9, 0.5]) for i in range(5)] + [(7, None), (8, [0.0] * 3), (None, [1.0, 0.0, 0.5])], "vec_id long, embedding array<double>"),
        "benchmark": spark.createDataFrame([(0, "plain words"), (0, "toxic"), (1, None), (2, ""), (None, "line")], "item_id long, text string"),
        "pages": spark.createDataFrame([(i, f"http://h{i % 4}.example.net/{i}", "<p>" * i) for i in range(40)] + [(None, None, None)], "page_id long, url string, html string"),
    }
    for name, table in made.items():
        table.write.parquet(str(root / "full" / f"{name}.parquet"))
        table.limit(0).write.parquet(str(root / "none" / f"{name}.parquet"))
    return root, rows


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, tables, name):
    root, rows = tables
    found = queries.queries()[name](spark, str(root / "full"))
    if name in SCHEMAS:
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == SCHEMAS[name]
    got = found.toPandas()
    assert queries.queries()[name](spark, str(root / "none")).count() == 0
    texts = sorted((t or "") for _, t in rows)
    if name == "op1_bpe":
        library = Tokenizer.from_file(queries.public_tokenizers.path(queries.VOCABULARY))
        ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sorted(got.ids_sha256) == sorted(hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids)
        assert sorted(got.decoded_sha256) == sorted(hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest() for i in ids)
        assert sorted(got.n_tokens) == sorted(map(len, ids))
    elif name == "op2_toxicity":
        assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
        known = got.dropna(subset=["doc_id"])
        assert [bool(h) for h in known.held_out] == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in known.doc_id]
    elif name == "op7_sharding":
        assert sorted(got.text_crc32) == sorted(zlib.crc32(t.encode()) for t in texts) and sorted(got["size"]) == sorted(len(t.encode()) + 1 for t in texts)
        assert all(sorted(part.slot) == list(range(len(part))) for _, part in got.groupby("shard")) and got.shard.between(0, 15).all()
    elif name == "op8_packing":
        assert sorted(got.groupby("doc_tokens").length.sum().index) == sorted(set(got.doc_tokens)) and (got.length > 0).all()
        assert all(part.sort_values("offset").offset.tolist() == [0, *np.cumsum(part.sort_values("offset").length)[:-1]] for _, part in got.groupby("sequence_id"))
    elif name == "op9_simhash":
        assert len(got) == len(rows) and (got[got.doc_id.isin([0, 1, 2])].fingerprint == "0" * 16).all() and (got[got.doc_id.isin([0, 1, 2])].component_id == 0).all()
        assert got[got.doc_id == 7].fingerprint.tolist() == [f"{xxhash.xxh64_intdigest(b'a b', 42):016x}"]
    elif name == "op10_exact_dedup":
        assert len(got) == len(rows) and got.kept.sum() == len({" ".join(f".{t}.".split())[1:-1] for t in texts})
    elif name == "op11_quality":
        assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
        known = got.dropna(subset=["doc_id"])
        assert [bool(h) for h in known.held_out] == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in known.doc_id]
    elif name == "op12_spelling":
        assert set(got.word) >= {"plain", "words", "number", "zorgish", "blaxy"} and got.n[got.word == "plain"].item() >= 59 and (got.n >= 3).all()
    elif name == "op13_search":
        assert set(got.item_id.dropna()) == {0} and got[got.item_id.isna()].doc_id.tolist() == [9] and len(got[got.item_id == 0]) == 50
    elif name == "op6_embedding_dedup":
        assert len(got) == 8 and got[got.vec_id.isin([7, 8])].n_links.tolist() == [0, 0] and got[got.vec_id == 0].component_id.tolist() == [0]


def test_pipeline_on_odd_and_empty_tables(spark, tables):
    root, rows = tables
    got = corpus_pipeline.run(spark, str(root / "full"))
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(got.columns)
    for row in got.collect():
        assert len(row.ids) == 4 * row.length and zlib.crc32(row.ids) == row.ids_crc32
    assert corpus_pipeline.run(spark, str(root / "none")).count() == 0
