"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and numbered, so equal
blocks have equal names and different blocks different ones.  Then adjacent names of a document are
paired, the distinct pairs are sorted and numbered in turn, and so on until one name is left: documents of the
same number of blocks have the same last name if and only if their texts are equal.

Numbers are given within hash buckets (the rank in the sorted bucket, shifted past the bucket's number), so no
task sorts more than a bucket.  Blocks travel once, as distinct values after map-side combining; the rows of
documents refer to them by a 128-bit hash, and the hash is first shown to separate the blocks at hand: if it
does not, it is drawn anew with other seeds.  All of it is DataFrame operations.

Defined results: a null text counts as the empty text; every row has its own result, repeated rows included;
of equal texts the row with the smallest document id stays, rows without an id come last, and of rows that tie
one stays; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import buckets_for, one_of_each
from ledgerlens.scratch import scope, written

#: Runs of these count as one space.
SPACES = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1024
#: Distinct values that one bucket is to sort.
BUCKET_ROWS = 8192
#: Names of a bucket are numbered from its number times this; a bucket that holds more, which hashing all but rules
#: out, is an error.  So a long takes 2^43 buckets, 10^17 distinct values.
_SPAN = 1 << 20


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def _named(distinct: DataFrame, by: list[str], rows: int) -> DataFrame:
    """`distinct` with the column name: its number among the sorted values of its bucket."""
    n = buckets_for(rows, BUCKET_ROWS, 64)
    bucketed = distinct.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(n)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*by))
    within = F.when(F.col("rank") < _SPAN, F.col("rank")).otherwise(F.raise_error(F.lit("a bucket holds more values than its span of names")))
    return bucketed.withColumn("rank", rank).withColumn("name", F.col("bucket") * F.lit(_SPAN).cast("long") + within).drop("bucket", "rank")


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """Rows of `docs` (with the column norm) by block: pos and block are added, norm stays."""
    cut = docs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / size)).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pos"))
    return cut.withColumn("block", F.substring(F.col("norm").cast("binary"), F.col("pos") * size + 1, F.lit(size)))


def _hash(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "block").alias("h1"), F.xxhash64(F.lit(~seed), "block").alias("h2")]


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (row, doc_id, text_sha256, blocks, name), one per row of `docs`: (blocks, name) is the identity of its text."""
    read = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    seed = 0
    while True:
        held = _blocks(read.withColumn("row", F.monotonically_increasing_id()), block_bytes)
        digest = F.when(F.col("pos") == 0, F.sha2(F.col("norm").cast("binary"), 256))
        level = written(held.select("row", "doc_id", "blocks", "pos", *_hash(seed), digest.alias("text_sha256")))
        distinct = _blocks(read, block_bytes).select(*_hash(seed), "block").distinct()
        names = written(_named(distinct, ["block"], level.count()).select("h1", "h2", "name"))
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        seed += 1
    rows = level.where("pos = 0").select("row", "doc_id", "text_sha256", "blocks")
    level = written(level.select("row", "pos", "blocks", "h1", "h2").join(names, ["h1", "h2"]).select("row", "pos", "blocks", "name"))
    whole = level.where("blocks = 1").select("row", "name")
    live = level.where("blocks > 1").select("row", "pos", F.col("blocks").alias("left"), "name")
    while not live.isEmpty():
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = live.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"), F.first("left").alias("left"))
        pairs = written(pairs.select("row", F.col("half").alias("pos"), "l", "r", F.ceil(F.col("left") / 2).cast("int").alias("left")))
        names = _named(pairs.select("l", "r").distinct(), ["l", "r"], pairs.count())
        level = written(pairs.join(names, ["l", "r"]).select("row", "pos", "left", "name"))
        whole = whole.unionByName(level.where("left = 1").select("row", "name"))
        live = level.where("left > 1")
    return rows.join(whole, "row")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per row of `docs`."""
    with scope(docs.sparkSession) as lasting:
        named = lasting(identities(docs, doc_id, text, block_bytes))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = named.groupBy("blocks", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    same = named.join(written(kept), ["blocks", "name"])  # both sides are scans: a large group is split by the join
    return same.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts.

    Document ids tell rows apart; rows that repeat both id and text go down to one, rows without an id
    stay only if no row with an id has their text.
    """
    found = groups(docs, doc_id, text).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("mark"), "kept")
    return one_of_each(docs, doc_id, F.unhex(F.sha2(normalised(text).cast("binary"), 256)), found)
