"""What is written and dealt more than once, where tables grow."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import facts
from ledgerlens.operators import tables as operators
from ledgerlens.operators.selection import exact_medians
from ledgerlens.operators.store import Snapshots
from ledgerlens.plans import registry
from ledgerlens.scratch import written
from ledgerlens.sources import bucketed, landing
from ledgerlens.sources.adapter import sales_tables
from ledgerlens.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return sales_tables(spark, SF)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sales_do_not_meet_headers_by_document(tables):
    """The adapter's sales are those of the operator, with a join less."""
    of_operator = facts.sales_lines(tables.lines, tables.documents)
    assert of_operator.exceptAll(registry._sales(tables)).isEmpty() and registry._sales(tables).exceptAll(of_operator).isEmpty()
    assert "doc_id" not in "".join(x for x in _plan(registry._sales(tables)).splitlines() if "Join" in x)


def test_repeated_orders(spark, tmp_path):
    """Orders that repeat a key, with different states, give what the operator gives."""
    for name in ("lineitem", "part", "customer", "supplier", "nation"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    some = orders.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 20 == 0, "O").otherwise("F"))
    orders.unionByName(some).write.parquet(str(tmp_path / "orders.parquet"))
    t = sales_tables(spark, str(tmp_path))
    of_operator = facts.sales_lines(t.lines, t.documents)
    assert of_operator.exceptAll(t.sales).isEmpty() and t.sales.exceptAll(of_operator).isEmpty()


def test_pages_by_one_shuffle(tables):
    pages = landing.document_pages(tables.documents, tables.lines)
    found = pages.select(F.explode(F.flatten("documents")).alias("d")).select("d.*")
    whole = landing.nested_documents(tables.documents, tables.lines)
    assert found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()
    assert "Join LeftOuter" not in _plan(pages)


def test_bloom_filters_fit_their_files(spark, tables):
    """A file's filter was 1 MB, whatever the file held."""
    root = tempfile.mkdtemp(prefix="spark-test-")
    store = Snapshots(spark, root, part_rows=1000)
    store.swap(tables.documents, tables.lines.withColumn("item_id", F.col("item_id").cast("string")))
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")]
    assert len(sizes) > 16 and max(sizes) < 200_000


def test_merge_of_repeated_documents(spark, tables):
    """Only ids that come more than once are dealt whole; the latest version of each counts, one without an id too."""
    landed = written(landing.nested_documents(tables.documents, tables.lines).where("document_items is not null").orderBy("id").limit(50))
    again = landed.orderBy("id").limit(5).withColumns({"customer_id": F.lit("C-new"), "modified": F.lit("2030-01-01T00:00:00Z")})
    blank = landed.limit(3).withColumn("id", F.lit(None).cast("string"))
    held = ingest._latest(landed.unionByName(again).unionByName(blank).withColumn("seconds", F.unix_seconds(F.try_to_timestamp("modified"))))
    assert held.count() == 51 and held.where("customer_id = 'C-new'").count() == 5 and held.where("id is null").count() == 1
    single = landed.withColumn("seconds", F.lit(1).cast("long"))
    assert ingest._latest(single) is single


def test_headers_nest_their_lines_by_the_orders_key(spark, tmp_path):
    """The adapter's nested headers are those of the operator, of orders that repeat a key, have no lines or no key too."""
    for name in ("lineitem", "part", "customer", "supplier", "nation"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    key = F.col("o_orderkey")
    again = orders.where(key % 10 == 0).withColumn("o_orderstatus", F.when(key % 20 == 0, "O").when(key % 30 == 0, "F"))
    blank = orders.limit(2).withColumn("o_orderkey", F.lit(None).cast("long"))
    orders.unionByName(again).unionByName(blank).unionByName(again.limit(3).withColumn("o_orderkey", key + 10**9)).write.parquet(str(tmp_path / "orders.parquet"))
    t = sales_tables(spark, str(tmp_path))
    of_operator, found = landing.nested_documents(t.documents, t.lines), landing.as_landed(t.nested)
    assert found.schema == of_operator.schema and found.where("document_items is null").count() >= 10
    assert of_operator.exceptAll(found).isEmpty() and found.exceptAll(of_operator).isEmpty()
    assert "doc_id" not in "".join(x for x in _plan(found).splitlines() if "Join" in x or "Aggregate" in x)


def _landed(spark, start, end, day, customer="c"):
    name = F.concat(F.lit("d"), F.col("id").cast("string"))
    items = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("price")) for i in "12"])
    return spark.range(start, end).select(name.alias("id"), F.lit(5).alias("context_id"), F.col("id").alias("document_number"), F.lit(customer).alias("customer_id"), F.lit("2025-01-02").alias("issue_date"), F.lit(f"2025-01-0{day}T00:00:00Z").alias("modified"), items.alias("document_items"))


def test_stored_rows_are_dealt_once(spark, monkeypatch):
    """Folding joins nothing; a batch of which nothing is stale meets the stored headers and no more; a listing that lasts is not copied."""
    store = Snapshots(spark, tempfile.mkdtemp(prefix="spark-test-"), part_rows=100, fold_share=0.5)
    ingest.merge(store, _landed(spark, 0, 200, 3), now=1)
    joins, copies, join, copy = [], [], type(spark.range(1)).join, ingest.written
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, *a: joins.append(a) or join(self, *a))
    monkeypatch.setattr(ingest, "written", lambda df: copies.append(df.columns) or copy(df))
    ingest.merge(store, _landed(spark, 150, 210, 4, "new"), now=2, lasting_rows=True)
    assert copies == [["_again"]] and len(joins) == 1 and store.manifest().batches
    joins.clear()
    assert Snapshots(spark, store.root, 100, 0.1).fold() and not joins
    held = store.manifest()
    assert {r[0]: r[1] for r in store.read()[0].groupBy("customer_id").count().collect()} == {"c": 150, "new": 60}
    assert store.read()[1].count() == 420 == held.lines and held.documents == 210


def test_stale_documents_leave_their_lines(spark):
    store = Snapshots(spark, tempfile.mkdtemp(prefix="spark-test-"), fold_share=9.0)
    ingest.merge(store, _landed(spark, 0, 20, 3), now=1)
    done = ingest.merge(store, _landed(spark, 10, 15, 2, "old").unionByName(_landed(spark, 15, 30, 4, "new")), now=2)
    assert (done.documents, done.lines) == (20, 40) and store.manifest().batches[0].rows == 45
    assert {r[0]: r[1] for r in store.read()[0].groupBy("customer_id").count().collect()} == {"c": 15, "new": 15}
    assert store.read()[1].count() == 60 == store.manifest().lines
    assert spark.read.parquet(f"{store.root}/{store.manifest().batches[0].folder}/lines").count() == 30


def test_parts_that_do_not_lag_meet_no_batch(spark):
    store = Snapshots(spark, tempfile.mkdtemp(prefix="spark-test-"), part_rows=100, fold_share=0.2)
    ingest.merge(store, _landed(spark, 0, 300, 3), now=1)
    ingest.merge(store, _landed(spark, 0, 100, 4, "new"), now=2)
    held = store.manifest()
    late = [p for p in held.parts if p.version < held.batches[0].version]
    assert 0 < len(late) < len(held.parts)
    for table in store.read():
        plan = _plan(table)
        assert plan.splitlines()[0].startswith("Union") and table.count() in (300, 600)
    assert store.read()[0].where("customer_id = 'new'").count() == 100


def test_medians_of_values_with_wide_and_narrow_ranges(spark):
    rows = spark.createDataFrame([(1, -(2**60)), (1, 5), (1, 2**60), (2, 7), (2, 8), (3, -1), (4, None)], "k int, v long")
    assert {r.k: r["median"] for r in exact_medians(rows, "k", "v").collect()} == {1: 5.0, 2: 7.5, 3: -1.0}
    narrow = rows.where("k in (2, 3)")
    assert {r.k: r["median"] for r in exact_medians(narrow, "k", "v").collect()} == {2: 7.5, 3: -1.0}
    assert exact_medians(rows.where("k = 4"), "k", "v").isEmpty()


def test_lines_are_replaced_where_they_are_dealt(spark, tables):
    """By the document's number the same as by its id; at size the lines are dealt by the order's key alone."""
    some = tables.documents.where("doc_number % 10 = 0 and context_id = 5")
    some = some.unionByName(some.limit(3)).unionByName(some.limit(1).withColumn("doc_id", F.lit(None).cast("string")))
    new = tables.numbered.where("doc_number = 10").limit(1)
    names = ["item_id", "doc_id", "quantity", "price"]  # joins by name put the key first
    by_id, by_number = (operators.replace_lines(tables.numbered, new, some, key).select(names) for key in (None, "doc_number"))
    assert by_id.exceptAll(by_number).isEmpty() and by_number.exceptAll(by_id).isEmpty() and by_id.count() < tables.lines.count()
    unnamed = tables.numbered.withColumn("doc_id", F.when(F.col("item_id") % 5 != 0, F.col("doc_id")))
    for others in (True, False):
        one, other = (operators.lines_of(unnamed, some, key, others).select(names) for key in (None, "doc_number"))
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    bound = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in bound}
    try:
        for k, v in bound.items():
            spark.conf.set(k, v)
        for query in ("replace_lines", "delete_lines"):
            plan = registry.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_buckets_grow_with_the_tables():
    assert [bucketed.buckets_for(n) for n in (0, 300_000, 18_000_000, 108_000_000)] == [8, 8, 72, 432]
