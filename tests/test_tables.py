"""Maintenance of tables, landing, validation and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas, scratch
from ledgerlens.functions.text import int_list, periods_of, safe_name
from ledgerlens.operators import facts, lookups, tables, validate
from ledgerlens.operators.store import Snapshots
from ledgerlens.plans import oracle, registry
from ledgerlens.sources import bucketed, landing
from ledgerlens.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_upsert_keeps_the_newer_row_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "doc_id string, v int, modified long")
    new = spark.createDataFrame([("b", 2, 11), ("b", 3, 12), ("a", 9, 5), ("c", 4, 1)], "doc_id string, v int, modified long")
    once = tables.upsert(old, new)
    assert rows(once, "doc_id", "v") == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(tables.upsert(once, new), "doc_id", "v") == rows(once, "doc_id", "v")


def test_lines_are_replaced_appended_and_deleted(spark):
    held = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_id string, item_id long")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    new = spark.createDataFrame([("a", 7)], "doc_id string, item_id long")
    assert rows(tables.replace_lines(held, new, new), "doc_id", "item_id") == [("a", 7), ("b", 3)]
    assert tables.append_lines(held, held.limit(0)).count() == 3
    assert rows(tables.delete_lines(held, new), "doc_id") == [("b",)]
    left, lines = tables.delete_documents(docs, held, new)
    assert rows(left, "doc_id") == [("b",)] and lines.count() == 1


def test_changes_apply_field_by_field(spark):
    held = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id long, name string, price double")
    feed = spark.createDataFrame(
        [("update", 1, 1, "x", None), ("update", 2, 1, None, 9.0), ("delete", 3, 2, None, None), ("create", 1, 4, "n", None), ("update", 1, 5, "ghost", None), ("delete", 1, 3, None, None), ("create", 2, 3, "back", None)],
        "op string, seq int, id long, name string, price double",
    )
    assert rows(tables.apply_changes(held, feed), "id", "name", "price") == [(1, "x", 9.0), (3, "back", None), (4, "n", None)]


def test_backfill_takes_details_where_lines_are_missing(spark):
    kind = "id string, document_items array<int>"
    listed = spark.createDataFrame([("a", None), ("b", []), ("c", [1])], kind)
    details = spark.createDataFrame([("a", [5]), ("b", [6, 7]), ("c", [8])], kind)
    assert {r.id: r.document_items for r in tables.backfill_lines(listed, details).collect()} == {"a": [5], "b": [6, 7], "c": [1]}


@pytest.mark.parametrize("last, stale", [(None, True), (100, False), (99, True)])
def test_freshness_is_strict(spark, last, stale):
    state = spark.createDataFrame([(last,)], "lastSync long")
    assert tables.freshness(state, 3700, 3600).first().stale is stale
    with pytest.raises(ValueError):
        tables.freshness(state, 0, -1)


def test_state_round_trip(spark):
    docs = spark.range(3)
    state = tables.sync_state(docs, spark.range(5), "main", 1000, True)
    assert json.loads(state.first().json)["documentCount"] == 3
    assert tables.read_state(state).first().itemDocumentCount == 5
    assert tables.table_status(state, 9999).first().status == "STALE"


LANDED = [
    {"id": "d1", "context_id": 5, "document_number": 1, "customer_id": "c", "issue_date": "2025-01-02T10:00:00Z", "modified": "2025-01-03T00:00:00Z", "document_items": [{"item_id": "1", "quantity": 2, "price": 3.5}, {"item_id": "", "quantity": 1, "price": 1}, {"quantity": 1, "price": 1}]},
    {"id": "d2", "context_id": 5, "document_number": 2, "customer_id": "c", "issue_date": None, "modified": "2025-01-03T00:00:00Z", "document_items": [{"item_id": "1", "quantity": 1, "price": 1}]},
    {"id": "d3", "context_id": 7, "document_number": 3, "customer_id": "c", "issue_date": "2025-01-02", "modified": "2025-01-03T00:00:00Z", "document_items": []},
    {"id": "d4", "context_id": 4, "document_number": 4, "customer_id": "c", "issue_date": "2025-01-02", "modified": "2025-01-03T00:00:00Z"},
    {"id": "d1", "context_id": 5, "document_number": 1, "customer_id": "new", "issue_date": "2025-01-02", "modified": "2025-01-04T00:00:00Z", "document_items": [{"item_id": "2", "quantity": 9, "price": 1}]},
]


def land(tmp_path, name="pages"):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"count": 5, "page": 1, "pages": "2", "documents": [LANDED[:3], LANDED[3:]]}) + "\n")
    (folder / "2.json").write_text(json.dumps({"count": 5, "page": 2, "pages": "2", "documents": []}) + "\n")
    return str(folder)


def test_landed_pages_are_flattened_and_checked(spark, tmp_path):
    docs = landing.read_documents(spark, land(tmp_path))
    assert docs.count() == 5
    valid, refused = validate.split(docs, validate.document_reason())
    assert rows(refused, "id", "reason") == [("d2", "issue_date is required"), ("d3", "context_id is not valid"), ("d4", "at least one line is required")]
    assert rows(validate.flatten_lines(valid), "item_id", "doc_id") == [("1", "d1"), ("2", "d1")]
    header = validate.normalise_documents(valid).orderBy("modified").first()
    assert (str(header.issue_date), header.modified) == ("2025-01-02", 1735862400)


def test_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    path = land(tmp_path)
    stores = [Snapshots(spark, str(tmp_path / n)) for n in ("batch", "stream")]
    ingest.merge(stores[0], landing.read_documents(spark, path))
    ingest.merge(stores[0], landing.read_documents(spark, path))
    ingest.ingest(spark, path, stores[1], str(tmp_path / "c"), str(tmp_path / "q")).awaitTermination()
    (docs, lines), (docs2, lines2) = stores[0].read(), stores[1].read()
    assert rows(docs, *docs.columns) == rows(docs2, *docs.columns) and docs.first().customer_id == "new"
    assert rows(lines, *lines.columns) == rows(lines2, *lines.columns) and lines.count() == 1
    assert spark.read.json(str(tmp_path / "q/batch=0")).count() == 3


def test_late_versions_do_not_replace_newer_ones(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    docs = landing.read_documents(spark, land(tmp_path)).where("id = 'd1'")
    ingest.merge(store, docs.where("customer_id = 'new'"))
    ingest.merge(store, docs.where("customer_id = 'c'"))
    held, lines = store.read()
    assert held.first().customer_id == "new" and lines.first().item_id == "2"


def test_sync_picks_full_or_delta(spark, tmp_path):
    store = Snapshots.of_account(spark, str(tmp_path), "My shop/1")
    assert store.root.endswith("/My_shop_1") and ingest.needs_sync(None, "a", 0)
    docs = landing.read_documents(spark, land(tmp_path))
    moment = 1735862400  # of the older versions
    summary, refused = ingest.sync(store, docs.where("modified < '2025-01-04'"), "a", moment)
    assert tuple(summary.drop("seconds").first()) == ("full", 1, 1, 0) and summary.first().seconds > 0 and refused.count() == 3
    summary, refused = ingest.sync(store, docs, "a", moment + 9)
    assert tuple(summary.drop("seconds").first()) == ("delta", 1, 1, 0) and refused.count() == 0
    assert store.read()[0].first().customer_id == "new"
    assert (store.state()["lastSync"], store.state()["lastFullSync"]) == (moment + 9, moment)
    summary, _ = ingest.sync(store, docs, "a", moment + 100_000_000)
    assert summary.first().type == "delta" and summary.first().documents_processed == 1  # changed after the last sync's moment
    assert ingest.kind_of(store.state(), "b") == ingest.kind_of(store.state(), "a", True) == "full"
    now = store.state()["lastSync"]
    assert not ingest.needs_sync(store.state(), "a", now + 3600) and ingest.needs_sync(store.state(), "a", now + 3601)


def test_feeds_refuse_invalid_creates(spark):
    customers = spark.createDataFrame([("a", 2, "A")], "id string, context_id int, name string")
    feed = spark.createDataFrame([("create", 1, "b", 8, "B"), ("create", 1, "c", 5, "C"), ("create", 1, "d", None, "D"), ("update", 1, "a", None, "A2")], "op string, seq int, id string, context_id int, name string")
    held, refused = tables.apply_customer_feed(customers, feed)
    assert rows(held, "id", "name") == [("a", "A2"), ("b", "B")]
    assert rows(refused, "id", "reason") == [("c", "context_id is not valid"), ("d", "context_id is required")]


def test_lists_and_names_in_texts(spark):
    held = spark.createDataFrame([("3, 6x,a,,12,99999999999",), ("",), (None,)], "t string").select(int_list(F.col("t")), safe_name(F.col("t"))).collect()
    assert [r[0] for r in held] == [[3, 6, 12], [], None] and held[0][1] == "3__6x_a__12_99999999999"
    assert periods_of("12, 3,5,x,6m") == (12, 3, 6)


def test_change_records_wrapped_bare_and_broken(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/a.json").write_text('{"item": {"id": 1, "name": "a"}}\n{"id": 2, "name": "b"}\n{oops\n{}\n')
    good, bad = landing.read_changes(spark, str(tmp_path / "feed"), "struct<id:long,name:string>", "item")
    assert rows(good, "id", "name") == [(1, "a"), (2, "b")] and bad.count() == 2


def test_lists_and_pages(spark):
    held = spark.createDataFrame([(i, f"Name {i}", i * 10) for i in range(10)], "id long, name string, modified long")
    assert rows(lookups.listed(held, ("name",), "NAME 3"), "id") == [(3,)]
    assert rows(lookups.listed(held, modified_after=70), "id") == [(8,), (9,)]
    assert [r.id for r in lookups.page(held, "id", 2, 4).collect()] == [4, 5, 6, 7]
    assert lookups.page(held, "id", 4, 4).count() == 0


@pytest.mark.parametrize("ranges, held", [(1024, 10_000), (3, 5), (2, 1)])
def test_distant_pages_equal_pages_by_offset(spark, ranges, held):
    keys = [*range(0, 300, 7), *range(10**12, 10**12 + 90), -(2**60), 2**61]
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "id long, name string").repartition(3)
    for number in (1, 2, 7, 13, 14, 15, 400):
        want = [r.id for r in lookups.page(rows, "id", number, 10).collect()]
        assert [r.id for r in lookups.distant_page(rows, "id", number, 10, ranges, held).collect()] == want
    assert lookups.distant_page(rows.limit(0), "id", 1, 10).count() == 0
    with pytest.raises(ValueError):
        lookups.distant_page(rows, "name", 1, 10)
    last, found = None, []
    while page := lookups.page_after(rows, "id", last, 40).collect():
        found += [r.id for r in page]
        last = found[-1]
    assert found == sorted(keys)


def test_bucketed_tables_join_without_a_shuffle(spark):
    documents = spark.createDataFrame([(f"d{i}", 5, i, None, "c", 10) for i in range(50)], schemas.DOCUMENTS)
    lines = documents.selectExpr("'1' as item_id", "doc_id", f"cast(2 as {schemas.MONEY}) as quantity", f"cast(3 as {schemas.MONEY}) as price")
    bucketed.save(documents, lines, "test_bucketed", 4)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held = bucketed.read(spark, "test_bucketed")
        joined = facts.sales_lines(held[1], held[0])
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text and joined.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        for table in ("documents", "lines"):
            spark.sql(f"drop table test_bucketed_{table}")


def test_context_reasons(spark):
    held = spark.createDataFrame([("5",), ("8",), ("x",), (None,)], "c string")
    found = [r[0] for r in held.select(validate.context_reason(F.col("c"))).collect()]
    assert found == [None, "context_id is not valid", "context_id is not a number", "context_id is required"]


def test_json_shows_nulls(spark, tmp_path):
    landing.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_registry_covers_its_oracle():
    assert set(oracle.oracle_sql()) <= set(registry.queries())


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch.folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("kind", ["items", "customers", "categories", "locations"])
def test_every_dimension_is_looked_up(spark, kind):
    duckdb = pytest.importorskip("duckdb")
    folder, name = "/root/testdata/sf0.01", f"get_{kind}_by_id"
    held = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "nation"):
        held.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = held.execute(oracle.oracle_sql()[name]).fetchall()
    found = registry.queries()[name](spark, folder)
    text = lambda row: [float(x) if isinstance(x, int) or hasattr(x, "as_tuple") else x for x in row]
    assert want and sorted(map(str, map(text, found.collect()))) == sorted(map(str, map(text, want)))


def test_tables_of_a_scope_are_removed(spark):
    def there(df):
        return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())

    outside = scratch.written(spark.range(3))
    with scratch.scope(spark) as lasting:
        inside = scratch.written(spark.range(4))
        with scratch.scope(spark) as inner_lasting:
            inner = scratch.written(inside)
            handed = inner_lasting(inner)
        assert there(inside) and there(handed) and not there(inner)
        result = lasting(handed)
    assert there(outside) and there(result) and not there(inside) and not there(handed)
    assert result.count() == 4
