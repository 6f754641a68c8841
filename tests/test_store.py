"""The store: versions, concurrent jobs, batches and parts, lookups and removals."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas, scratch
from ledgerlens.operators import store as stores
from ledgerlens.operators.store import Conflict, Snapshots
from ledgerlens.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def stored(spark, *ids):
    documents = spark.createDataFrame([(i, 5, 1, None, "c", 10) for i in ids], schemas.DOCUMENTS)
    return documents, documents.selectExpr("'1' as item_id", "doc_id", f"cast(2 as {schemas.MONEY}) as quantity", f"cast(3 as {schemas.MONEY}) as price")


def landed(spark, start, end, customer="c", day=3, lines=2):
    """Landed documents d<start> to d<end - 1> with this customer, modification day and number of lines."""
    items = F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda k: F.struct(k.cast("string").alias("item_id"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("price")))
    name = F.concat(F.lit("d"), F.col("id").cast("string"))
    return spark.range(start, end).select(name.alias("id"), F.lit(5).alias("context_id"), F.col("id").alias("document_number"), F.lit(customer).alias("customer_id"), F.lit("2025-01-02").alias("issue_date"), F.lit(f"2025-01-0{day}T00:00:00Z").alias("modified"), items.alias("document_items"))


def bytes_of(path):
    return {f: f.stat().st_size for f in Path(path).rglob("*.parquet")}


def manifests(path):
    return sorted(int(f.name[:12]) for f in (path / "manifests").glob("[0-9]*.json"))


def test_a_lost_driver_leaves_the_last_whole_version(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.read() is None and store.state() is None
    store.swap(*stored(spark, "a"))
    second = store.swap(*stored(spark, "a", "b", "c"), state=lambda documents, lines: {"documentCount": documents, "itemDocumentCount": lines})
    # a job that dies after the data of the next version, and one that dies within its manifest
    spark.range(9).write.parquet(str(tmp_path / "s/data/000000000003-lost/documents"))
    spark.range(9).write.parquet(str(tmp_path / "s/data/000000000009-running/documents"))
    (tmp_path / "s/manifests/_half").write_text('{"version": 3, "par')
    assert store.version() == second and [t.count() for t in store.read()] == [3, 3]
    assert store.state()["documentCount"] == store.state()["itemDocumentCount"] == 3
    for name in "defg":
        store.swap(*stored(spark, name))
    assert [rows(t, "doc_id") for t in store.read()] == [[("g",)], [("g",)]] and store.state()["documentCount"] == 3
    # what the newest three do not name is removed, but for what a running job may be writing
    assert manifests(tmp_path / "s") == [*range(7)] and {f.name[:12] for f in (tmp_path / "s/data").iterdir()} == {f"{n:012d}" for n in (4, 5, 6, 9)}
    monkeypatch.setattr(stores, "HORIZON", -1)
    store.retire()
    assert manifests(tmp_path / "s") == [4, 5, 6] and store.read()[0].count() == 1
    for f in (tmp_path / "s/manifests").iterdir():
        f.unlink()
    with pytest.raises(ValueError, match="no manifest is complete"):
        store.read()


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), part_rows=20_000)
    ingest.merge(store, landed(spark, 0, 30_000), now=1)
    before = bytes_of(tmp_path / "s")
    held = store.manifest()
    assert [p.bits for p in held.parts] == [3] * 8 and not held.batches and (held.documents, held.lines) == (30_000, 60_000)
    # one per cent, of which a third is new
    done = ingest.merge(store, landed(spark, 29_800, 30_100, "new", 4, 3), now=2)
    after = bytes_of(tmp_path / "s")
    written = sum(n for f, n in after.items() if f not in before)
    assert before.items() <= after.items() and written < 0.05 * sum(before.values())
    documents, lines = store.read()
    assert (done.documents, done.lines, done.refused.count()) == (300, 900, 0)
    assert documents.count() == 30_100 and documents.where("customer_id = 'new'").count() == 300
    assert lines.count() == 60_000 + 100 * 3 + 200 and lines.where("doc_id = 'd29900'").count() == 3
    assert (store.state()["documentCount"], store.state()["itemDocumentCount"]) == (30_100, 60_500)
    assert (store.state()["lastSync"], store.state()["lastFullSync"]) == (2, 1)


def test_batches_are_folded_and_parts_split(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), part_rows=500)
    want, most = {}, 0
    for turn in range(9):
        start, end = 90 * turn, 90 * turn + 150
        ingest.merge(store, landed(spark, start, end, f"c{turn}", 1 + turn, 1 + turn % 3), now=turn)
        want |= {f"d{i}": (f"c{turn}", 1 + turn % 3) for i in range(start, end)}
        held = store.manifest()
        assert sum(b.rows * held.waiting(b) for b in held.batches) <= store.fold_share * (held.documents + held.lines)
        assert sum(2.0**-p.bits for p in held.parts) == 1 and len({(p.bits, p.value) for p in held.parts}) == len(held.parts)
        most = max(most, *(p.rows for p in held.parts))
        documents, lines = store.read()
        counts = {r.doc_id: r["count"] for r in lines.groupBy("doc_id").count().collect()}
        assert {r.doc_id: (r.customer_id, counts.pop(r.doc_id)) for r in documents.collect()} == want and not counts
        assert (held.documents, held.lines) == (len(want), sum(n for _, n in want.values()))
    assert len(held.parts) >= 4 and most <= 600


@pytest.mark.parametrize("first", [True, False])
def test_interleaved_merges_keep_both(spark, tmp_path, monkeypatch, first):
    store = Snapshots(spark, str(tmp_path / "s"))
    if not first:
        ingest.merge(store, landed(spark, 0, 200), now=1)
    commit, others = Snapshots._commit, [landed(spark, 300, 400, "other", 4), landed(spark, 150, 350, "late", 2)]

    def interrupted(self, manifest):
        if manifest.version and others:  # another job commits between this one's reading and its commit
            ingest.merge(store, others.pop(0), now=5)
        return commit(self, manifest)

    monkeypatch.setattr(Snapshots, "_commit", interrupted)
    ingest.merge(store, landed(spark, 100, 320, "mine", 3), now=6)
    documents, lines = store.read()
    found = {r.doc_id: r.customer_id for r in documents.collect()}
    own = {} if first else {f"d{i}": "c" for i in range(200)}
    late = {f"d{i}": "late" for i in range(150, 350)}
    want = own | late | {f"d{i}": "mine" for i in range(100, 320)} | {f"d{i}": "other" for i in range(300, 400)}
    assert not others and found == want and lines.count() == 2 * len(want)
    held = store.manifest()
    assert (held.documents, held.lines) == (len(want), 2 * len(want))
    assert {f.name for f in (tmp_path / "s/data").iterdir()} >= {f.removeprefix("data/") for f in held.folders() - {""}}


def test_a_merge_that_is_always_second_refuses(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path / "s"), attempts=2)
    store.swap(*stored(spark, "a"))
    commit = Snapshots._commit

    def taken(self, manifest):
        assert commit(self, stores.replace(self.manifest(), version=manifest.version))
        return commit(self, manifest)

    monkeypatch.setattr(Snapshots, "_commit", taken)
    with pytest.raises(Conflict):
        ingest.merge(store, landed(spark, 0, 5))
    assert rows(store.read()[0], "doc_id") == [("a",)] and len(list((tmp_path / "s/data").iterdir())) == 1


def test_lookups_read_the_parts_of_their_keys(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), part_rows=300)
    ingest.merge(store, landed(spark, 0, 2_000), now=1)
    ingest.merge(store, landed(spark, 7, 8, "new", 4), now=2)
    keys = spark.createDataFrame([("d7",), ("d8",), ("d8",), ("none",), (None,)], "doc_id string")
    documents, lines = store.of_documents(keys)
    assert rows(documents, "doc_id", "customer_id") == [("d7", "new"), ("d8", "c")]
    assert [r[0] for r in rows(lines, "doc_id")] == ["d7", "d7", "d8", "d8"]
    held = store.manifest()
    read = {re.sub(".*/part=(\\d+)/.*", "\\1", f) for f in lines.inputFiles() if "part=" in f}
    assert len(held.parts) >= 16 and len(read) <= 4
    wanted = store._parts_of(held, keys)
    assert {int(x) for x in read} == {p.value for p in wanted}


def test_documents_gone_at_source_vanish_on_demand(spark, tmp_path):
    store = Snapshots.of_account(spark, str(tmp_path), "shop")
    assert ingest.remove_unlisted(store, landed(spark, 0, 1)) == 0
    ingest.sync(store, landed(spark, 0, 100), "shop", 10)
    summary, _ = ingest.sync(store, landed(spark, 20, 110, "new", 4), "shop", 20, forced=True)
    assert summary.first().documents_deleted == 0 and store.read()[0].count() == 110
    summary, _ = ingest.sync(store, landed(spark, 20, 105, "new", 4), "shop", 30, removals=True)
    assert (summary.first().type, summary.first().documents_deleted) == ("delta", 25)
    documents, lines = store.read()
    assert documents.count() == 85 and lines.count() == 170 and lines.where("doc_id = 'd5'").isEmpty()
    assert (store.state()["documentCount"], store.state()["itemDocumentCount"]) == (85, 170)
    # what comes back counts anew
    ingest.merge(store, landed(spark, 0, 10, "back", 1), now=40)
    assert store.read()[0].where("customer_id = 'back'").count() == 10 and store.state()["documentCount"] == 95
    store.remove(spark.createDataFrame([("d0",), ("nobody",)], "doc_id string"))
    assert store.manifest().documents == store.read()[0].count() == 94


def test_merges_leave_the_refused_alone(spark, tmp_path):
    shared = Path(scratch.folder(spark)).parent
    store = Snapshots(spark, str(tmp_path / "s"))
    before = {f.name for f in shared.iterdir()}
    for turn in range(10):
        done = ingest.merge(store, landed(spark, turn, turn + 5).withColumn("customer_id", F.when(F.col("document_number") != turn, "c")), now=turn)
        assert rows(done.refused, "reason") == [("customer_id is required",)]
    left = {f.name for f in shared.iterdir()} - before
    assert len(left) == 10  # the refused of each


def test_manifest_is_one_small_file(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.swap(*stored(spark, "a", "b"))
    held = json.loads((tmp_path / "s/manifests/000000000001.json").read_text())
    assert held["version"] == 1 and held["documents"] == held["lines"] == 2 and len(held["parts"]) == 1
