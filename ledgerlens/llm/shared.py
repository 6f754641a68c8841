"""Hashed buckets, names, one row of each group, and connected components of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.scratch import written
from ledgerlens.shipping import ship


def buckets_for(rows: int, each: int, least: int = 1) -> int:
    """How many hash buckets give about `each` rows in one."""
    return max(least, -(-rows // each))


#: Rows that one Arrow batch holds where whole texts go to Python.
BATCH_ROWS = 1024


def for_python(spark: SparkSession) -> None:
    """Sends the library to the Python workers, and has the session give them at most `BATCH_ROWS` rows at once; a smaller setting stays.

    Spark's own 10,000 rows of whole texts are tens of MB, held several times over by each task and its worker.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def lean(run):
    """`run`, a function for mapInArrow, that after each batch gives the memory that Arrow holds unused back to the system.

    Workers live on from task to task and from operator to operator, and what one of them once held would stay with it.
    """

    def wrapped(batches):
        for batch in run(batches):
            yield batch
            pa.default_memory_pool().release_unused()

    return wrapped


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with underscores put after it until no column has it, in whatever case."""
    taken = {c.lower() for c in columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if (n + "_" * k).lower() not in taken) for n in names]


#: Keys that are sent to all tasks at most; a key takes about a hundred bytes there.
BROADCAST_KEYS = 200_000


def without(rows: DataFrame, gone: DataFrame, on) -> DataFrame:
    """`rows` without those that meet a row of `gone`, a stored table of keys.

    Up to `BROADCAST_KEYS` keys are sent to the rows; beyond, rows and keys are dealt by key.
    """
    few = gone.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(gone) if few else gone, on, "left_anti")


def one_of_each(docs: DataFrame, doc_id: str, mark: Column, found: DataFrame) -> DataFrame:
    """`docs` with the rows that `found` keeps.

    `found` has a row (id, mark, kept) for each row of `docs`; `mark` tells rows of one id apart.  Rows that are alike
    in both are one row here: they stay or go together, and where they stay one of them is left.
    """
    own = docs.columns
    name, key, of = unused(own, "_mark", "_id", "_of")
    keys = written(found.groupBy(F.col("id").alias(key), F.col("mark").alias(of)).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")))
    same = lambda keys: docs[doc_id].eqNullSafe(keys[key]) & (F.col(name) == keys[of])
    gone = written(keys.where("not kept").select(key, of))
    left = without(docs.withColumn(name, mark), gone, same(gone))
    repeated = written(keys.where("kept and rows > 1").select(key, of))
    if repeated.isEmpty():
        return left.select(*own)
    once = left.join(repeated, same(repeated), "left_semi").dropDuplicates([doc_id, name])
    return without(left, repeated, same(repeated)).unionByName(once).select(*own)


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Component of every node of an undirected edge list of longs: rows (node, component), component is the least node.

    Randomised contraction: in each round every node joins the neighbour (or itself) that comes first in an
    order drawn anew, edges move to the representatives and loops vanish; the number of nodes that still
    have edges falls by a constant factor a round.  Edges, nodes and labels stay distributed, each round's
    tables are written to the shared folder.  Edges with a null end are no edges; repeated edges and loops
    are harmless; no edges give no rows.
    """
    both = edges.select(F.col(source).cast("long").alias("a"), F.col(target).cast("long").alias("b")).where("a is not null and b is not null")
    live = written(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    turn = 0
    while not live.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("at"), F.col(c).alias("node"))
        ends = live.select("a", order("b").alias("near")).unionByName(live.select(F.col("b").alias("a"), order("a").alias("near")))
        chosen = ends.groupBy("a").agg(F.min("near").alias("near"))
        chosen = written(chosen.select("a", F.least(order("a"), F.col("near"))["node"].alias("to")))
        moved = live.join(chosen, "a").select(F.col("to").alias("a"), "b")
        moved = moved.join(chosen.select(F.col("a").alias("b"), F.col("to").alias("b_to")), "b").select("a", F.col("b_to").alias("b"))
        live = written(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if labels is None:
            labels = chosen.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            step = chosen.select(F.col("a").alias("label"), "to")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = written(labels.groupBy("label").agg(F.min("node").alias("component")))
    return labels.join(least, "label").select("node", "component")


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, src, dst) the (src, dst) of about as many as there are nodes: those that connect all that a and b connect.

    The contraction of `connected_components`, in which every node's choice is a pair that is taken.  Pairs with a = b are left out.
    """
    least, greatest = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    one_each = lambda rows: rows.where("a <> b").select(least, greatest, F.struct("src", "dst").alias("pair")).groupBy("a", "b").agg(F.min("pair").alias("pair")).select("a", "b", "pair.*")
    live, taken, turn = written(one_each(pairs)), None, 0
    while not live.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("at"), F.col(c).alias("node"))  # noqa: E731, B023
        near = lambda c: F.struct(order(c).alias("to"), "src", "dst").alias("near")  # noqa: E731, B023
        ends = live.select("a", near("b")).unionByName(live.select(F.col("b").alias("a"), near("a")))
        chosen = ends.groupBy("a").agg(F.min("near").alias("near")).withColumn("moves", F.col("near.to") < order("a"))
        chosen = written(chosen.select("a", F.when(F.col("moves"), F.col("near.to.node")).otherwise(F.col("a")).alias("to"), F.when(F.col("moves"), F.col("near.src")).alias("src"), F.when(F.col("moves"), F.col("near.dst")).alias("dst")))
        picked = chosen.where("src is not null").select("src", "dst")
        taken = picked if taken is None else taken.unionByName(picked)
        to = chosen.select("a", "to")
        moved = live.join(to, "a").select(F.col("to").alias("a"), "b", "src", "dst").join(to.select(F.col("a").alias("b"), F.col("to").alias("b_to")), "b")
        live = written(one_each(moved.select("a", F.col("b_to").alias("b"), "src", "dst")))
    return live.select("src", "dst") if taken is None else taken.distinct()
