"""Merkle fixity audit of archive replicas.

Records of an archive are hashed with their place and length.  The records that begin in one range of offsets, in
order, are hashed into a leaf, and runs of `FANOUT` neighbours into the nodes above, up to one root for each
archive.  Replicas are compared from the roots down: only below nodes that differ are the children fetched
and compared, so where the replicas agree nothing but the root is looked at, and only the records of
differing leaves are compared one by one.

Defined results: a null payload counts as empty (and differs from no record); records without archive or offset
are left out; if several records of a replica share a place, their digests are hashed together; other columns are not
read; replicas without records have no roots, and an archive that one replica lacks is reported record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.scratch import scope, written

RANGE_BYTES, FANOUT = 1 << 16, 16


def _joined_hash(parts: Column) -> Column:
    return F.sha2(F.concat_ws(",", parts), 256)


def bodies(records: DataFrame, archive: str = "archive", offset: str = "offset", payload: str = "payload") -> DataFrame:
    """Rows (archive, offset, length, body) of records: the payload's length and hash in its place."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    return records.select(F.col(archive).alias("archive"), F.col(offset).cast("long").alias("offset"), F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("body"))


def digests(hashed: DataFrame) -> DataFrame:
    """Rows (archive, offset, length, digest), one for each place, of hashed records (see `bodies`)."""
    each = hashed.where("archive is not null and offset is not null")
    placed = each.groupBy("archive", "offset").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list("body")).alias("bodies"))
    digest = F.sha2(F.concat_ws(":", "archive", F.col("offset").cast("string"), F.col("length").cast("string"), F.concat_ws(",", "bodies")), 256)
    return placed.select("archive", "offset", "length", digest.alias("digest"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the trees from the leaves up, each (archive, node, digest); the last holds the roots, node 0."""
    ordered = lambda: F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws("=", x["node"].cast("string"), x["digest"]))
    levels = [leaves]
    most = leaves.agg(F.max("node")).first()[0]
    while most:
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(_joined_hash(ordered()).alias("digest"))
        levels.append(written(up.withColumnRenamed("up", "node")))
        most //= FANOUT
    return levels


def leaves_of(found: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Leaf level: the digests of the records that begin in each range of offsets, in order."""
    node = F.floor(F.col("offset") / range_bytes).cast("long").alias("node")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("offset", "digest"))), lambda x: x["digest"])
    return written(found.groupBy("archive", node).agg(_joined_hash(ordered).alias("digest")))


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.select("archive", "node", F.col("digest").alias("l")).join(right.select("archive", "node", F.col("digest").alias("r")), ["archive", "node"], "full")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", "node")


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Places where two replicas differ: (archive, offset, status, left_length, right_length, left_digest, right_digest).

    `left` and `right` are records (archive, offset, payload); status is missing (in `right`), extra or changed.
    """
    return compared(bodies(left), bodies(right), range_bytes)


def compared(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As `audit`, of records whose payloads are hashed already: payloads need not be moved."""
    with scope(left.sparkSession) as lasting:
        sides = [written(digests(x)) for x in (left, right)]
        trees = [tree(leaves_of(x, range_bytes)) for x in sides]
        depth = max(map(len, trees))
        # an archive whose tree is lower than the other replica's is compared from the shared height down
        suspects = None
        for level in range(depth - 1, -1, -1):
            nodes = [t[level] if level < len(t) else t[-1].where("false") for t in trees]
            if suspects is not None:
                below = suspects.withColumnRenamed("node", "up")
                nodes = [n.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(below, ["archive", "up"], "left_semi").drop("up") for n in nodes]
            suspects = written(_differing(*nodes))
        suspects = suspects.withColumnRenamed("node", "leaf")
        held = [x.withColumn("leaf", F.floor(F.col("offset") / range_bytes).cast("long")).join(suspects, ["archive", "leaf"], "left_semi") for x in sides]
        l, r = (x.select("archive", "offset", F.col("length").alias(f"{n}_length"), F.col("digest").alias(f"{n}_digest")) for x, n in zip(held, ("left", "right")))
        both = l.join(r, ["archive", "offset"], "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
        status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
        return lasting(both.select("archive", "offset", status.alias("status"), "left_length", "right_length", "left_digest", "right_digest"))
