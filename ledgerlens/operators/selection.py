"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.scratch import written


def exact_medians(rows: DataFrame, key: str, value: str, count: str | None = None) -> DataFrame:
    """Rows (key, median): the exact median of a decimal or whole number, by selection, for groups of any size.

    Values are taken as 64-bit whole numbers of their smallest unit.  Of the middle one (or two) the upper 16 bits are found
    from counts by range, then the next 16 among the values of that range alone, and so on: no task or buffer holds more
    than the counts of 65,536 ranges of a group.  The counts of values are written once for all rounds, and bits that all values
    share take no round.  Null values do not count; a group without values has no row; `count` says
    how often a row counts.
    """
    kind = rows.schema[value].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    unit = F.col(value).cast("decimal(38,0)") if not scale else (F.col(value).cast(T.DecimalType(38, scale)) * F.lit(10**scale).cast("decimal(18,0)"))
    values = written(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), unit.cast("long").alias("v")).agg((F.count("*") if count is None else F.sum(count)).cast("long").alias("n")))
    least, most = values.agg(F.coalesce(F.min("v"), F.lit(0)), F.coalesce(F.max("v"), F.lit(0))).first()
    shifts = [s for s in (48, 32, 16) if least >> s != most >> s] + [0]
    whole = values.groupBy("key").agg(F.sum("n").alias("whole"))
    middle = F.array(F.struct(F.lit(0).alias("which"), F.expr("(whole - 1) div 2").alias("at")), F.struct(F.lit(1).alias("which"), F.expr("whole div 2").alias("at")))
    wanted = whole.where("whole > 0").select("key", F.explode(middle).alias("m")).select("key", "m.*")
    for shift in shifts:
        held = values.withColumn("range", F.shiftright("v", shift))
        if shift == shifts[0]:
            met = held.join(wanted, "key")
        else:
            met = held.join(wanted.withColumnRenamed("range", "above"), (held["key"] == F.col("_key")) & (F.shiftright("v", shift + 16) == F.col("above"))).drop("_key")
        counts = met.groupBy("key", "which", "at", "range").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key", "which").orderBy("range"))
        found = counts.withColumn("upto", upto).where("at < upto and at >= upto - n")
        wanted = found.select(F.col("key") if shift == 0 else F.col("key").alias("_key"), "which", (F.col("at") - F.col("upto") + F.col("n")).alias("at"), "range")
    return wanted.groupBy(F.col("key").alias(key)).agg(F.avg(F.col("range") / 10**scale).alias("median"))
