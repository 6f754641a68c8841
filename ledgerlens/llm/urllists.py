"""URL filter lists that change with time: an as-of join of captures with the entries active at fetch time.

List entries are dated: each says from when a domain is listed or no longer listed.  The entries of a domain become
intervals from each entry to the next one.  A capture is judged by the entries of its host and of every domain
above it at its fetch time; the most specific domain that has an entry by then decides.

The join is an equi-join on domain and month, for which intervals are laid out by month; at most one interval of a
domain covers an instant, so a capture meets one interval a domain.  Which of a host's domains have entries at all is
found beforehand, for each distinct host, so captures are not dealt by domains that no list names.  All of it is
DataFrame operations.

Defined results: captures without a URL, host or time are kept and unlisted; host names are compared in lower case
without port and user; entries without domain or time are ignored; of entries with the same domain and time the
one that lists wins; an entry's own instant belongs to it; repeated captures are judged each; other columns pass
through whatever their names, and the added columns replace columns of the same name; empty lists leave every
capture unlisted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.shared import unused
from ledgerlens.scratch import written


def host_of(url: str | Column) -> Column:
    """Host of an absolute http(s) URL in lower case; null if there is none."""
    found = F.regexp_extract(F.lower(F.col(url) if isinstance(url, str) else url), r"^\s*https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def intervals(entries: DataFrame, until) -> DataFrame:
    """Rows (domain, since, before, listed, month): each entry's interval, once for every month it touches up to `until`."""
    dated = entries.select(F.lower("domain").alias("domain"), F.col("since").cast("timestamp").alias("since"), F.col("listed").cast("boolean").alias("listed"))
    dated = dated.where("domain is not null and since is not null and listed is not null").groupBy("domain", "since").agg(F.max("listed").alias("listed"))
    following = F.lead("since").over(Window.partitionBy("domain").orderBy("since"))
    end = F.least(F.coalesce(F.col("before"), F.lit(until).cast("timestamp")), F.lit(until).cast("timestamp"))
    held = dated.withColumn("before", following).where(F.col("since") <= F.lit(until).cast("timestamp"))
    months = F.sequence(F.trunc("since", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return held.withColumn("month", F.explode(months))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with listed (boolean), list_domain and list_since of the deciding entry (null without one).

    Each distinct pair of host and fetch time is judged once.
    """
    captures = captures.drop("listed", "list_domain", "list_since")
    host, at, of, when, verdict = unused(captures.columns, "_host", "_at", "_of", "_when", "_verdict")
    marked = captures.withColumns({host: host_of(url), at: F.col(fetched).cast("timestamp")})
    asked = marked.select(F.col(host).alias("host"), F.col(at).alias("at")).where("host is not null and at is not null").distinct()
    latest = captures.agg(F.max(F.col(fetched).cast("timestamp"))).first()[0]
    spans = intervals(entries, latest) if latest is not None else intervals(entries.limit(0), "1970-01-01")
    spans = written(spans)
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("domain"), (F.size(labels) - i).alias("labels")))
    above = asked.select("host").distinct().select("host", F.explode(names).alias("try")).select("host", "try.*")
    above = above.join(spans.select("domain").distinct(), "domain").groupBy("host").agg(F.collect_list(F.struct("domain", "labels")).alias("tries"))
    tried = asked.join(above, "host").select("host", "at", F.trunc("at", "month").alias("month"), F.explode("tries").alias("try")).select("host", "at", "month", "try.*")
    met = tried.join(spans, ["domain", "month"]).where((F.col("since") <= F.col("at")) & (F.col("before").isNull() | (F.col("at") < F.col("before"))))
    best = met.groupBy(F.col("host").alias(of), F.col("at").alias(when)).agg(F.max(F.struct("labels", "domain", "since", "listed")).alias(verdict))
    # rows without host or time are judged apart: as null keys they would all meet in one task
    none = F.lit(None).cast("struct<labels:int,domain:string,since:timestamp,listed:boolean>")
    known = F.col(host).isNotNull() & F.col(at).isNotNull()
    judged = marked.where(known).join(best, (F.col(host) == F.col(of)) & (F.col(at) == F.col(when)), "left").drop(of, when)
    judged = judged.unionByName(marked.where(~known).withColumn(verdict, none))
    found = lambda field: F.col(verdict)[field]
    return judged.select(*captures.columns, F.coalesce(found("listed"), F.lit(False)).alias("listed"), found("domain").alias("list_domain"), found("since").alias("list_since"))
