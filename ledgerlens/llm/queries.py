"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, embeddings, exact, lines, packing, quality, search, sharding, simhash, spelling, toxicity, urllists, warc
from ledgerlens.scratch import written

VOCABULARY = "word_bpe_49k.json"
WINDOW, END_ID, SHARDS = 2048, 1, 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = _table(spark, sf_dir, "labels").where(~_held_out())
    return toxicity.train(_table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir)).drop("text")
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def warc_replicas(pages: DataFrame, per_archive: int = 500) -> tuple[DataFrame, DataFrame]:
    """Two replicas of records made of pages, hashed where they stand (archive, offset, length, body).

    Runs of page ids stand in one archive, one after the other; pages without an id are dealt over 4,096 archives of their own.  In the second replica
    some records have a wrong last character, and some are lost, those without an id among them.
    """
    payload = F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")))
    worn = F.when(F.col("page_id") % 97 == 13, F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit("?"))).otherwise(F.col("payload"))
    rows = pages.select("page_id", payload.alias("payload")).withColumn("worn", worn)
    hashed = lambda c: F.struct(F.octet_length(c).cast("long").alias("length"), F.sha2(F.col(c).cast("binary"), 256).alias("body"))
    rows = rows.select("page_id", hashed("payload").alias("first"), hashed("worn").alias("second"))
    number = F.coalesce(F.floor(F.col("page_id") / per_archive).cast("string"), F.concat(F.lit("none-"), F.substring("first.body", 1, 3)))
    rows = rows.withColumn("archive", F.concat(F.lit("archive-"), number))
    before = Window.partitionBy("archive").orderBy("page_id", "first.body").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("offset", F.coalesce(F.sum("first.length").over(before), F.lit(0))))  # both have the same offsets
    return rows.select("archive", "offset", "first.*"), rows.where("page_id % 101 <> 7").select("archive", "offset", "second.*")


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.compared(*warc_replicas(_table(spark, sf_dir, "pages")))


OP3_SQL = r"""
with p as (
  select page_id, 'archive-' || cast(page_id // 500 as varchar) as archive,
         'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') as payload
  from pages),
o as (
  select *, cast(coalesce(sum(octet_length(encode(payload))) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from p),
r as (
  select archive, "offset", page_id, payload,
         case when page_id % 97 = 13 then left(payload, length(payload) - 1) || '?' else payload end as worn from o),
d as (
  select archive, "offset", page_id, payload, worn, cast(octet_length(encode(payload)) as bigint) as left_length, cast(octet_length(encode(worn)) as bigint) as right_length from r),
x as (
  select archive, "offset", page_id, left_length, right_length,
         sha256(archive || ':' || cast("offset" as varchar) || ':' || cast(left_length as varchar) || ':' || sha256(payload)) as left_digest,
         sha256(archive || ':' || cast("offset" as varchar) || ':' || cast(right_length as varchar) || ':' || sha256(worn)) as right_digest from d)
select archive, "offset", case when page_id % 101 = 7 then 'missing' else 'changed' end as status, left_length,
       case when page_id % 101 = 7 then null else right_length end as right_length, left_digest,
       case when page_id % 101 = 7 then null else right_digest end as right_digest
from x where page_id % 101 = 7 or left_digest <> right_digest
"""


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched): pages with fetch times spread over 2024."""
    return pages.select("page_id", "url", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id * 7919 % 366 as int), cast(page_id % 24 as int), 0, 0)").alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries (domain, since, listed) of the pages' hosts: some are listed for a time, some twice, and one domain above them is."""
    hosts = pages.select(urllists.host_of("url").alias("domain")).where("domain is not null").distinct()
    turn = hosts.withColumn("n", F.crc32(F.col("domain").cast("binary")) % 360)
    day = lambda extra: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(n + {extra} as int), 0, 0, 0)")
    listed = turn.where("n % 3 <> 0").select("domain", day(0).alias("since"), F.lit(True).alias("listed"))
    lifted = turn.where("n % 3 = 1").select("domain", day(40).alias("since"), F.lit(False).alias("listed"))
    again = turn.where("n % 6 = 1").select("domain", day(95).alias("since"), F.lit(True).alias("listed"))
    above = hosts.where("domain like '%.example.net'").select(F.lit("example.net").alias("domain"), F.expr("timestamp'2024-10-01 00:00:00'").alias("since"), F.lit(True).alias("listed")).distinct()
    return listed.unionByName(lifted).unionByName(again).unionByName(above)


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urllists.judge(captures_of(pages), entries_of(pages)).select("page_id", "fetched", "listed", "list_domain", "list_since")


OP4_SQL = r"""
with c as (
  select page_id, timestamp '2024-01-01 00:00:00' + to_days(cast(page_id * 7919 % 366 as integer)) + to_hours(cast(page_id % 24 as integer)) as fetched,
         nullif(regexp_extract(lower(url), '^\s*https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host
  from pages),
g as (select unnest(generate_series(0, 255)) as i),
t0 as (select cast(i as ubigint) as i, i::ubigint as c, 0 as k from g),
t as (
  with recursive r(i, c, k) as (
    select i, c, k from t0 union all
    select i, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, k + 1 from r where k < 8)
  select i, c from r where k = 8),
h as (select distinct host as domain from c where host is not null),
crc as (
  with recursive q(domain, b, pos, v) as (
    select domain, encode(domain), 0, 4294967295::ubigint from h union all
    select q.domain, q.b, q.pos + 1, xor(q.v // 256, t.c)
    from q join t on t.i = xor(q.v % 256, cast(ascii(substr(q.domain, q.pos + 1, 1)) as ubigint)) where q.pos < length(q.domain))
  select domain, xor(v, 4294967295::ubigint) % 360 as n from q where pos = length(domain)),
e as (
  select domain, timestamp '2024-01-01 00:00:00' + to_days(cast(n as integer)) as since, true as listed from crc where n % 3 <> 0 union all
  select domain, timestamp '2024-01-01 00:00:00' + to_days(cast(n + 40 as integer)), false from crc where n % 3 = 1 union all
  select domain, timestamp '2024-01-01 00:00:00' + to_days(cast(n + 95 as integer)), true from crc where n % 6 = 1 union all
  select distinct 'example.net', timestamp '2024-10-01 00:00:00', true from h where domain like '%.example.net'),
m as (
  select c.page_id, e.domain, e.since, e.listed,
         row_number() over (partition by c.page_id order by length(e.domain) desc, e.since desc) as rn
  from c join e on (c.host = e.domain or c.host like '%.' || e.domain) and e.since <= c.fetched)
select c.page_id, c.fetched, coalesce(m.listed, false) as listed, m.domain as list_domain, m.since as list_since
from c left join m on m.page_id = c.page_id and m.rn = 1
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = lines.drop_boilerplate(docs, "source", "text", 0.05, 3)
    return cleaned.select("doc_id", F.col("dropped_lines").cast("long").alias("dropped_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP5_SQL = r"""
with l as (select source, doc_id, unnest(list_distinct(string_split(text, chr(10)))) as line from documents),
t as (select source, count(*) as total from documents group by source),
b as (
  select l.source, l.line from l join t using (source) where l.line <> ''
  group by l.source, l.line having count(*) >= 3 and count(*) / any_value(t.total) > 0.05),
s as (select source, list(line) as bad from b group by source),
d as (
  select doc_id, string_split(text, chr(10)) as parts, coalesce(s.bad, []) as bad from documents left join s using (source))
select doc_id, cast(len(parts) - len(list_filter(parts, lambda x: not list_contains(bad, x))) as bigint) as dropped_lines,
       sha256(array_to_string(list_filter(parts, lambda x: not list_contains(bad, x)), chr(10))) as text_sha256
from d
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.components(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP6_SQL = r"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (
  select vec_id, vec_id from embeddings
  union
  select reach.a, link.b from reach join link on reach.b = link.a)
select vec_id, (select count(*) from link where link.a = vec_id) as n_links, min(reach.b) as component_id, vec_id = min(reach.b) as kept
from embeddings join reach on reach.a = vec_id group by vec_id
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pieces_of(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents with their ids and the checksum of these."""
    pieces = packing.tokenised_pieces(docs, vocabulary or public_tokenizers.path(VOCABULARY), WINDOW, END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(pieces_of(_table(spark, sf_dir, "documents")).drop("ids"), WINDOW, order=("doc_id", "start", "ids_crc32"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       row_number() over (partition by t order by doc_id) = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""


def _held_out_of_quality(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, _table(spark, sf_dir, "labels").where(~_held_out_of_quality()))
    scored = quality.score(docs, weights).drop("text")
    return scored.select("doc_id", F.coalesce(_held_out_of_quality(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(_table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


OP12_SQL = r"""
with recursive turns as (select unnest(range(0, 256)) as i),
crc_table as (
  select list(list_reduce(list_concat([i], range(0, 8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t from turns),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
counted as (select id, run, count(*) as n from runs where length(run) >= 5 group by id, run),
coded as (select run, n, hex(encode(id || ':' || run)) as x from counted),
summed as (
  select run, n,
         xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda k: (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1)),
                         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) as h
  from coded, crc_table),
worn as (
  select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, cast(h % length(run) + 2 as bigint)) else run end as word, n from summed),
v as (select word, cast(sum(n) as bigint) as n from worn where length(word) >= 5 group by word having sum(n) >= 3),
shorter as (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from v)),
near as (
  select a.word, b.word as other from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union
  select a.word, b.word from shorter a join v b on a.rest = b.word
  union
  select b.word, a.word from shorter a join v b on a.rest = b.word),
best as (
  select near.word, count(*) as n_near, min(case when o.n >= 2 * v.n then {'minus': -o.n, 'form': o.word} end) as best
  from near join v on v.word = near.word join v o on o.word = near.other group by near.word),
forms as (
  select v.word, v.n, coalesce(best.n_near, 0) as n_near, best.best.form as form, -best.best.minus as form_n from v left join best on best.word = v.word),
walk(word, reached, k) as (
  select word, word, 0 from forms
  union all
  select walk.word, forms.form, k + 1 from walk join forms on forms.word = walk.reached where forms.form is not null),
roots as (select word, max_by(reached, k) as root from walk group by word)
select forms.word, n, n_near, form, form_n, root from forms join roots using (word)
"""


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


OP13_SQL = r"""
with cut as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as terms
  from documents),
d as (select r, doc_id, terms, len(terms) as n from cut where len(terms) > 0),
whole as (select count(*) as docs, cast(sum(n) as bigint) as length from d),
items as (
  select distinct item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term
  from benchmark),
found as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from d) where term in (select term from items) group by r, term),
weighed as (
  select term, cast(floor(1000 * ln((2 * cast(docs as double) + 2) / (2 * count(*) + 1))) as bigint) as w from found, whole group by term, docs),
points as (
  select items.item_id, d.r, d.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) as bigint) as score
  from items join found on found.term = items.term join weighed on weighed.term = items.term join d on d.r = found.r, whole
  group by items.item_id, d.r, d.doc_id),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from points where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""


def queries() -> dict:
    own = (op1_bpe, op2_toxicity, op3_warc_audit, op4_url_lists, op5_line_dedup, op6_embedding_dedup, op7_sharding, op8_packing, op9_simhash, op10_exact_dedup, op11_quality, op12_spelling, op13_search)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_audit": OP3_SQL, "op4_url_lists": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op12_spelling": OP12_SQL, "op13_search": OP13_SQL}
