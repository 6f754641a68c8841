"""An account's stored tables: headers and lines in parts by a hash of the document's id, and batches beside the parts.

A batch is written as it comes, beside the parts, and costs what it holds; what it replaces is left out when the tables
are read.  When batches make up more than a share of the tables, as many parts as needed are written anew with what the
batches hold of them, and a part that has outgrown its size is split by one or more further bits of the hash.

A manifest names the folders of all parts and batches and holds the state of the last sync.  Each version of it is derived
from the version before and committed by a rename that refuses an existing target, so of two jobs that derive from one
version the second finds its number taken, and derives anew from what the first has stored.  (That needs a file
system whose rename is atomic and refuses, as HDFS's does.)  Old manifests stay for twice `HORIZON`, and a job must commit
within it, so a number is never taken twice.  A job that dies leaves all that was there.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.scratch import scope, written


class Conflict(RuntimeError):
    """Other jobs have stored new versions each time that this one tried to."""


def store_name(account: str) -> str:
    """Folder name of an account's store: characters other than ASCII letters, digits, _ and - become _."""
    return re.sub("[^a-zA-Z0-9_-]", "_", account)


@dataclass(frozen=True)
class Part:
    """Documents whose hash begins with these bits, with all that versions up to `version` have of them."""

    bits: int
    value: int
    folder: str
    version: int
    rows: int


@dataclass(frozen=True)
class Batch:
    folder: str
    version: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    parts: tuple[Part, ...] = ()
    batches: tuple[Batch, ...] = ()
    documents: int = 0
    lines: int = 0
    state: dict | None = None

    @classmethod
    def of(cls, text: str) -> Manifest:
        held = json.loads(text)
        return cls(**held | {"parts": tuple(Part(**p) for p in held["parts"]), "batches": tuple(Batch(**b) for b in held["batches"])})

    def folders(self) -> set[str]:
        return {x.folder for x in (*self.parts, *self.batches)}

    def waiting(self, batch: Batch) -> float:
        """The share of a batch's rows that no part holds yet."""
        return sum(2.0**-p.bits for p in self.parts if p.version < batch.version)


def _prefix(bits: int, doc_id: str = "doc_id") -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - bits) if bits else F.lit(0).cast("long")


def _inside(parts) -> Column:
    """Whether a row's document belongs to one of these parts."""
    by_bits: dict[int, list[int]] = {}
    for p in parts:
        by_bits.setdefault(p.bits, []).append(p.value)
    return reduce(Column.__or__, (_prefix(b).isin(v) for b, v in by_bits.items()), F.lit(False))


#: Seconds within which a job must commit what it derives from a version.
HORIZON = 86_400

#: Files of one part at most, about: so many tasks write it.
FILES = 8

#: Codec of the tables' files: they are written once and kept.
CODEC = "zstd"

_FIELDS = {"documents": schemas.STORED_DOCUMENTS, "lines": schemas.STORED_LINES}


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


@dataclass(frozen=True)
class Snapshots:
    """Versions of both tables below `root`; a part is to hold `part_rows` rows at most, batches `fold_share` of all rows."""

    spark: SparkSession
    root: str
    part_rows: int = 4_000_000
    fold_share: float = 0.125
    attempts: int = 5

    @classmethod
    def of_account(cls, spark: SparkSession, root: str, account: str, **more) -> Snapshots:
        return cls(spark, f"{root}/{store_name(account)}", **more)

    # -- files ---------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, inside: str) -> list:
        path, files = self._path(inside)
        return list(files.globStatus(path) or [])

    def _remove(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def _numbers(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:12]) for f in self._listed("manifests/*.json"))

    def _named(self, number: int) -> Manifest:
        path, files = self._path(f"manifests/{number:012d}.json")
        held = files.open(path)
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def _new_folder(self, base: Manifest) -> str:
        """A folder for what will be the next version: its number tells when no version can name it any more."""
        return f"data/{base.version + 1:012d}-{uuid.uuid4().hex}"

    def _commit(self, manifest: Manifest) -> bool:
        """Whether the manifest became the version that it names; it did not if there is one already."""
        jvm = self.spark._jvm
        draft, files = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        final, _ = self._path(f"manifests/{manifest.version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(kind, 0))  # none of the options: no overwriting
            return True
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # -- reading -------------------------------------------------------------------------------------------------

    def version(self) -> int | None:
        return max(self._numbers(), default=None)

    def manifest(self) -> Manifest:
        """The newest version; version 0 is a store without rows."""
        number = self.version()
        if number is None:
            if self._listed("data/*"):
                raise ValueError(f"{self.root} has data, but no manifest is complete: restore one or name another folder")
            return Manifest()
        return self._named(number)

    def state(self) -> dict | None:
        return self.manifest().state

    def state_table(self) -> DataFrame:
        """The state as a table of one row, or of none before the first sync."""
        state = self.state()
        return self.spark.createDataFrame([state] if state else [], schemas.STATE)

    def _batch_rows(self, held: Manifest, table: str, parts) -> list[DataFrame]:
        """Of each batch the rows of these parts that the parts do not hold yet, with its version as _v."""
        out = []
        for batch in held.batches:
            late = [p for p in parts if p.version < batch.version]
            if late:
                rows = self.spark.read.schema(_FIELDS[table]).parquet(f"{self.root}/{batch.folder}/{table}")
                out.append((rows if len(late) == len(held.parts) else rows.where(_inside(late))).withColumn("_v", F.lit(batch.version)))
        return out

    def _part_rows(self, table: str, parts) -> DataFrame:
        """What the files of these parts hold, without the batches."""
        paths = [f"{self.root}/{p.folder}/{table}/part={p.value}" for p in parts]
        # a part without rows has no folder
        there = [f for f, p in zip(paths, parts) if p.rows and self._listed(f.removeprefix(f"{self.root}/"))]
        return self.spark.read.schema(_FIELDS[table]).parquet(*there) if there else self.spark.createDataFrame([], _FIELDS[table])

    def _rows(self, held: Manifest, parts=None) -> tuple[DataFrame, DataFrame]:
        """Both tables, or what some parts hold of them, with the columns they are stored with; only parts that lag meet the batches."""
        parts = held.parts if parts is None else parts
        lagging = [p for p in parts if any(p.version < b.version for b in held.batches)]
        newest = reduce(DataFrame.unionByName, self._batch_rows(held, "documents", lagging)).groupBy("doc_id").agg(F.max("_v").alias("_newest")) if lagging else None
        out = []
        for table, schema in _FIELDS.items():
            rows = self._part_rows(table, [p for p in parts if p not in lagging])
            if lagging:
                late = reduce(DataFrame.unionByName, self._batch_rows(held, table, lagging), self._part_rows(table, lagging).withColumn("_v", F.lit(0)))
                late = late.join(newest, "doc_id", "left").where("_newest is null or _v = _newest").select(*_columns(schema))
                rows = late if len(lagging) == len(parts) else rows.unionByName(late)
            out.append(rows.where("gone is null") if table == "documents" else rows)
        return tuple(out)

    def _versions(self, held: Manifest, parts) -> tuple[DataFrame, DataFrame]:
        """All versions of what these parts and the batches have of both tables, as _v; a batch's headers stand among the lines too, with _mark."""
        batches = {table: self._batch_rows(held, table, parts) for table in _FIELDS}
        out = [reduce(DataFrame.unionByName, batches[table], self._part_rows(table, parts).withColumn("_v", F.lit(0))).withColumn("_mark", F.lit(False)) for table in _FIELDS]
        blank = [F.lit(None).cast(out[1].schema[c].dataType).alias(c) for c in out[1].columns if c not in ("doc_id", "_v", "_mark")]
        out[1] = reduce(DataFrame.unionByName, (b.select("doc_id", "_v", F.lit(True).alias("_mark"), *blank) for b in batches["documents"]), out[1])
        return tuple(out)

    def _tables(self, held: Manifest, parts=None) -> tuple[DataFrame, DataFrame]:
        documents, lines = self._rows(held, parts)
        return documents.select(*_columns(schemas.DOCUMENTS)), lines

    def read(self) -> tuple[DataFrame, DataFrame] | None:
        """Both tables; None if nothing was ever stored."""
        held = self.manifest()
        return self._tables(held) if held.version else None

    def _parts_of(self, held: Manifest, keys: DataFrame) -> list[Part]:
        """The parts that may hold these documents."""
        finest = max((p.bits for p in held.parts), default=0)
        found = {r[0] for r in keys.select(_prefix(finest)).distinct().collect()} if finest else {0}  # not more than there are parts, about
        return [p for p in held.parts if any(x >> finest - p.bits == p.value for x in found)]

    def of_documents(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Headers and lines of these documents (column doc_id): only the parts that may hold them are read."""
        held = self.manifest()
        keys = keys.select("doc_id").distinct()
        return tuple(t.join(keys, "doc_id", "left_semi").select(*t.columns) for t in self._tables(held, self._parts_of(held, keys)))

    # -- writing -------------------------------------------------------------------------------------------------

    def _bits_for(self, rows: int) -> int:
        return max(0, -(-rows // self.part_rows) - 1).bit_length()

    def _write_parts(self, documents: DataFrame, lines: DataFrame, bits: int, base: Manifest) -> tuple[list[Part], tuple[int, int]]:
        """Writes the parts of so many bits that these rows (with the columns as stored) make up; how many of both there are.

        Of rows from `_versions` the newest of each document are written, as found where they are dealt for writing.
        """
        folder = self._new_folder(base)
        counts: dict[int, int] = {}
        totals = []
        for table, rows in (("documents", documents), ("lines", lines)):
            path = f"{self.root}/{folder}/{table}"
            kept = [*_columns(_FIELDS[table]), "part"]
            dealt = rows.withColumns({"part": _prefix(bits), "_file": F.pmod(F.xxhash64("doc_id"), F.lit(FILES))}).repartition("part", "_file")
            if "_v" in rows.columns:
                newest = F.max("_v").over(Window.partitionBy("part", "doc_id", "_file"))
                dealt = dealt.withColumn("_newest", newest).where("(doc_id is null or _v = _newest) and not _mark")
                dealt = dealt.where("gone is null") if table == "documents" else dealt
            dealt = dealt.select(*kept).sortWithinPartitions("part", "doc_id")
            dealt.write.partitionBy("part").option("parquet.bloom.filter.enabled#doc_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("compression", CODEC).parquet(path)
            found = self.spark.read.schema(f"{_FIELDS[table]}, part long").parquet(path).groupBy("part").count().collect()  # from the files' footers; a row for each part
            totals.append(sum(r["count"] for r in found))
            for r in found:
                counts[r.part] = counts.get(r.part, 0) + r["count"]
        return [Part(bits, v, folder, base.version, n) for v, n in sorted(counts.items())], tuple(totals)

    def _whole(self, parts: list[Part], bits: int, version: int) -> list[Part]:
        """`parts` and those of the same bits that have no rows, so that all documents belong to one."""
        there = {p.value for p in parts}
        return parts + [Part(bits, v, "", version, 0) for v in range(1 << bits) if v not in there]

    def _retrying(self, derive: Callable[[Manifest], Manifest]) -> Manifest:
        """Commits what `derive` makes of the newest version, anew as long as other jobs are first."""
        for _ in range(self.attempts):
            began, base = time.time(), self.manifest()
            if not base.version and self.version() is None:
                self._commit(base)  # from here on data without a manifest is a lost manifest
            try:
                made = replace(derive(base), version=base.version + 1)
            except PySparkException:
                if self.version() == base.version:
                    raise
                continue  # files of a version that is no longer the newest may be gone
            if time.time() - began < HORIZON and self._commit(made):
                self.retire()
                return made
            for folder in made.folders() - base.folders() - {""}:
                self._remove(folder)
        raise Conflict(f"{self.root}: {self.attempts} attempts to store a version came second")

    def swap(self, documents: DataFrame, lines: DataFrame, state: Callable[[int, int], dict] | None = None) -> int:
        """Stores these rows in place of all that was there.

        `state` makes the state from the number of headers and lines that are then stored; without it the state stays.
        """
        counts = lines.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_lines"))
        documents = documents.join(counts, "doc_id", "left").withColumns({"n_lines": F.coalesce("n_lines", F.lit(0)), "gone": F.lit(None).cast("boolean")})

        def derive(base: Manifest) -> Manifest:
            bits = self._bits_for(documents.count() + lines.count())
            parts, totals = self._write_parts(documents, lines, bits, base)
            return Manifest(0, tuple(self._whole(parts, bits, base.version)), (), *totals, state(*totals) if state else base.state)

        return self._retrying(derive).version

    def _written_batch(self, base: Manifest, headers: DataFrame, lines: DataFrame) -> tuple[Manifest, dict]:
        """`base` with a batch of those headers that are not older than the stored ones and their lines; sums over the headers."""
        folder = self._new_folder(base)
        touched = self._parts_of(base, headers)
        stored = self._rows(base, touched)[0].select("doc_id", F.col("modified").alias("_modified"), F.col("n_lines").alias("_lines"))
        fresh = F.col("_modified").isNull() | (F.col("modified") >= F.col("_modified"))
        live = F.col("gone").isNull()
        seen = Observation()
        sums = {
            "documents": F.count("*"), "lines": F.sum("n_lines"), "rows": F.sum(F.when(fresh, F.col("n_lines") + 1)), "stale": F.sum(F.when(fresh, 0).otherwise(1)),
            "more_documents": F.sum(F.when(fresh, live.cast("int") - F.col("_lines").isNotNull().cast("int"))), "more_lines": F.sum(F.when(fresh, F.col("n_lines") - F.coalesce("_lines", F.lit(0)))),
        }
        marked = headers.join(stored, "doc_id", "left").observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()])
        marked.where(fresh).select(*_columns(_FIELDS["documents"])).write.option("compression", CODEC).parquet(f"{self.root}/{folder}/documents")
        own = self.spark.read.schema(_FIELDS["documents"]).parquet(f"{self.root}/{folder}/documents")
        found = seen.get
        with scope(self.spark):
            taken = lines.where("doc_id is not null")
            if found["stale"]:  # only the ids of what is not taken meet the lines
                taken = taken.join(written(headers.select("doc_id").join(own.select("doc_id"), "doc_id", "left_anti")), "doc_id", "left_anti")
            taken.select(*_columns(_FIELDS["lines"])).write.option("compression", CODEC).parquet(f"{self.root}/{folder}/lines")
        batch = Batch(folder, base.version + 1, found["rows"])
        return replace(base, batches=(*base.batches, batch), documents=base.documents + found["more_documents"], lines=base.lines + found["more_lines"]), found

    def upsert(self, headers: DataFrame, lines: DataFrame, state: Callable[[dict | None, tuple[int, int], tuple[int, int]], dict] | None = None) -> tuple[int, int]:
        """Takes headers (one row for each document, with n_lines) and their lines into the tables, and gives the numbers of both.

        A header replaces a stored one, with all its lines, unless that is newer.  `state` makes the new state from the last,
        the numbers taken and the numbers then stored.
        """
        headers = headers.withColumn("gone", F.lit(None).cast("boolean"))
        taken: list[tuple[int, int]] = []

        def derive(base: Manifest) -> Manifest:
            if base.parts:
                made, found = self._written_batch(base, headers, lines)
                taken.append((found["documents"], found["lines"]))
            else:  # the first rows make up parts at once
                rows = headers.count() + lines.count()
                parts, totals = self._write_parts(headers, lines, self._bits_for(rows), base)
                made = Manifest(0, tuple(self._whole(parts, self._bits_for(rows), base.version)), (), *totals, base.state)
                taken.append(totals)
            return replace(made, state=state(base.state, taken[-1], (made.documents, made.lines))) if state else made

        self._retrying(derive)
        self.fold()
        return taken[-1]

    def remove(self, ids: DataFrame, state: Callable[[dict | None, tuple[int, int]], dict] | None = None) -> int:
        """Removes these documents (column doc_id) with their lines; how many there were."""
        gone: list[int] = []

        def derive(base: Manifest) -> Manifest:
            held = self._rows(base)[0].join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
            marks = held.select(*_columns(schemas.DOCUMENTS), F.lit(0).alias("n_lines"), F.lit(True).alias("gone"))
            made, found = self._written_batch(base, marks, self.spark.createDataFrame([], schemas.STORED_LINES))
            gone.append(found["documents"])
            return replace(made, state=state(base.state, (made.documents, made.lines))) if state else made

        self._retrying(derive)
        self.fold()
        return gone[-1]

    def fold(self) -> int | None:
        """If batches make up more than their share, writes parts anew, those that lag most first; the new version.

        If another job stores a version meanwhile, folding is left to the next one.
        """
        began, base = time.time(), self.manifest()
        room = self.fold_share * (base.documents + base.lines)
        ahead = sum(b.rows * base.waiting(b) for b in base.batches)
        if ahead <= room:
            return None
        chosen: list[Part] = []
        for part in sorted(base.parts, key=lambda p: (p.version, p.value)):
            if ahead <= room / 2:
                break
            chosen.append(part)
            ahead -= sum(b.rows for b in base.batches if part.version < b.version) * 2.0**-part.bits
        kept = [p for p in base.parts if p not in chosen]
        for bits in sorted({p.bits for p in chosen}):
            of_bits = [p for p in chosen if p.bits == bits]
            rows = max(p.rows + sum(b.rows for b in base.batches if p.version < b.version) // (1 << bits) for p in of_bits)
            deeper = bits + self._bits_for(rows)
            made, _ = self._write_parts(*self._versions(base, of_bits), deeper, base)
            there = {p.value for p in made}
            empty = [v for p in of_bits for v in range(p.value << deeper - bits, p.value + 1 << deeper - bits) if v not in there]
            kept += made + [Part(deeper, v, "", base.version, 0) for v in empty]
        after = replace(base, version=base.version + 1, parts=tuple(kept))
        after = replace(after, batches=tuple(b for b in base.batches if after.waiting(b)))
        if time.time() - began < HORIZON and self._commit(after):
            self.retire()
            return after.version
        for folder in after.folders() - base.folders() - {""}:
            self._remove(folder)
        return None

    def retire(self, keep: int = 3) -> None:
        """Removes the folders that none of the newest `keep` manifests names and no later one can name, and manifests that no job can derive from any more."""
        numbers = self._numbers()
        oldest, wanted = numbers[-keep:][0], set().union(*(self._named(n).folders() for n in numbers[-keep:]))
        for found in self._listed("data/*"):
            name = found.getPath().getName()
            if int(name[:12]) <= oldest and f"data/{name}" not in wanted:
                self._remove(f"data/{name}")
        for found in self._listed("manifests/*.json"):
            if int(found.getPath().getName()[:12]) < oldest and found.getModificationTime() / 1000 < time.time() - 2 * HORIZON:
                self._remove(f"manifests/{found.getPath().getName()}")
