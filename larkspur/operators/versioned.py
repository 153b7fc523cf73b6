"""Versioned tables: an append-only log of concrete row versions in Parquet.

A commit is one directory of row versions that becomes visible by its manifest, a file named by the version and created
without overwriting, so that of two writers of the same version the second fails; each writer has a directory of its
own, so the loser's rows are never seen. A row is (pk, op, row); op I, U or D. A snapshot keeps for each pk its
last version up to a commit: one partially aggregated group over one scan. Manifests are chained by digests of what
they list, so that a log that was changed afterwards is noticed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(Exception):
    """Another writer committed to the same rows, or the same version, first (SQLSTATE 40001)."""


class DamagedError(Exception):
    """A log or backup doesn't agree with its digests."""


class HybridClock:
    """Times that never go back: milliseconds and a counter of 16 bits."""

    def __init__(self, most_ahead_ms: int = 60_000):
        self.last, self.most_ahead_ms = 0, most_ahead_ms

    def tick(self) -> int:
        self.last = max(self.last + 1, int(time.time() * 1000) << 16)
        return self.last

    def observe(self, other: int) -> int:
        """Go on after another clock's time; one too far ahead is refused."""
        if (other >> 16) > int(time.time() * 1000) + self.most_ahead_ms:
            raise ValueError("a clock is too far ahead")
        self.last = max(self.last, other)
        return self.tick()


class Folder:
    """Small files of a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def names(self, name: str = "") -> list[str]:
        fs, where = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def exists(self, name: str = "") -> bool:
        fs, where = self._fs(name)
        return fs.exists(where)

    def create(self, name: str, content: dict) -> bool:
        """Write a file that isn't there yet; False if it is."""
        fs, where = self._fs(name)
        try:
            out = fs.create(where, False)
        except Exception:  # noqa: BLE001  py4j wraps what the file system throws
            if fs.exists(where):
                return False
            raise
        out.write(bytearray(json.dumps(content).encode("utf-8")))
        out.close()
        return True

    def read(self, name: str) -> dict | None:
        """A file's content; None if it isn't written yet."""
        fs, where = self._fs(name)
        stream = fs.open(where)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text else None

    def delete(self, name: str = "") -> None:
        fs, where = self._fs(name)
        fs.delete(where, True)


def content_digest(rows: DataFrame) -> tuple[int, str]:
    """(number of rows, digest of them whatever their order): one partially aggregated row."""
    n, total = rows.select(F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h")).agg(F.count("*"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))).first()
    return int(n), f"{int(total)}"


def _chained(before: str, version: int, digest: str) -> str:
    return hashlib.sha256(f"{before}:{version}:{digest}".encode()).hexdigest()


@dataclass
class VersionedTable:
    """A table under path; schema is that of its payload."""

    spark: SparkSession
    path: str
    schema: T.StructType
    clock: HybridClock = field(default_factory=HybridClock)

    @property
    def folder(self) -> Folder:
        return Folder(self.spark, self.path)

    def versions(self) -> list[int]:
        return [int(n) for n in self.folder.names("manifest") if not n.startswith(".")]

    def head(self) -> int:
        return max(self.versions(), default=0)

    def manifests(self, upto: int | None = None) -> dict[int, dict]:
        """What the commits up to one list, by version; a manifest without content isn't committed yet."""
        found = {v: self.folder.read(f"manifest/{v:012d}") for v in self.versions() if upto is None or v <= upto}
        return {v: m for v, m in found.items() if m}

    def _stored(self) -> T.StructType:
        return T.StructType([T.StructField("pk", T.StringType()), T.StructField("op", T.StringType()), T.StructField("row", self.schema)])

    def log(self, upto: int | None = None, after: int = 0) -> DataFrame:
        """All versions (pk, op, row, commit) of listed commits after one and up to one: one scan."""
        listed = [f"{self.path}/data/{m['data']}" for v, m in self.manifests(upto).items() if v > after]
        if not listed:
            return self.spark.createDataFrame([], self._stored().add("commit", T.LongType()))
        rows = self.spark.read.schema(self._stored()).option("basePath", f"{self.path}/data").parquet(*listed)
        return rows.select("pk", "op", "row", F.substring_index("writer", "-", 1).cast("long").alias("commit"))

    def _latest(self, upto: int | None) -> DataFrame:
        return latest(self.log(upto))

    def snapshot(self, upto: int | None = None, with_key: bool = False) -> DataFrame:
        """Rows as of a commit; by default the last."""
        rows = self._latest(upto).where("op <> 'D'")
        return rows.select("pk", "row.*") if with_key else rows.select("row.*")

    def version_at(self, when: int) -> int:
        """The last version whose commit's time isn't after a clock's time."""
        return max((v for v, m in self.manifests().items() if m["at"] <= when), default=0)

    def write(self, changes: DataFrame, version: int) -> str:
        """Rows (pk, op, row) in a directory of this writer's own; nobody sees them before publish()."""
        name = f"writer={version}-{uuid.uuid4().hex}"
        changes.select("pk", "op", "row").write.parquet(f"{self.path}/data/{name}")
        return name

    def publish(self, name: str, seen: int, note: dict | None = None) -> int:
        """Make a written directory the next version, unless its rows were changed after version seen."""
        rows = self.spark.read.schema(self._stored()).parquet(f"{self.path}/data/{name}")
        listed = self.manifests()
        version = max(listed, default=0) + 1
        try:
            if version - 1 > seen and rows.join(self.log(after=seen).select("pk"), "pk", "left_semi").limit(1).count():
                raise ConflictError(f"rows changed after version {seen}")
            n, digest = content_digest(rows)
            chain = _chained(listed[version - 1]["chain"] if version > 1 and version - 1 in listed else "", version, digest)
            data = f"writer={version}-{name.rsplit('-', 1)[1]}"
            if data != name:  # others committed other rows meanwhile
                fs, old = self.folder._fs(f"data/{name}")
                fs.rename(old, self.folder._fs(f"data/{data}")[1])
                name = data
            if not self.folder.create(f"manifest/{version:012d}", {"data": name, "rows": n, "digest": digest, "chain": chain, "at": self.clock.tick(), **(note or {})}):
                raise ConflictError(f"version {version} exists")
        except ConflictError:
            self.folder.delete(f"data/{name}")
            raise
        return version

    def changed(self, version: int) -> int:
        """Rows that a commit wrote."""
        return self.manifests()[version]["rows"]

    def begin(self, seen: int | None = None) -> "Transaction":
        return Transaction(self, self.head() if seen is None else seen)

    def _once(self, change, seen: int | None) -> int:
        with self.begin(seen) as t:
            change(t)
            return t.commit()

    def insert(self, rows: DataFrame, seen: int | None = None) -> int:
        """Append rows under fresh keys; missing columns are null, unknown ones an error."""
        return self._once(lambda t: t.insert(rows), seen)

    def update(self, values: dict[str, Column], where: Column | None = None, seen: int | None = None) -> int:
        """Write new versions of the rows that the condition holds for; no condition: of all."""
        return self._once(lambda t: t.update(values, where), seen)

    def delete(self, where: Column | None = None, seen: int | None = None) -> int:
        """Write tombstones of the rows that the condition holds for; no condition: of all."""
        return self._once(lambda t: t.delete(where), seen)

    def verify(self) -> int:
        """Check every commit's rows against its manifest, and the chain; the number of commits, or DamagedError."""
        before = ""
        for v, m in sorted(self.manifests().items()):
            n, digest = content_digest(self.spark.read.schema(self._stored()).parquet(f"{self.path}/data/{m['data']}"))
            if (n, digest) != (m["rows"], m["digest"]) or m["chain"] != _chained(before, v, digest):
                raise DamagedError(f"version {v} doesn't agree with its manifest")
            before = m["chain"]
        return len(self.versions())

    def collect_garbage(self, horizon: int, target: str) -> "VersionedTable":
        """A compacted copy at target: versions after horizon, and per key the last one up to it unless a tombstone."""
        old = self._latest(horizon).where("op <> 'D'")
        return self._copied(target, [(horizon, old)] + [(v, self.log(v, v - 1)) for v in self.versions() if v > horizon])

    def branch(self, upto: int, target: str) -> "VersionedTable":
        """A table of its own at target that begins with this one's commits up to one."""
        return self._copied(target, [(v, self.log(v, v - 1)) for v in self.versions() if v <= upto])

    def _copied(self, target: str, parts: list[tuple[int, DataFrame]]) -> "VersionedTable":
        out, before = VersionedTable(self.spark, target, self.schema, self.clock), ""
        if out.folder.exists("manifest"):
            raise FileExistsError(target)
        for v, part in parts:
            name = out.write(part, v)
            n, digest = content_digest(self.spark.read.schema(self._stored()).parquet(f"{target}/data/{name}"))
            before = _chained(before, v, digest)
            out.folder.create(f"manifest/{v:012d}", {"data": name, "rows": n, "digest": digest, "chain": before, "at": self.clock.tick()})
        return out

    def backup(self, target: str, upto: int | None = None) -> dict:
        """The rows as of a commit, with their number and digest."""
        rows = self.snapshot(upto, with_key=True)
        rows.write.parquet(f"{target}/rows")
        n, digest = content_digest(self.spark.read.schema(rows.schema).parquet(f"{target}/rows"))
        note = {"version": self.head() if upto is None else upto, "rows": n, "digest": digest, "schema": self.schema.json()}
        if not Folder(self.spark, target).create("backup.json", note):
            raise FileExistsError(target)
        return note


def verified_backup(spark: SparkSession, target: str) -> tuple[DataFrame, dict]:
    """(rows with their keys, note) of a backup that agrees with its digest; else DamagedError."""
    note = Folder(spark, target).read("backup.json") if Folder(spark, target).exists("backup.json") else None
    if not note:
        raise DamagedError("no whole backup")
    schema = T.StructType([T.StructField("pk", T.StringType()), *T.StructType.fromJson(json.loads(note["schema"])).fields])
    rows = spark.read.schema(schema).parquet(f"{target}/rows")
    if content_digest(rows) != (note["rows"], note["digest"]):
        raise DamagedError("a backup doesn't agree with its digest")
    return rows, note


def restored(spark: SparkSession, source: str, path: str) -> VersionedTable:
    """A fresh table at path with the rows of a verified backup; a path in use is refused."""
    rows, note = verified_backup(spark, source)
    out = VersionedTable(spark, path, T.StructType.fromJson(json.loads(note["schema"])))
    if out.folder.exists():
        raise FileExistsError(path)
    out.publish(out.write(rows.select("pk", F.lit("I").alias("op"), F.struct(*out.schema.names).alias("row")), 1), 0)
    return out


class Transaction:
    """Changes of one table that are seen inside at once and by others when committed, all or none.

    Reads see the table as of the version at which it began, with the own changes on top. Of two transactions that
    change a row the first to commit wins.
    """

    def __init__(self, table: VersionedTable, seen: int):
        self.table, self.seen, self._written, self._open = table, seen, [], True

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if self._open:
            self.rollback()

    def _pending(self) -> DataFrame | None:
        out = None
        for i, name in enumerate(self._written):
            rows = self.table.spark.read.schema(self.table._stored()).parquet(f"{self.table.path}/data/{name}").withColumn("commit", F.lit(self.seen + 1 + i).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def snapshot(self, with_key: bool = False) -> DataFrame:
        pending, log = self._pending(), self.table.log(self.seen)
        rows = latest(log if pending is None else log.unionByName(pending)).where("op <> 'D'")
        return rows.select("pk", "row.*") if with_key else rows.select("row.*")

    def insert(self, rows: DataFrame) -> None:
        schema = self.table.schema
        unknown = set(rows.columns) - set(schema.names)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        cells = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        key = F.concat(F.lit(f"{self.table.clock.tick():016x}-"), F.expr("uuid()"))
        self._change(rows.select(key.alias("pk"), F.lit("I").alias("op"), F.struct(*cells).alias("row")))

    def update(self, values: dict[str, Column], where: Column | None = None) -> None:
        schema = self.table.schema
        missing = set(values) - set(schema.names)
        if missing:
            raise ValueError(f"unknown columns: {sorted(missing)}")
        rows = self.snapshot(with_key=True)
        rows = rows if where is None else rows.where(where)
        cells = [(values[f.name] if f.name in values else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema]
        self._change(rows.select("pk", F.lit("U").alias("op"), F.struct(*cells).alias("row")))

    def delete(self, where: Column | None = None) -> None:
        rows = self.snapshot(with_key=True)
        rows = rows if where is None else rows.where(where)
        self._change(rows.select("pk", F.lit("D").alias("op"), F.struct(*[F.col(f"`{n}`") for n in self.table.schema.names]).alias("row")))

    def apply(self, changes: DataFrame) -> None:
        """Concrete changes (pk, op, row), one for each key."""
        self._change(changes)

    def _change(self, rows: DataFrame) -> None:
        if not self._open:
            raise RuntimeError("the transaction has ended")
        self._written.append(self.table.write(rows, self.seen + 1))

    def commit(self, note: dict | None = None) -> int:
        """The new version; nothing changed: the version it began at."""
        if not self._open:
            raise RuntimeError("the transaction has ended")
        self._open = False
        if not self._written:
            return self.seen
        name = self._written[0]
        if len(self._written) > 1:
            name = self.table.write(latest(self._pending()), self.seen + 1)
            for old in self._written:
                self.table.folder.delete(f"data/{old}")
        return self.table.publish(name, self.seen, note)

    def rollback(self) -> None:
        self._open = False
        for name in self._written:
            self.table.folder.delete(f"data/{name}")


def latest(log: DataFrame) -> DataFrame:
    """The last version (pk, op, row, commit) of each key: partially aggregated, no key's versions are gathered."""
    return log.groupBy("pk").agg(F.max_by(F.struct("op", "row", "commit"), "commit").alias("v")).select("pk", "v.*")


def latest_versions(log: DataFrame, key: str, version: str, upto: int) -> DataFrame:
    """The last version of each key up to one, of a log with column op; tombstones (D) hide their key."""
    payload = [c for c in log.columns if c != key]
    last = log.where(F.col(version) <= upto).groupBy(key).agg(F.max_by(F.struct(*payload), version).alias("v"))
    return last.select(key, "v.*").where("op <> 'D'")
