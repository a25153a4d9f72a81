"""A table in versions: rows bucketed by a key, changes beside their base, merged when they are read, committed by compare and swap.

A segment is what one build writes: rows below rows/segment=<id>/bucket=<n>, and the keys that it
speaks for below keys/ in the same way. A version is one small file that lists, for each bucket, the
segments that count and in what order. A key's rows are those of the last segment that has the key; a
segment that has a key without rows has deleted it. So a build that changes one key writes to that key's
bucket alone, and nothing else is copied. A bucket whose changes outgrow its base is written anew, merged.

A version is committed under the number after its parent's, by a step that fails if that number is
there: a hard link on a local disk, elsewhere a rename that doesn't overwrite, which is atomic on HDFS
(object stores without such a rename need a lock beside this). Whoever loses starts from the winner.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.sources.work import file_system

BUCKETS = 16
#: A bucket is written anew when its changes have more bytes than this share of its base and than SMALL, or more segments than MOST.
SHARE, SMALL, MOST = 0.3, 1 << 20, 16
#: Changed keys of so many bytes (as files) are sent to every task; more are joined by key.
BROADCAST_BYTES = 8 << 20
#: Versions that stay: the current one and one that a reader may still have open.
KEPT = 2


@dataclass
class Part:
    """A bucket of a segment; base: nothing before it counts."""

    segment: str
    bucket: int
    order: int
    base: bool
    bytes: int
    key_bytes: int


@dataclass
class Version:
    number: int
    schema: int
    parts: list[Part] = field(default_factory=list)
    facts: dict = field(default_factory=dict)


@dataclass
class Store:
    """schema: the rows' columns (DDL), within: columns of them that folders are made of below the bucket."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    within: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def numbers(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def version(self, number: int | None = None) -> Version | None:
        """A version, or the last one."""
        found = self.numbers() if number is None else [number]
        if not found:
            return None
        fs, at = file_system(self.spark, f"{self.path}/versions/{found[-1]}")
        stream = fs.open(at)
        try:
            read = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(read["number"], read["schema"], [Part(**p) for p in read["parts"]], read["facts"])

    def commit(self, version: Version) -> bool:
        """Whether the version could be put under its number. Older ones than the last KEPT go, with the segments that none of the others has."""
        fs, aside = file_system(self.spark, f"{self.path}/staged/{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        _, at = file_system(self.spark, f"{self.path}/versions/{version.number}")
        fs.mkdirs(at.getParent())
        try:
            won = self._put(fs, aside, at)
        finally:
            fs.delete(aside, False)
        if won:
            self._clear()
        return won

    def _put(self, fs, aside, at) -> bool:
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(at), local(aside))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, at, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _clear(self) -> None:
        numbers = self.numbers()
        keep = {p.segment for n in numbers[-KEPT:] for p in self.version(n).parts}
        gone = {p.segment for n in numbers[:-KEPT] for p in self.version(n).parts} - keep
        for s in gone:
            self.drop(s)
        for n in numbers[:-KEPT]:
            fs, at = file_system(self.spark, f"{self.path}/versions/{n}")
            fs.delete(at, False)

    def drop(self, segment: str) -> None:
        for kind in ("rows", "keys"):
            fs, at = file_system(self.spark, f"{self.path}/{kind}/segment={segment}")
            fs.delete(at, True)

    def bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def segment(self, rows: DataFrame, keys: DataFrame, base: bool, order: int) -> list[Part]:
        """Writes a segment: rows, and keys (those of the rows and those that are deleted)."""
        name = uuid.uuid4().hex
        by = ["bucket", *self.within]
        self.bucket(rows).hint("rebalance", *by).write.partitionBy(*by).parquet(f"{self.path}/rows/segment={name}")
        self.bucket(keys.select(self.key).distinct()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/segment={name}")
        sizes = [self._sizes(f"{self.path}/{kind}/segment={name}") for kind in ("rows", "keys")]
        return [Part(name, b, order, base, sizes[0].get(b, 0), sizes[1].get(b, 0)) for b in sorted({*sizes[0], *sizes[1]})]

    def _sizes(self, path: str) -> dict[int, int]:
        fs, at = file_system(self.spark, path)
        return {int(f.getPath().getName().split("=")[1]): fs.getContentSummary(f.getPath()).getLength() for f in fs.listStatus(at) if f.getPath().getName().startswith("bucket=")}

    def _table(self, kind: str, parts: Iterable[Part], schema: str) -> DataFrame | None:
        """The parts that have files, with their order."""
        paths, order = [], {}
        for p in parts:
            if p.bytes if kind == "rows" else p.key_bytes:
                paths.append(f"{self.path}/{kind}/segment={p.segment}/bucket={p.bucket}")
                order[p.segment] = p.order
        if not paths:
            return None
        of = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
        return self.spark.read.schema(f"{schema}, segment string, bucket int").option("basePath", f"{self.path}/{kind}").parquet(*paths).withColumn("_order", of[F.col("segment")])

    def read(self, version: Version, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: each key's last ones."""
        empty = self.spark.createDataFrame([], self.schema)
        parts = [p for p in version.parts if buckets is None or p.bucket in buckets]
        rows = self._table("rows", parts, self.schema)
        if rows is None:
            return empty
        later = [p for p in parts if not p.base]
        changed = self._table("keys", later, f"{self.key} {dict(empty.dtypes)[self.key]}")
        if changed is not None:
            last = changed.groupBy(F.col(self.key).alias("_key")).agg(F.max("_order").alias("_last"))
            if sum(p.key_bytes for p in later) <= BROADCAST_BYTES:
                last = F.broadcast(last)
            rows = rows.join(last, (F.col(self.key) == F.col("_key")) & (F.col("_order") < F.col("_last")), "left_anti")
        return rows.select(*empty.columns)

    def after(self, old: Version | None, schema: int, rows: DataFrame, keys: DataFrame, facts: dict, anew: bool = False) -> Version:
        """The version after old, with rows in place of all that keys had; without old, or anew, a base of these rows. Buckets whose changes have outgrown their base are merged."""
        number, before = (old.number + 1 if old else 0), (old.parts if old and not anew else [])
        fresh = self.segment(rows, keys, base=not before, order=number)
        parts = before + fresh
        new = Version(number, schema, parts, facts)
        due = {b for b in {p.bucket for p in parts} if self._outgrown([p for p in parts if p.bucket == b])}
        if due:
            merged = self.read(new, due)
            new.parts = [p for p in parts if p.bucket not in due] + self.segment(merged, merged, base=True, order=number)
            for segment in {p.segment for p in fresh} - {p.segment for p in new.parts}:
                self.drop(segment)  # merged already
        return new

    @staticmethod
    def _outgrown(parts: list[Part]) -> bool:
        base, changes = (sum(p.bytes for p in parts if p.base == b) for b in (True, False))
        return len(parts) > 1 and (changes > max(SMALL, SHARE * base) or len(parts) > MOST)
