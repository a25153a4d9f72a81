"""Shared helpers: word splitting and fingerprints over Arrow text columns, table sizes, the shared work folder.

Words are compared by 64-bit fingerprints. Each byte of a stretch of 64 adds a random number that
depends on the byte and its place; the sums of the later stretches of a longer word are mixed with
the stretch's number before they are added, so no order or repetition of stretches cancels out. Two
different words meet with a probability of about 2^-64.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of text that one group of a shuffle is sized for.
GROUP_BYTES = 16 << 20

#: Arrays of more bytes go back to the system as soon as they are freed, so that a worker, which Spark uses again, doesn't keep what its largest step needed.
RETURN_BYTES = 4 << 20
if hasattr(ctypes.CDLL(None), "mallopt"):  # of the GNU C library; -3 names the size from which blocks are mapped on their own
    ctypes.CDLL(None).mallopt(-3, RETURN_BYTES)

PLACES = 64
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.cache
def byte_numbers() -> np.ndarray:
    """A random 64-bit number for each place in a word (64 of them) and byte."""
    return np.random.default_rng(20240501).integers(0, 2**64, PLACES * 256, dtype=np.uint64)


@functools.cache
def odd_numbers(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits over all 64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(own: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A fingerprint for each word, from the words' bytes end to end and their lengths (1 at least)."""
    if not len(lens):
        return np.empty(0, np.uint64)
    at = np.cumsum(lens) - lens
    place = np.arange(len(own), dtype=np.int64) - np.repeat(at, lens)
    values = byte_numbers()[((place & (PLACES - 1)) << 8) | own]
    if lens.max() > PLACES:
        begin = np.flatnonzero((place & (PLACES - 1)) == 0)
        number = (place[begin] // PLACES).astype(np.uint64)
        sums = np.add.reduceat(values, begin)
        later = number > 0
        sums[later] = mix(mix(sums[later]) + mix(number[later]))
        total = np.add.reduceat(sums, np.searchsorted(begin, at))
    else:
        total = np.add.reduceat(values, at)
    return mix(total + lens.astype(np.uint64))


class Words:
    """The words of some texts, end to end.

    data: the bytes; start, end: byte places of each word; first: for each text the number of
    its first word, and at the end the number of words; hash: each word's fingerprint.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, between: np.ndarray):
        self.data, self.bounds = data, bounds
        inside = ~between[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[edge[:n]] = False
            after[edge[1:]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return fingerprints(self.data[self._inside], self.end - self.start)

    @functools.cached_property
    def text_of(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of n consecutive words of one text each, and the number of the first word."""
        h, m = self.hash, len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        odd = odd_numbers(n)
        total = h[:m] * odd[0]
        for j in range(1, n):
            total = total + h[j : j + m] * odd[j]
        at = np.flatnonzero(self.text_of[:m] == self.text_of[n - 1 : n - 1 + m])
        return mix(total[at]), at


def columns(batch: pa.RecordBatch, lower: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The column text of a batch in steps: rows, bytes, and where each text begins (one more at the end). Null is empty."""
    text = batch.column("text").cast(pa.large_binary())
    size = len(text)
    if not size:
        return
    _, places, raw = text.buffers()
    where = np.frombuffer(places, np.int64)[text.offset : text.offset + size + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    if text.null_count:
        lens = np.where(np.asarray(text.is_valid()), np.diff(where), 0)
    else:
        lens = np.diff(where)
    row = 0
    while row < size:
        to = max(row + 1, int(np.searchsorted(where, where[row] + STEP_BYTES, "right")) - 1)
        to = min(to, size)
        own = data[where[row] : where[to]]
        bounds = where[row : to + 1] - where[row]
        if text.null_count and (lens[row:to] != np.diff(bounds)).any():  # a null may cover bytes
            own = np.concatenate([data[where[i] : where[i] + lens[i]] for i in range(row, to)])
            bounds = np.concatenate([[0], np.cumsum(lens[row:to])])
        yield slice(row, to), LOWER[own] if lower else own, bounds
        row = to


def ids_of(batch: pa.RecordBatch, rows: slice, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table has; a row without doc_id has no place in any result."""
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts: what groups are sized by."""
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def groups_for(df: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """So many groups that each holds what group_bytes of text give rise to."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(df) // group_bytes), 1)


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share. Only where that is unset, as in local tests, one is set here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = kept.get() if kept.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later jobs neither repeat its work nor need its executors."""
    path = folder or work_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def names(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names hold."""
    return [named(c) for c in df.columns]


def named(name: str, of: str = "") -> Column:
    """A column, or a field of the struct of, by its exact name."""
    return F.col(of + "`" + name.replace("`", "``") + "`")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return named(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
