"""Pluggable models: encoders of texts and language models, called in Arrow batches, with offline defaults."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespan.sources.folder import place

#: Texts to vectors of one length.
Encoder = Callable[[list[str]], np.ndarray]
WORDS = re.compile(r"\w+").findall
DIMENSIONS = 256
BATCH = 256


def encoded(rows: DataFrame, encoder: Encoder | None = None, text: str = "document") -> DataFrame:
    """rows with embedding (array of float), made batch by batch where the rows are."""
    schema = rows.schema.simpleString()[len("struct<") : -1]
    names, encoder = rows.columns, encoder or word_cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                own = batch.slice(at, BATCH)
                v = np.asarray(encoder([x or "" for x in own.column(text).to_pylist()]), np.float32)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=[*names, "embedding"])

    return rows.mapInArrow(run, f"{schema}, embedding array<float>")


def word_cells(texts: list[str]) -> np.ndarray:
    """The offline encoder: words hashed into DIMENSIONS cells, counted, and scaled to length 1. It is lexical, and no transformer; texts without words are zero."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        cells = [zlib.crc32(w.encode()) % DIMENSIONS for w in WORDS(text.lower())]
        if cells:
            row += np.bincount(cells, minlength=DIMENSIONS)
            row /= np.sqrt((row * row).sum())
    return out


def word_counts(texts: list[str]) -> np.ndarray:
    """Words counted by the first byte of their MD5: whole numbers, so cosines are exact and SQL can say the same."""
    out, known = np.zeros((len(texts), DIMENSIONS), np.float32), {}
    for row, text in zip(out, texts, strict=True):
        cells = [known.get(w) if w in known else known.setdefault(w, hashlib.md5(w.encode()).digest()[0]) for w in WORDS(text.lower())]
        if cells:
            row += np.bincount(cells, minlength=DIMENSIONS)
    return out


class Busy(Exception):
    """The server has too much to do (status 429, or a time-out), and says after how many seconds to ask again, if it does."""

    def __init__(self, retry_after: float | None = None):
        super().__init__(retry_after)
        self.retry_after = retry_after


#: Times that a busy server is asked, and seconds before the second time; each later wait is twice as long.
TIMES, WAIT = 5, 2.0


def patient(model: Callable[[str], Iterator[str]], prompt: str, times: int = TIMES, wait: float = WAIT) -> list[str]:
    """The whole answer to a prompt. A busy server is asked again, after as long as it says or twice as long each time; any other error isn't held back."""
    for n in range(times):
        try:
            return list(model(prompt))
        except Busy as e:
            if n == times - 1:
                raise
            time.sleep(wait * 2**n if e.retry_after is None else e.retry_after)
    return []


def asked_once(requests: DataFrame, model: Callable[[str], Iterator[str]], folder: str, times: int = TIMES, wait: float = WAIT) -> DataFrame:
    """request, seq and line for every line of the answer to each prompt (request, prompt), as answered(); but no prompt that has an answer in folder is asked again.

    folder is on shared storage. Each different prompt is asked once, whoever has it, and its whole answer is
    written under the prompt's digest as soon as it is there, aside and then renamed. So a task, a job or a run that is
    repeated asks only what has no answer yet, and all requests see the same answers. Speculation should be off,
    as two attempts at one time may both ask; the first answer written stays.
    """
    spark = requests.sparkSession
    own = requests.select(F.col("request").cast("string"), F.coalesce(F.col("prompt").cast("string"), F.lit("")).alias("prompt")).withColumn("digest", F.sha2("prompt", 256))
    system, path = place(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        for batch in batches:
            for digest, prompt in zip(batch.column("digest").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                at = f"{path}/{digest}.json"
                if system.get_file_info(at).type == fs.FileType.NotFound:
                    said = json.dumps({"digest": digest, "lines": patient(model, prompt, times, wait)})
                    aside = f"{path}/_{digest}.{uuid.uuid4().hex}"
                    with system.open_output_stream(aside) as f:
                        f.write(said.encode())
                    if system.get_file_info(at).type == fs.FileType.NotFound:
                        system.move(aside, at)
                    else:
                        system.delete_file(aside)
            yield pa.RecordBatch.from_arrays([batch.column("digest")], names=["digest"])

    read = lambda: spark.read.schema("digest string, lines array<string>").option("pathGlobFilter", "*.json").json(folder)
    todo = own.select("digest", "prompt").dropDuplicates(["digest"]).join(read().select("digest"), "digest", "left_anti")
    todo.mapInArrow(run, "digest string").write.format("noop").mode("overwrite").save()
    return own.join(read(), "digest").select("request", F.posexplode("lines").alias("seq", "line")).select("request", F.col("seq").cast("long"), "line")


def answered(requests: DataFrame, model: Callable[[str], Iterator[str]], columns: str) -> DataFrame:
    """request and line for every line that the model streams back to each prompt. A task that is repeated asks again; asked_once() doesn't.

    columns: the name of the prompt's column; requests has request and it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, prompt in zip(batch.column("request").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                lines = list(model(prompt or ""))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["request", "seq", "line"])

    return requests.select(F.col("request").cast("string"), F.col(columns).cast("string").alias("prompt")).mapInArrow(run, "request string, seq long, line string")
