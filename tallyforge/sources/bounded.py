"""Files of unknown senders within bounds, and scans that are remembered."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import readers, writers

CAP, RATIO = 350_000_000, 20


def gunzip_within(data: bytes, limit: int) -> bytes | None:
    """What a gzip file holds, None if that is more than ``limit`` bytes or the file is broken. No more than that is ever expanded."""
    out: list[bytes] = []
    left = limit
    while data:
        member = zlib.decompressobj(31)
        try:
            part = member.decompress(data, left + 1)
        except zlib.error:
            return None
        left -= len(part)
        if left < 0 or not member.eof:
            return None
        out.append(part)
        data = member.unused_data
    return b"".join(out)


def _expanded(cap: int, ratio: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):  # one file at a time in memory
                batch = whole.slice(k, 1)
                data, path = batch.column("content")[0].as_py(), batch.column("path")[0].as_py()
                body = gunzip_within(data, min(cap, ratio * len(data))) if path.endswith(".gz") else data
                try:
                    text = body.decode() if body is not None else None
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("modified"), pa.array([text], pa.string())], names=["path", "modified", "body"])

    return work


def rollout_files(spark: SparkSession, path: str, schema: str, cap: int = CAP, ratio: int = RATIO) -> DataFrame:
    """(path, modified, rollouts) of every file below a path: null rollouts where the file is over the cap, expands to more than
    ``ratio`` times its size, is broken or is no JSON list of the schema. Files over the cap are not read; files of no bytes are not listed, as the reader leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.select("path", F.col("modificationTime").alias("modified"))
    read = files.where(F.col("length") <= cap).select("path", F.col("modificationTime").alias("modified"), "content")
    texts = read.mapInArrow(_expanded(cap, ratio), "path string, modified timestamp, body string")
    parsed = F.when(F.col("body").rlike(r"^\s*\["), F.from_json("body", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"}))
    return listed.join(texts.select("path", parsed.alias("rollouts")), "path", "left")


def scan_key(spark: SparkSession, files: list[str], column: str, allowed: list[str]) -> str:
    """A digest of what a scan reads: each file's name, length and time, the column, and the values."""
    marks = []
    for name in files:
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        marks.append([name, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps([sorted(marks), column, sorted(allowed)]).encode()).hexdigest()


def eligible_remembered(spark: SparkSession, path: str, column: str, allowed: list[str], memo: str, max_files: int | None = None) -> DataFrame:
    """``readers.eligible_indices``, kept below ``memo`` under the digest of the scan; the same scan again reads no data file.

    A file that changes or is added makes another scan of it. A memo that was only begun is written again.
    """
    files = readers.first_files(spark, path, max_files) if max_files is not None else sorted(spark.read.parquet(path).inputFiles())
    kept = f"{memo.rstrip('/')}/{scan_key(spark, files, column, allowed)}"
    if not writers.path_exists(spark, f"{kept}/_SUCCESS"):
        readers.eligible_indices(spark, path, column, allowed, max_files).write.mode("overwrite").parquet(kept)
    return spark.read.schema("idx bigint").parquet(kept)
