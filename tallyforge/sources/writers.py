"""Sinks: window archives, integrity-checked maps, JSON lines, CSV, and a fail-soft metrics sink for streams."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_archive(records: DataFrame, path: str) -> None:
    """One gzipped JSON object a window, in a folder of its own; a window that exists is replaced whole."""
    spark = records.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        keyed = records.withColumn("window", F.col("window_start")).repartition("window")
        keyed.write.mode("overwrite").partitionBy("window").option("compression", "gzip").json(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Gzipped JSON lines."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_pool(rows: DataFrame, path: str) -> None:
    """Pool entries by environment; the commit protocol makes the write atomic."""
    rows.write.mode("append").partitionBy("env_name").parquet(path)


def seal_map(entries: dict[str, Any], key: bytes) -> str:
    """Canonical JSON of a map with its HMAC under _hmac."""
    body = json.dumps(entries, sort_keys=True, separators=(",", ":"))
    return json.dumps(entries | {"_hmac": hmac.new(key, body.encode(), hashlib.sha256).hexdigest()}, sort_keys=True)


def open_map(text: str, key: bytes) -> dict[str, Any]:
    """The map of a sealed text; empty if anything about it is wrong."""
    try:
        entries = json.loads(text)
        tag = entries.pop("_hmac")
    except (ValueError, KeyError, AttributeError, TypeError):
        return {}
    body = json.dumps(entries, sort_keys=True, separators=(",", ":"))
    return entries if hmac.compare_digest(tag, hmac.new(key, body.encode(), hashlib.sha256).hexdigest()) else {}


def metrics_sink(log: Callable[[dict[str, Any]], None], warn: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that logs a batch's one metrics row; it warns once and never fails the stream."""
    state = {"warned": False}

    def sink(batch: DataFrame, epoch: int) -> None:
        try:
            row = batch.first()
            if row is not None:
                log(row.asDict() | {"epoch": epoch})
        except Exception as error:  # noqa: BLE001 - a sink of metrics must not end a stream
            if not state["warned"]:
                state["warned"] = True
                warn(f"metrics are not logged: {error}")

    return sink


def delete_path(spark: SparkSession, path: str) -> bool:
    """Idempotent delete through the file system of the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def manifest(rows: DataFrame) -> DataFrame:
    """Checkpoint manifests: the latest revision of each number."""
    return rows.groupBy("checkpoint_n").agg(F.max_by(F.struct("repo_id", "revision", "signature"), "published").alias("m")).select("checkpoint_n", "m.repo_id", "m.revision", "m.signature")
