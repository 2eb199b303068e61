"""Structured Streaming forms whose state ends by a watermark or a timeout: claims, sealing, one firing a window; and how streams are run.

Every function takes a streaming DataFrame and returns one. Operators whose state starts from archives and ends by timers are in
``stateful``. The batch operators give the same results on the same rows, which the tests check.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.config import DEFAULT, EngineConfig
from tallyforge.session import ensure_checkpoint_dir


def on_window(stream: DataFrame, window: str, current: str = "current_window") -> DataFrame:
    """Adds late: rows for another window than the current one are rejected, never merged."""
    return stream.withColumn("late", F.col(window) != F.col(current))


def claims(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First valid row of each window and prompt; the watermark only evicts state."""
    valid = stream.where("valid")
    return valid.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["window_n", "prompt_idx"])


def sealed_windows(stream: DataFrame, config: EngineConfig = DEFAULT, timeout: str = "7200 seconds") -> DataFrame:
    """(window_n, sealed_at, n, reason): a window seals when it holds batch_size distinct prompts, or on timeout.

    State: the prompts seen so far, batch_size at most. Rows after the seal change nothing.
    """
    b = config.batch_size
    millis = int(timeout.split()[0]) * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, sealed, last = state.get if state.exists else ([], False, 0.0)
        seen = list(seen)
        if state.hasTimedOut:
            state.remove()
            if not sealed:
                yield pd.DataFrame([(key[0], last, len(seen), "timeout")], columns=["window_n", "sealed_at", "n", "reason"])
            return
        rows = pd.concat(list(batches)).sort_values(["arrived_at", "ord"])
        for prompt, at in zip(rows["prompt_idx"], rows["arrived_at"]):
            if sealed:
                break
            last = float(at)
            if int(prompt) not in seen:
                seen.append(int(prompt))
            if len(seen) >= b:
                sealed = True
                yield pd.DataFrame([(key[0], last, len(seen), "full")], columns=["window_n", "sealed_at", "n", "reason"])
        state.update((seen, sealed, last))
        state.setTimeoutDuration(millis)

    return stream.where("valid").groupBy("window_n").applyInPandasWithState(step, "window_n bigint, sealed_at double, n bigint, reason string", "seen array<bigint>, sealed boolean, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fired_once(stream: DataFrame, delay: str = "64 hours") -> DataFrame:
    """One row per window: later ones within the retained time are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["window_n"])


def capped_source(spark, path: str, schema: str, files: int = 1, format: str = "parquet"):  # noqa: ANN001, ANN201, A002
    """A file stream with back-pressure: at most ``files`` new files a trigger."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", str(files)).load(path)


def landed(stream: DataFrame, name: str, empty_batches: bool = True, **conf: str) -> DataFrame:
    """Runs what is there to its end into a table under the shared checkpoint folder, with a stream checkpoint of its own.

    ``conf`` holds session settings (dots as double underscores) that the query starts with. Without ``empty_batches`` no batch runs for the
    sake of time alone, which a processing-time timeout would make follow each other for ever.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    wanted = {k.replace("__", "."): v for k, v in conf.items()} | ({} if empty_batches else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run what is there to its end into a memory table, for tests and demonstrations.

    Batches without data are off meanwhile: with a processing-time timeout they would follow each other for ever.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.table(name)
