"""Keyed state with a life: cooldown, moving averages and flushes that start from archives and evict themselves.

Each is a ``transformWithStateInPandas`` operator in event time. State is bounded by timers: an entry that can no longer
change any answer is dropped when the watermark passes its end, so the number of entries follows the windows within reach and not
the stream's age. Rows older than the watermark do not reach the operators, and rows that are late for their key (an
earlier step than the key's last) change nothing. ``initial`` is a batch table made from archive records, so a stream
that starts from an archive goes on as if it had never stopped.

Cooldown and averages count windows and records, not hours, so their event time is logical: a window or record is a second
(``EPOCH`` seconds after 1970, as a watermark starts there), and ``late`` windows or records may still arrive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyforge.config import DEFAULT, EngineConfig
from tallyforge.operators import scoring, state
from tallyforge.streaming import windows

#: The state store that keeps state by variable and key, which these operators need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
#: Seconds before the first window in logical time.
EPOCH = 86_400


def _millis(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


class _Timed(StatefulProcessor):
    """State ``entry`` with one live timer: setting a new end drops the old one."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", self.schema)
        self.end = handle.getValueState("end", "at bigint")

    def live_until(self, at: int) -> None:
        if self.end.exists():
            before = self.end.get()[0]
            if before == at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.end.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.entry.clear()
        self.end.clear()
        return iter([])

    def close(self) -> None:
        """Nothing is open."""


class Cooldown(_Timed):
    """Rows (prompt_idx, window_n, batched); state: the window in which the prompt was last batched, for ``n`` windows."""

    schema = "last bigint"
    output = "prompt_idx bigint, window_n bigint, cooling boolean"

    def __init__(self, n: int) -> None:
        self.n = n

    def _batched(self, window: int) -> None:
        self.entry.update((window,))
        self.live_until((EPOCH + window + self.n) * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        self._batched(int(initialState["last_window"].max()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.entry.get()[0] if self.entry.exists() else None
        out = []
        for window, batched in pd.concat(list(rows)).sort_values("window_n")[["window_n", "batched"]].itertuples(index=False):
            cooling = last is not None and 0 <= int(window) - last < self.n
            out.append((key[0], int(window), cooling))
            if batched and not cooling and (last is None or int(window) > last):
                last = int(window)
                self._batched(last)
        yield pd.DataFrame(out, columns=["prompt_idx", "window_n", "cooling"])


class MovingAverage(_Timed):
    """Rows (hotkey, step, n); state: the score and the step it belongs to, until it has decayed to nothing.

    Steps that a key misses are a power of (1 - alpha). A row whose step is not after the key's last one does not tick.
    """

    schema = "value double, last bigint"
    output = "hotkey string, step bigint, score double"

    def __init__(self, config: EngineConfig) -> None:
        self.alpha, self.prune, self.size = config.ema_alpha, config.ema_prune, config.batch_size

    def _scored(self, value: float, last: int) -> None:
        if value <= self.prune:
            self.entry.clear()
            return
        self.entry.update((value, last))
        steps = math.ceil(math.log(self.prune / value) / math.log(1 - self.alpha)) + 1  # by then it is below the threshold
        self.live_until((EPOCH + last + steps) * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        row = initialState.sort_values("last").iloc[-1]
        self._scored(float(row["value"]), int(row["last"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        value, last = self.entry.get() if self.entry.exists() else (0.0, None)
        out = []
        every = pd.concat(list(rows)).groupby("step", as_index=False)["n"].sum().sort_values("step")
        for step, n in every.itertuples(index=False):
            if last is not None and int(step) <= last:
                continue
            missed = int(step) - last - 1 if last is not None else 0
            if missed:
                value *= (1 - self.alpha) ** missed
                value = value if value > self.prune else 0.0
            value = self.alpha * (float(n) / self.size) + (1 - self.alpha) * value
            value, last = (value if value > self.prune else 0.0), int(step)
            self._scored(value, last)
            out.append((key[0], last, value))
        yield pd.DataFrame(out, columns=["hotkey", "step", "score"])


class FlushOnChange(_Timed):
    """Rows (key, ord, value, checkpoint, ts); state: the current value and its rows so far, for ``idle`` seconds after the last one.

    When the value changes, the old one is flushed with its count. When the checkpoint changes, what was gathered under the old one is
    dropped without a flush. A key that stays idle is flushed as its state ends.
    """

    schema = "value string, checkpoint string, n bigint"
    output = "key string, flushed string, n bigint, why string"

    def __init__(self, idle: float) -> None:
        self.idle = idle

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "flushed", "n", "why"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        value, checkpoint, n = self.entry.get() if self.entry.exists() else (None, None, 0)
        out, every = [], pd.concat(list(rows)).sort_values("ord")
        for new, at in every[["value", "checkpoint"]].itertuples(index=False):
            if checkpoint is not None and at != checkpoint:
                value, n = None, 0
            if value is not None and new != value:
                out.append((str(key[0]), value, n, "change"))
                n = 0
            value, checkpoint, n = new, at, n + 1
        self.entry.update((value, checkpoint, n))
        self.live_until(_millis(every["ts"].max()) + int(self.idle * 1000))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.entry.exists():
            value, _, n = self.entry.get()
            yield self._frame([(str(key[0]), value, n, "idle")])
        self.entry.clear()
        self.end.clear()


def _transformed(stream: DataFrame, key: str, processor: StatefulProcessor, delay: str, initial: DataFrame | None, mode: str) -> DataFrame:
    """The operator over a stream with a watermark; its query has to start with ``PROVIDER`` as state store, as ``landed`` below does."""
    grouped = stream.withWatermark("ts", delay).groupBy(key)
    start = initial.groupBy(key) if initial is not None else None
    return grouped.transformWithStateInPandas(processor, processor.output, mode, "EventTime", start)


def _logical(stream: DataFrame, count: str) -> DataFrame:
    """Adds the logical event time of a window's or record's number."""
    return stream.withColumn("ts", F.timestamp_seconds(F.col(count) + EPOCH))


def cooled(stream: DataFrame, n: int, late: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """(prompt_idx, window_n, cooling) of rows (prompt_idx, window_n, batched); a prompt cools for n windows after it was batched."""
    if n < 0:
        raise ValueError("the number of windows is not negative")
    return _transformed(_logical(stream, "window_n"), "prompt_idx", Cooldown(n), f"{late} seconds", initial, "Append")


def running_ema(slots: DataFrame, late: int = 0, initial: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(hotkey, step, score) after each record in which a key holds slots; rows (hotkey, step, n)."""
    return _transformed(_logical(slots, "step"), "hotkey", MovingAverage(config), f"{late} seconds", initial, "Append")


def flushed(stream: DataFrame, idle: float, delay: str = "0 seconds") -> DataFrame:
    """(key, flushed, n, why) of rows (key, ord, value, checkpoint, ts)."""
    return _transformed(stream, "key", FlushOnChange(idle), delay, None, "Append")


def landed(stream: DataFrame, name: str) -> DataFrame:
    """``windows.landed`` with the state store that these operators need."""
    return windows.landed(stream, name, **{PROVIDER_KEY.replace(".", "__"): PROVIDER})


def cooldown_start(batch: DataFrame, current: int, n: int) -> DataFrame:
    """Initial state of ``cooled``: from archived batch rows (window_n, prompt_idx), the prompts that still cool at a window."""
    return state.last_batched(batch, current, n)


def ema_start(batch: DataFrame, config: EngineConfig = DEFAULT, archive: DataFrame | None = None) -> DataFrame:
    """Initial state of ``running_ema``: every key's score after the last archived record.

    ``archive`` holds the windows of all records (those of the batch rows if None).
    """
    end = scoring.archive_steps(archive if archive is not None else batch).agg(F.max("step").alias("last"))  # one row
    return scoring.ema_scores(batch, config, archive).select("hotkey", F.col("score").alias("value")).join(F.broadcast(end))
