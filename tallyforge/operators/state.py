"""State that lives across windows: cooldown, archive records, verdict tables, flush sessions, and the ordered replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators.selection import runners_up


def last_batched(batch: DataFrame, current: int, horizon: int) -> DataFrame:
    """(prompt_idx, last_window) over windows in (current - horizon, current)."""
    if horizon < 0:
        raise ValueError("the horizon is not negative")
    return batch.where((F.col("window_n") > current - horizon) & (F.col("window_n") < current)).groupBy("prompt_idx").agg(F.max("window_n").alias("last_window"))


def cooling(state: DataFrame, current: int, n: int) -> DataFrame:
    """Prompts still in cooldown at a window; none for n = 0."""
    return state.where(F.lit(current) - F.col("last_window") < n)


def cooldown_list(state: DataFrame, current: int, n: int) -> DataFrame:
    """One row: the sorted prompts in cooldown."""
    return cooling(state, current, n).agg(F.sort_array(F.collect_set("prompt_idx")).alias("cooldown_prompts"))


def reject_summary(rows: DataFrame, reason: str = "reason", by: list[str] | None = None) -> DataFrame:
    """Counts by reason as a map, per ``by`` (or for all)."""
    by = by or []
    counts = rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("reject_summary"))


def archive_records(valid: DataFrame, batch: DataFrame, rejects: DataFrame, opened: DataFrame) -> DataFrame:
    """One record a window: batch and runners_up as arrays in arrival order, reject_summary, response times.

    A response time is null if the arrival is 0. A window holds a handful of rows, so its arrays are bounded by the batch
    size and the quota.
    """
    entry = lambda rows: rows.join(opened, "window_n").withColumn("response_time", F.nullif(F.col("arrived_at"), F.lit(0.0)) - F.col("opened_at"))
    packed = lambda rows, name: entry(rows).groupBy("window_n").agg(F.sort_array(F.collect_list(F.struct("arrived_at", "hotkey", "prompt_idx", "response_time"))).alias(name))
    none = F.array().cast("array<struct<arrived_at:double,hotkey:string,prompt_idx:bigint,response_time:double>>")
    out = opened.join(packed(batch, "batch"), "window_n", "left").join(packed(runners_up(valid, batch), "runners_up"), "window_n", "left")
    out = out.join(reject_summary(rejects, "reason", ["window_n"]), "window_n", "left")
    return out.select("window_n", F.coalesce("batch", none).alias("batch"), F.coalesce("runners_up", none).alias("runners_up"), F.coalesce("reject_summary", F.create_map().cast("map<string,bigint>")).alias("reject_summary"))


def flip_sessions(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds session: the number of times the value changed so far within the key."""
    w = W.partitionBy(key).orderBy(*order)
    flip = (F.lag(value).over(w).isNotNull() & (F.lag(value).over(w) != F.col(value))).cast("bigint")
    return rows.withColumn("flip", flip).withColumn("session", F.sum("flip").over(w)).drop("flip")


def since(rows: DataFrame, cursor: float) -> DataFrame:
    """Rows after a cursor, oldest first."""
    return rows.where(F.col("ts") > cursor).orderBy("ts")


def apply_verdicts(verdicts: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdicts that know an entry's environment and carry a reward."""
    return verdicts.where(F.col("rewarded").isNotNull()).join(entries.select("root", "env"), "root")


def latest(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """The last n rows by an order (a top-n, not a cut)."""
    return rows.orderBy(order.desc()).limit(n)


def replay_batches(subs: DataFrame, cooldown: int, b: int = DEFAULT.batch_size, stream: str | None = None) -> DataFrame:
    """(window_n, slot, hotkey, prompt_idx): batches in which each window's cooldown depends on the batches before it.

    That recursion runs over windows, not rows: only each window's first arrival per prompt can matter, so candidates are
    cut to those before one ordered pass per ``stream`` (a column; one stream if None).
    """
    order = W.partitionBy(*([stream] if stream else []), "window_n", "prompt_idx").orderBy("arrived_at", "ord")
    first = subs.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    first = first.withColumn("stream", F.col(stream).cast("string") if stream else F.lit("all"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[int, int] = {}
        rows = []
        for window, part in pdf.sort_values(["window_n", "arrived_at", "ord"]).groupby("window_n", sort=True):
            picked = [(h, p) for h, p in zip(part["hotkey"], part["prompt_idx"]) if p not in last or window - last[p] >= cooldown][:b]
            last.update({p: window for _, p in picked})
            rows += [(pdf["stream"].iloc[0], window, k, h, p) for k, (h, p) in enumerate(picked, 1)]
        return pd.DataFrame(rows, columns=["stream", "window_n", "slot", "hotkey", "prompt_idx"])

    return first.groupBy("stream").applyInPandas(run, "stream string, window_n bigint, slot bigint, hotkey string, prompt_idx bigint")


def retry_queue(existing: DataFrame, fresh: DataFrame, phase_size: int = 8, max_phases: int = 3) -> DataFrame:
    """Rollouts kept over phases: existing and new ones together, the phase number, and whether a prompt may try again."""
    both = existing.unionByName(fresh)
    per = both.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    return per.select("grp", "total", F.floor(F.col("total") / phase_size).alias("phase"), (F.floor(F.col("total") / phase_size) < max_phases).alias("retry"))

