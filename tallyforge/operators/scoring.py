"""Contribution scores: slots per window, replayed moving averages, burn, weights joined to uids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT, EngineConfig

#: Distinct windows, keys or uids of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows, counted; else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def slots_per_window(batch: DataFrame) -> DataFrame:
    """(window_n, hotkey, n): how many batch slots each key holds in each window."""
    return batch.groupBy("window_n", "hotkey").agg(F.count(F.lit(1)).alias("n"))


def archive_steps(windows: DataFrame) -> DataFrame:
    """(window_n, step) in archive order: a step is a record, so missing windows do not tick."""
    return windows.select("window_n").distinct().withColumn("step", F.row_number().over(W.orderBy("window_n")).cast("bigint"))


def _decayed(value: Column, ticks: Column, keep: float, prune: float) -> Column:
    """A value after some windows without a slot; a value that fell to the threshold is gone."""
    left = value * F.pow(F.lit(keep), ticks)
    return F.when((ticks > 0) & (left <= prune), F.lit(0.0)).otherwise(left)


def ema_scores(batch: DataFrame, config: EngineConfig = DEFAULT, archive: DataFrame | None = None) -> DataFrame:
    """(hotkey, score): the moving average after the last archive record.

    Every known key ticks at every record: alpha * n / B + (1 - alpha) * old, and a score of ``ema_prune`` or less is
    dropped. Only records in which a key holds slots are kept per key; the ticks between them are a power of
    (1 - alpha), so the fold is as long as the key's own records and keys are never crossed with windows.
    """
    alpha, keep = config.ema_alpha, 1 - config.ema_alpha
    steps = archive_steps(archive if archive is not None else batch)
    last = steps.agg(F.max("step").alias("last"))
    own = slots_per_window(batch).join(small(steps), "window_n")
    runs = own.groupBy("hotkey").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("runs"))

    def blend(acc: Column, x: Column) -> Column:
        old = _decayed(acc["v"], x["step"] - acc["s"] - 1, keep, config.ema_prune)
        new = alpha * (x["n"] / config.batch_size) + keep * old
        return F.struct(F.when(new > config.ema_prune, new).otherwise(F.lit(0.0)).alias("v"), x["step"].alias("s"))

    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0).cast("bigint").alias("s"))
    folded = runs.select("hotkey", F.aggregate("runs", zero, blend).alias("acc")).join(F.broadcast(last))
    score = _decayed(F.col("acc.v"), F.col("last") - F.col("acc.s"), keep, config.ema_prune)
    return folded.select("hotkey", score.alias("score")).where(F.col("score") > config.ema_prune)


def burn(scores: DataFrame) -> DataFrame:
    """One row: what the scores leave of 1, never below 0."""
    return scores.agg(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("score"), F.lit(0.0))).alias("burn"))


def last_uid(meta: DataFrame) -> DataFrame:
    """(hotkey, uid): the last position of a repeated key wins."""
    return meta.groupBy("hotkey").agg(F.max_by("uid", "pos").alias("uid"))


def weights(scores: DataFrame, meta: DataFrame, burn_uid: int = 0) -> DataFrame:
    """(uid, hotkey, weight): scores of registered keys, and the burn as a row of its own if it is above zero.

    The weight of an unregistered key is lost, it is not burned again.
    """
    joined = scores.join(last_uid(meta), "hotkey").select("uid", "hotkey", F.col("score").alias("weight"))
    rest = burn(scores).where("burn > 0").select(F.lit(burn_uid).cast("bigint").alias("uid"), F.lit(None).cast("string").alias("hotkey"), F.col("burn").alias("weight"))
    return joined.unionByName(rest)


def top_weights(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k largest scores; ties by key."""
    return scores.orderBy(F.desc("score"), "hotkey").limit(k)


def ordered_ema(rows: DataFrame, key: str, value: str, order: list[str], alpha: float, start: str = "first", span: float = 3600.0) -> DataFrame:
    """(key, ema): fold of values in order; the first observation initialises it ("first") or it starts at zero ("zero").

    A run of observations maps the average before it to keep * before + add. The first order column, a number, is cut into stretches
    of ``span``; each is folded to its map apart, and a key's maps are folded in order, one small struct a stretch. A
    start at the first value is a first observation that meets itself.
    """
    x = F.col(value).cast("double")
    stretch = F.floor(F.col(order[0]) / span)
    runs = rows.select(key, stretch.alias("_at"), F.struct(*order, x.alias("x")).alias("_s")).groupBy(key, "_at").agg(F.sort_array(F.collect_list("_s")).alias("seq"))
    add = F.aggregate("seq", F.lit(0.0), lambda acc, s: (1 - alpha) * acc + alpha * s["x"])
    maps = runs.select(key, F.struct("_at", F.pow(F.lit(1 - alpha), F.size("seq")).alias("keep"), add.alias("add"), F.get("seq", F.lit(0))["x"].alias("x")).alias("_m"))
    folded = maps.groupBy(key).agg(F.sort_array(F.collect_list("_m")).alias("maps"))
    before = F.get("maps", F.lit(0))["x"] if start == "first" else F.lit(0.0)
    return folded.select(key, F.aggregate("maps", before, lambda acc, m: m["keep"] * acc + m["add"]).alias("ema"))
