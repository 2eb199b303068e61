"""Statistics of rollout groups: deviation, zone, advantages, step metrics and the three kinds of quantile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT, EngineConfig


def sigma(reward: Column) -> Column:
    """Population deviation as an aggregate; 0 for fewer than two values."""
    return F.coalesce(F.stddev_pop(reward), F.lit(0.0))


def in_zone(value: Column, threshold: float, degenerate: float | None = DEFAULT.sigma_degenerate) -> Column:
    """Whether a deviation reaches the threshold; a degenerate one never does (None: without that guard)."""
    reached = value >= threshold
    return reached if degenerate is None else (value >= degenerate) & reached


def is_bootstrap(window: Column, start: int, length: int = DEFAULT.bootstrap_windows) -> Column:
    """The first ``length`` windows from ``start``."""
    return (window - start >= 0) & (window - start < length)


def group_zone(rollouts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Per group: n, sigma, the collector's and the producer's verdict, and whether all rewards are equal."""
    g = rollouts.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), sigma(F.col("reward")).alias("sigma"), (F.min("reward") == F.max("reward")).alias("uniform"))
    return g.select("grp", "n", "sigma", in_zone(F.col("sigma"), config.sigma_steady).alias("in_zone"), in_zone(F.col("sigma"), config.sigma_producer, None).alias("producer_zone"), "uniform")


def advantages(rollouts: DataFrame, value: str = "reward", degenerate: float = DEFAULT.sigma_degenerate) -> DataFrame:
    """Adds adv = (r - mean) / sigma within the group, 0 where sigma is degenerate."""
    w = W.partitionBy("grp")
    dev = F.coalesce(F.stddev_pop(value).over(w), F.lit(0.0))
    return rollouts.withColumn("adv", F.when(dev < degenerate, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / dev))


def step_metrics(rollouts: DataFrame, degenerate: float = DEFAULT.sigma_degenerate) -> DataFrame:
    """One row of a training step: reward statistics over rollouts and the share of degenerate groups (two levels)."""
    per = rollouts.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("reward_c").alias("s"), F.sum(F.col("reward_c") * F.col("reward_c")).alias("q"), F.min("reward_c").alias("lo"), F.max("reward_c").alias("hi"), sigma(F.col("reward_c")).alias("sigma"))
    n = F.sum("n")
    mean = F.sum("s") / n
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"), n.alias("n_rollouts"), mean.alias("reward_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - mean * mean)).alias("reward_std"),
        F.min("lo").alias("reward_min"), F.max("hi").alias("reward_max"),
        F.count_if(F.col("sigma") < degenerate).alias("n_degenerate"),
        F.avg((F.col("sigma") < degenerate).cast("double")).alias("degenerate_ratio"),
        F.avg("sigma").alias("sigma_mean"),
    )


def early_drop(rollouts: DataFrame) -> DataFrame:
    """Per group the first of: uniform_rewards, no_eos, no_bt_ok; null if it stays. Needs reward, in_eos, p_stop."""
    ok = F.col("in_eos") & F.coalesce(F.col("p_stop") >= DEFAULT.stop_probability, F.lit(False))
    g = rollouts.groupBy("grp").agg(F.min("reward").alias("lo"), F.max("reward").alias("hi"), F.max("in_eos").alias("any_eos"), F.count_if(ok).alias("n_bt_ok"))
    return g.select("grp", "n_bt_ok", F.when(F.col("lo") == F.col("hi"), "uniform_rewards").when(~F.col("any_eos"), "no_eos").when(F.col("n_bt_ok") == 0, "no_bt_ok").alias("dropped"))


def distribution_metrics(rows: DataFrame, key: str, p: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Per key: mean, median, q10, low and high shares of chosen probabilities, and the three-valued verdict.

    Fewer than ``distribution_min_steps`` values give a null verdict, which later gates accept.
    """
    q = F.percentile(p, F.array(F.lit(0.5), F.lit(0.1)))
    g = rows.groupBy(key).agg(F.count(p).alias("steps"), F.avg(p).alias("mean"), q.alias("q"), F.avg((F.col(p) <= 0.1).cast("int")).alias("low_frac"), F.avg((F.col(p) >= 0.9).cast("int")).alias("high_frac"))
    median, q10 = F.col("q")[0], F.col("q")[1]
    enough = F.col("steps") >= config.distribution_min_steps
    ok = F.when(enough, (median >= config.distribution_median) & (q10 >= config.distribution_q10))
    return g.select(key, "steps", "mean", median.alias("median"), q10.alias("q10"), "low_frac", "high_frac", ok.alias("dist_ok"))


def index_quantiles(values: Column) -> Column:
    """From an array: upper median, capped 95th and span 95th percentile by index, and the usual median."""
    s = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    half = F.floor(n / 2)
    mid = F.when(n % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)
    return F.struct(at(half).alias("upper_median"), at(F.least(n - 1, F.floor(n * 0.95))).alias("p95_capped"), at(F.floor((n - 1) * 0.95)).alias("p95_span"), mid.alias("median"))


def catch_rate(rows: DataFrame, step: str, caught: Column) -> DataFrame:
    """(step, n, rate): percent of rows caught at each step."""
    return rows.groupBy(step).agg(F.count(F.lit(1)).alias("n"), (F.avg(caught.cast("double")) * 100).alias("rate"))


def probe_labels(rollouts: DataFrame, margin: int = 2) -> DataFrame:
    """Per group: k correct of m, p, and whether margin <= k <= m - margin; plus the continuous verdict."""
    g = rollouts.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("reward") == 1).cast("bigint")).alias("k"), sigma(F.col("reward_c")).alias("sigma_c"))
    return g.select("grp", "k", "m", (F.col("k") / F.col("m")).alias("p_correct"), F.col("k").between(margin, F.col("m") - margin).alias("in_zone"), "sigma_c", (F.col("sigma_c") >= DEFAULT.sigma_producer).alias("in_zone_c"))


def confusion(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """The four counts of two flags."""
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))
