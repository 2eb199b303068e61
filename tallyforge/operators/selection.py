"""Choosing submissions and rollouts: claims, seal point, quota, batch, subsets, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT, EngineConfig
from tallyforge.functions.hashing import tiebreak


def arrival_order() -> list[Column]:
    """Arrival first (a missing one counts as 0), then the digest, then the row's own number."""
    return [F.coalesce("arrived_at", F.lit(0.0)), tiebreak(F.col("hotkey"), F.col("prompt_idx"), F.col("root")), F.col("ord")]


def first_accepted(subs: DataFrame, passes_before: Column, passes_after: Column) -> DataFrame:
    """Adds outcome: rejected_before, superseded, rejected_after or accepted, as first-accepted-wins per window and prompt.

    A prompt is claimed by the earliest row that passes everything; later rows that pass the earlier gates lose to it.
    """
    claim = F.min(F.when(passes_before & passes_after, F.struct("arrived_at", "ord"))).over(W.partitionBy("window_n", "prompt_idx"))
    me = F.struct("arrived_at", "ord")
    return subs.withColumn("claim", claim).withColumn(
        "outcome",
        F.when(~passes_before, "rejected_before").when(F.col("claim").isNotNull() & (me > F.col("claim")), "superseded").when(~passes_after, "rejected_after").otherwise("accepted"),
    ).drop("claim")


def within_quota(subs: DataFrame, quota: int = DEFAULT.quota_per_hotkey) -> DataFrame:
    """The first ``quota`` rows of each key in each window."""
    w = W.partitionBy("window_n", "hotkey").orderBy("arrived_at", "ord")
    return subs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= quota)


def select_batch(subs: DataFrame, cooldown: DataFrame | None = None, b: int = DEFAULT.batch_size) -> DataFrame:
    """The first ``b`` rows of distinct prompts of each window, in arrival order; rows of (prompt_idx) in cooldown are out.

    Two ranks do it: first of its prompt, then the first b of what is left, which is what the greedy loop picks.
    """
    if b <= 0:
        return subs.limit(0).withColumn("slot", F.lit(0))
    rows = subs if cooldown is None else subs.join(cooldown, [c for c in ("window_n", "prompt_idx") if c in cooldown.columns], "left_anti")
    order = arrival_order()
    one = rows.withColumn("p", F.row_number().over(W.partitionBy("window_n", "prompt_idx").orderBy(*order))).where("p = 1").drop("p")
    return one.withColumn("slot", F.row_number().over(W.partitionBy("window_n").orderBy(*order))).where(F.col("slot") <= b)


def seal_points(subs: DataFrame, b: int = DEFAULT.batch_size) -> DataFrame:
    """(window_n, sealed_at, n): the arrival at which a window first holds b distinct prompts; null if it never does."""
    w = W.partitionBy("window_n", "prompt_idx").orderBy("arrived_at", "ord")
    fresh = subs.withColumn("fresh", (F.row_number().over(w) == 1).cast("int"))
    run = W.partitionBy("window_n").orderBy("arrived_at", "ord").rowsBetween(W.unboundedPreceding, 0)
    counted = fresh.withColumn("distinct", F.sum("fresh").over(run))
    return counted.groupBy("window_n").agg(F.min(F.when(F.col("distinct") >= b, F.col("arrived_at"))).alias("sealed_at"), F.max("distinct").alias("n"))


def runners_up(valid: DataFrame, batch: DataFrame) -> DataFrame:
    """Valid rows that are not in the batch, by key and prompt."""
    return valid.join(batch.select("window_n", "hotkey", "prompt_idx"), ["window_n", "hotkey", "prompt_idx"], "left_anti")


def widest_subset(rollouts: DataFrame, size: int, target: float, value: str = "reward_c") -> DataFrame:
    """Rows of the widest subset of each group: the lowest half and the highest rest, kept if its deviation reaches target."""
    low = W.partitionBy("grp").orderBy(value, "idx")
    n = F.count(F.lit(1)).over(W.partitionBy("grp"))
    picked = rollouts.withColumns({"r": F.row_number().over(low), "n": n})
    picked = picked.where((F.col("n") >= size) & ((F.col("r") <= size // 2) | (F.col("r") > F.col("n") - (size - size // 2))))
    return picked.withColumn("sigma", F.stddev_pop(value).over(W.partitionBy("grp"))).where(F.col("sigma") >= target).drop("r", "n")


def first_of_hash(rollouts: DataFrame, digest: Column) -> DataFrame:
    """The first row of each group and digest, by idx."""
    w = W.partitionBy("grp", "digest").orderBy("idx")
    return rollouts.withColumn("digest", digest).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def band_subset(rollouts: DataFrame, size: int = DEFAULT.group_size, k_min: int = 3, k_max: int = 5, max_not_ok: int = 2) -> DataFrame:
    """(grp, idx, k): of each group a subset with k right and size - k wrong rollouts.

    k is tried from the middle of the band outwards; rollouts with bt_ok come first (by q10, then p_stop), the others fill
    up (by in_eos, then p_stop) within max_not_ok. Ranks in the four buckets replace the loop: for each group and k it
    is known from four counts whether k works, so rows are read once.
    """
    rows = rollouts.where(F.col("reward").isin(0.0, 1.0))
    best = [F.when(F.col("bt_ok"), -F.coalesce("q10", F.lit(0.0))).otherwise(-F.coalesce(F.col("in_eos").cast("int"), F.lit(0))), -F.coalesce("p_stop", F.lit(0.0)), F.col("idx")]
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("grp", "reward").orderBy(F.desc("bt_ok"), *best)))
    c = rows.groupBy("grp").agg(*[F.count_if((F.col("reward") == r) & (F.col("bt_ok") == ok)).alias(f"n{int(r)}{int(ok)}") for r in (1.0, 0.0) for ok in (True, False)])
    mid = (k_min + k_max) // 2
    order = sorted(range(k_min, k_max + 1), key=lambda k: abs(k - mid))

    def works(k: int) -> Column:
        wrong = size - k
        fill = F.greatest(F.lit(0), k - F.col("n11")) + F.greatest(F.lit(0), wrong - F.col("n01"))
        return (F.col("n11") + F.col("n10") >= k) & (F.col("n01") + F.col("n00") >= wrong) & (fill <= max_not_ok)

    chosen = F.coalesce(*[F.when(works(k), F.lit(k)) for k in order])
    picked = rows.join(c.select("grp", chosen.alias("k")).where("k IS NOT NULL"), "grp")
    return picked.where(F.when(F.col("reward") == 1.0, F.col("place") <= F.col("k")).otherwise(F.col("place") <= size - F.col("k"))).select("grp", "idx", "reward", "bt_ok", "k")


def slot_allocation(yields: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(env, slots) from (pos, env, ema): largest remainders above a floor, summing to the total.

    One row per environment: a handful, so one window over them is fine. A missing yield counts 0.5; ties go by pos.
    """
    every = W.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(every)
    rows = yields.withColumns({"w": F.greatest(F.coalesce("ema", F.lit(0.5)), F.lit(1e-9)), "n": n, "place": F.row_number().over(W.orderBy("pos"))})
    left = config.slot_total - config.slot_floor * F.col("n")
    quota = left * F.col("w") / F.sum("w").over(every)
    rows = rows.withColumn("quota", quota).withColumn("base", F.floor("quota"))
    rows = rows.withColumn("r", F.row_number().over(W.orderBy(F.desc(F.col("quota") - F.col("base")), "pos")))
    extra = (F.col("r") <= left - F.sum("base").over(every)).cast("int")
    even = F.floor(F.lit(config.slot_total) / F.col("n"))
    split = even + (F.col("place") <= config.slot_total - even * F.col("n")).cast("int")
    slots = F.when(left < 0, split).when(left == 0, F.lit(config.slot_floor)).otherwise(config.slot_floor + F.col("base") + extra)
    return rows.select("env", slots.cast("bigint").alias("slots"))


def furthest_below(targets: DataFrame, counts: DataFrame, turn: int = 0) -> DataFrame:
    """The environment with the largest share missing in the pool; ties rotate with ``turn``."""
    every = W.partitionBy(F.lit(1))
    rows = targets.join(counts, "env", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    gap = F.col("slots") / F.sum("slots").over(every) - F.col("have") / F.greatest(F.sum("have").over(every), F.lit(1))
    ranked = rows.withColumn("gap", F.round(gap, 12)).withColumn("r", F.rank().over(W.orderBy(F.desc("gap")))).where("r = 1")
    ranked = ranked.withColumns({"i": F.row_number().over(W.orderBy("env")) - 1, "ties": F.count(F.lit(1)).over(every)})
    return ranked.where(F.col("i") == F.lit(turn) % F.col("ties")).select("env", "gap")
