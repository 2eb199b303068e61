"""Queries that choose submissions and rollouts, and archive assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import hashing
from tallyforge.operators import groups, selection, state
from tallyforge.plans.base import REGISTRY, rounded
from tallyforge.sources import lens

SUBS = f"WITH {lens.SUBS_SQL}"
ORDER = "arrived_at, sha256(encode(hotkey) || unhex(printf('%016x', prompt_idx)) || root), ord"
BATCH_CTES = f"""{lens.SUBS_SQL}, v AS (SELECT * FROM subs WHERE valid AND prompt_idx % 10 <> 3), one AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY window_n, prompt_idx ORDER BY {ORDER}) = 1),
batch AS (SELECT *, row_number() OVER (PARTITION BY window_n ORDER BY {ORDER}) AS slot FROM one QUALIFY slot <= 8)"""
BATCH = f"WITH {BATCH_CTES}"


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.submissions(spark, sf_dir).where("valid")


def sealed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of every window: outside cooldown, first of each prompt, first eight."""
    valid = _valid(spark, sf_dir)
    return selection.select_batch(valid, valid.where("prompt_idx % 10 = 3").select("prompt_idx").distinct())


@REGISTRY.query("select_batch", f"{BATCH} SELECT window_n, slot::INT AS slot, ord, hotkey, prompt_idx FROM batch")
def select_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, D3: cooldown first, then first of each prompt, then the first eight."""
    return sealed_batch(spark, sf_dir).select("window_n", "slot", "ord", "hotkey", "prompt_idx")


@REGISTRY.query("runners_up_anti", f"{BATCH} SELECT window_n, hotkey, prompt_idx, ord FROM subs s WHERE valid AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.window_n = s.window_n AND b.hotkey = s.hotkey AND b.prompt_idx = s.prompt_idx)")
def runners_up_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, D4."""
    return selection.runners_up(_valid(spark, sf_dir), sealed_batch(spark, sf_dir)).select("window_n", "hotkey", "prompt_idx", "ord")


@REGISTRY.query("archive_records", f"""{BATCH}, ru AS (SELECT * FROM subs s WHERE valid AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.window_n = s.window_n AND b.hotkey = s.hotkey AND b.prompt_idx = s.prompt_idx)),
o AS (SELECT window_n, min(arrived_at) AS opened_at FROM subs GROUP BY 1), rj AS (SELECT window_n, env, count(*) AS n FROM subs WHERE NOT valid GROUP BY ALL)
SELECT window_n, (SELECT count(*) FROM batch b WHERE b.window_n = o.window_n) AS n_batch, (SELECT count(*) FROM ru WHERE ru.window_n = o.window_n) AS n_runners, coalesce((SELECT sum(n) FROM rj WHERE rj.window_n = o.window_n), 0)::BIGINT AS n_rejects,
coalesce(round((SELECT sum(b.arrived_at - o.opened_at) FROM batch b WHERE b.window_n = o.window_n), 3), 0)::DOUBLE AS response_sum FROM o""")
def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled record, summed up for the comparison."""
    subs = lens.submissions(spark, sf_dir)
    opened = subs.groupBy("window_n").agg(F.min("arrived_at").alias("opened_at"))
    rec = state.archive_records(_valid(spark, sf_dir), sealed_batch(spark, sf_dir), subs.where("NOT valid").withColumn("reason", F.col("env")), opened)
    total = F.aggregate("batch", F.lit(0.0), lambda a, x: a + x["response_time"])
    return rec.select("window_n", F.size("batch").cast("bigint").alias("n_batch"), F.size("runners_up").cast("bigint").alias("n_runners"), F.aggregate(F.map_values("reject_summary"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_rejects"), F.round(total, 3).alias("response_sum"))


@REGISTRY.query("seal_point", f"""{SUBS}, f AS (SELECT *, (row_number() OVER (PARTITION BY window_n, prompt_idx ORDER BY arrived_at, ord) = 1)::INT AS fresh FROM subs WHERE valid), d AS (SELECT *, sum(fresh) OVER (PARTITION BY window_n ORDER BY arrived_at, ord) AS k FROM f)
SELECT window_n, min(CASE WHEN k >= 8 THEN arrived_at END) AS sealed_at, max(k)::BIGINT AS n FROM d GROUP BY window_n""")
def seal_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, J1."""
    return selection.seal_points(_valid(spark, sf_dir))


@REGISTRY.query("quota_per_hotkey", f"{SUBS} SELECT window_n, hotkey, ord, row_number() OVER (PARTITION BY window_n, hotkey ORDER BY arrived_at, ord)::INT AS nth FROM subs QUALIFY nth <= 2")
def quota_per_hotkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota is the feature."""
    return selection.within_quota(lens.submissions(spark, sf_dir), 2).select("window_n", "hotkey", "ord", "nth")


RW = f"WITH {lens.REWARDS_SQL}"


@REGISTRY.query("max_variance_subset", f"""{RW}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY reward_c, idx) AS r, count(*) OVER (PARTITION BY grp) AS n FROM rw), p AS (SELECT * FROM r WHERE n >= 5 AND (r <= 2 OR r > n - 3)),
s AS (SELECT grp, idx, stddev_pop(reward_c) OVER (PARTITION BY grp) AS s FROM p) SELECT grp, idx, round(s, 6) AS sigma FROM s WHERE s >= 0.3""")
def max_variance_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return selection.widest_subset(lens.reward_groups(spark, sf_dir), 5, 0.3).select("grp", "idx", rounded("sigma"))


@REGISTRY.query("token_dedup", f"{RW} SELECT grp, idx, sha256(unhex(printf('%08x%08x', (partkey % 3)::INT, quantity::INT % 4))) AS digest FROM rw QUALIFY row_number() OVER (PARTITION BY grp, digest ORDER BY idx) = 1")
def token_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, G3."""
    digest = hashing.token_hash(F.array(F.col("partkey") % 3, F.col("quantity").cast("bigint") % 4))
    return selection.first_of_hash(lens.reward_groups(spark, sf_dir), digest).select("grp", "idx", "digest")


BAND = f"""{RW}, b AS (SELECT grp, idx, reward, tax >= 0.02 AS bt_ok, quantity / 50 AS q10, tax AS p_stop, quantity > 10 AS in_eos FROM rw),
p AS (SELECT *, row_number() OVER (PARTITION BY grp, reward ORDER BY bt_ok DESC, CASE WHEN bt_ok THEN -q10 ELSE -(in_eos::INT) END, -p_stop, idx) AS place FROM b),
c AS (SELECT grp, count(*) FILTER (WHERE reward = 1 AND bt_ok) AS a, count(*) FILTER (WHERE reward = 1 AND NOT bt_ok) AS an, count(*) FILTER (WHERE reward = 0 AND bt_ok) AS w, count(*) FILTER (WHERE reward = 0 AND NOT bt_ok) AS wn FROM b GROUP BY grp),
k AS (SELECT grp, k, row_number() OVER (PARTITION BY grp ORDER BY abs(k - 2), k) AS r FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE a + an >= k AND w + wn >= 4 - k AND greatest(0, k - a) + greatest(0, 4 - k - w) <= 1)
SELECT p.grp, p.idx, p.reward, p.bt_ok, k.k FROM p JOIN k ON p.grp = k.grp AND k.r = 1 WHERE CASE WHEN reward = 1 THEN place <= k ELSE place <= 4 - k END"""


@REGISTRY.query("band_subset", BAND)
def band_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 with groups of four."""
    rows = lens.reward_groups(spark, sf_dir).withColumns({"bt_ok": F.col("tax") >= 0.02, "q10": F.col("quantity") / 50, "p_stop": F.col("tax"), "in_eos": F.col("quantity") > 10})
    return selection.band_subset(rows, size=4, k_min=1, k_max=3, max_not_ok=1)


@REGISTRY.query("bootstrap_zone", f"{RW}, g AS (SELECT grp, stddev_pop(reward) AS s FROM rw GROUP BY grp) SELECT grp, grp - 100 >= 0 AND grp - 100 < 100 AS bootstrap, s >= 1e-8 AND s >= CASE WHEN grp - 100 >= 0 AND grp - 100 < 100 THEN 0.33 ELSE 0.43 END AS in_zone FROM g")
def bootstrap_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 with C26."""
    boot = groups.is_bootstrap(F.col("grp"), 100)
    g = lens.reward_groups(spark, sf_dir).groupBy("grp").agg(groups.sigma(F.col("reward")).alias("s"))
    return g.select("grp", boot.alias("bootstrap"), groups.in_zone(F.col("s"), F.when(boot, 0.33).otherwise(0.43)).alias("in_zone"))


@REGISTRY.query("fire_filter", f"""{SUBS}, c AS (SELECT DISTINCT prompt_idx FROM subs WHERE env = 'error'), r AS (SELECT env, 10 * row_number() OVER (ORDER BY env) AS lo, 10 * row_number() OVER (ORDER BY env) + 30 AS hi FROM (SELECT DISTINCT env FROM subs)),
f AS (SELECT s.ord, s.env, s.prompt_idx, s.arrived_at FROM subs s JOIN r ON r.env = s.env AND s.prompt_idx >= lo AND s.prompt_idx < hi WHERE s.prompt_idx % 9 <> 0)
SELECT env, ord, row_number() OVER (PARTITION BY env ORDER BY arrived_at, ord)::INT AS nth FROM f QUALIFY nth <= 40""")
def fire_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range per environment, anti-join, then the budget."""
    from pyspark.sql import Window as W

    from tallyforge.operators.scoring import small

    subs = lens.submissions(spark, sf_dir)
    envs = subs.select("env").distinct().withColumn("k", F.row_number().over(W.orderBy("env")))
    ranges = small(envs.select("env", (10 * F.col("k")).alias("lo"), (10 * F.col("k") + 30).alias("hi")))
    cooling = subs.where("prompt_idx % 9 = 0").select("prompt_idx").distinct()
    rows = subs.join(ranges, "env").where((F.col("prompt_idx") >= F.col("lo")) & (F.col("prompt_idx") < F.col("hi"))).join(cooling, "prompt_idx", "left_anti")
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("env").orderBy("arrived_at", "ord"))).where("nth <= 40").select("env", "ord", "nth")


@REGISTRY.query("verdict_lookup", f"""{SUBS}, e AS (SELECT sha256(ord::VARCHAR) AS root, env FROM subs), v AS (SELECT sha256(CASE WHEN ord % 2 = 0 THEN ord ELSE -1 - ord END::VARCHAR) AS root, CASE WHEN ord % 3 <> 0 THEN value > 245 END AS rewarded FROM subs WHERE arrived_at > 1000)
SELECT env, count(*) AS n, count(*) FILTER (WHERE rewarded) AS rewarded FROM v JOIN e USING (root) WHERE rewarded IS NOT NULL GROUP BY env""")
def verdict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, J7."""
    subs = lens.submissions(spark, sf_dir).withColumn("root", F.sha2(F.col("ord").cast("string"), 256)).withColumn("ts", F.col("arrived_at"))
    known = F.when(F.col("ord") % 2 == 0, F.col("ord")).otherwise(-1 - F.col("ord"))  # the other roots belong to no submission
    verdicts = state.since(subs, 1000.0).select(F.sha2(known.cast("string"), 256).alias("root"), F.when(F.col("ord") % 3 != 0, F.col("value") > 245).alias("rewarded"))
    return state.apply_verdicts(verdicts, subs).groupBy("env").agg(F.count(F.lit(1)).alias("n"), F.count_if("rewarded").alias("rewarded"))
