"""Queries over firing, publishing, restarts and polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import cadence, gates, state
from tallyforge.plans.base import REGISTRY
from tallyforge.plans.registry import table
from tallyforge.sources import lens

SUBS = f"WITH {lens.SUBS_SQL}"


@REGISTRY.query("fire_predicate", f"""{SUBS}, t AS (SELECT window_n, count(*) FILTER (WHERE valid AND value > 50) AS pool, CASE WHEN max(value) > 200 THEN 'training' ELSE 'open' END AS state, CASE WHEN min(prompt_idx) > 2 THEN '' ELSE sha256(window_n::VARCHAR) END AS randomness FROM subs GROUP BY window_n)
SELECT window_n, state, pool, state = 'open' AND randomness <> '' AND pool > 0 AND window_n NOT IN (SELECT window_n FROM subs WHERE prompt_idx = 5) AND window_n NOT IN (SELECT window_n FROM subs WHERE prompt_idx = 77) AS fire FROM t""")
def fire_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21."""
    s = lens.submissions(spark, sf_dir)
    ticks = s.groupBy("window_n").agg(
        F.count_if(F.col("valid") & (F.col("value") > 50)).alias("pool"),
        F.when(F.max("value") > 200, "training").otherwise("open").alias("state"),
        F.when(F.min("prompt_idx") > 2, "").otherwise(F.sha2(F.col("window_n").cast("string"), 256)).alias("randomness"),
    )
    return cadence.should_fire(ticks, s.where("prompt_idx = 5"), s.where("prompt_idx = 77")).select("window_n", "state", "pool", "fire")


@REGISTRY.query("local_floors", f"""WITH {lens.REWARDS_SQL}, m AS (SELECT grp, idx, CASE WHEN quantity > 5 THEN quantity / 50 END AS q10, CASE WHEN tax > 0 THEN tax * 10 END AS med FROM rw)
SELECT grp, idx, q10 IS NOT NULL AND q10 >= 0.3 AND med IS NOT NULL AND med >= 0.2 AS both_on, med IS NOT NULL AND med >= 0.2 AS median_on, true AS both_off FROM m""")
def local_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C25."""
    q10, med = F.when(F.col("quantity") > 5, F.col("quantity") / 50), F.when(F.col("tax") > 0, F.col("tax") * 10)
    ways = {"both_on": (0.3, 0.2), "median_on": (0.0, 0.2), "both_off": (0.0, 0.0)}
    return lens.reward_groups(spark, sf_dir).select("grp", "idx", *[cadence.passes_floors(q10, med, *floors).alias(name) for name, floors in ways.items()])


WINDOWS = f"{SUBS}, w AS (SELECT window_n, count(*) FILTER (WHERE valid) AS n FROM subs GROUP BY window_n)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.submissions(spark, sf_dir).groupBy("window_n").agg(F.count_if("valid").alias("n"))


@REGISTRY.query("publish_cadence", f"{WINDOWS} SELECT window_n, n, n >= 8 AS trained, n >= 8 AND (window_n % 5 = 0 OR window_n = (SELECT min(window_n) FROM w WHERE n >= 8)) AS published, n >= 8 AND window_n % 5 = 0 AS published_later FROM w")
def publish_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C29, at a first start and with a checkpoint at hand."""
    later = cadence.publish_plan(_windows(spark, sf_dir), every=5, has_checkpoint=True).withColumnRenamed("published", "published_later").drop("trained")
    return cadence.publish_plan(later, every=5).select("window_n", "n", "trained", "published", "published_later")


@REGISTRY.query("window_states", f"""{WINDOWS}, s AS (SELECT unnest([0, 1, 2, 3])::INT AS step, unnest(['open', 'training', 'publishing', 'ready']) AS state)
SELECT window_n, step, state FROM w JOIN s ON n >= 8 OR step = 0""")
def window_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 in batch form."""
    return cadence.state_changes(_windows(spark, sf_dir).withColumn("sealed", F.col("n") >= 8))


@REGISTRY.query("resume_point", f"""{SUBS} SELECT max(window_n) AS window_n, count(*) FILTER (WHERE env = 'error') AS checkpoint_n FROM subs""")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10."""
    s = lens.submissions(spark, sf_dir)
    return cadence.resume_point(s, s.select(F.concat(F.when(F.col("env") == "error", "checkpoint ").otherwise("checkpoints "), F.col("ord").cast("string")).alias("title")))


@REGISTRY.query("poll_addresses", """SELECT c_custkey, 'http://v' || '/state?env=' || replace(replace(c_name || ' ' || c_mktsegment, '#', '%23'), ' ', '%20') AS state_url,
'http://v/verdicts/' || replace(c_name, '#', '%23') || CASE WHEN c_acctbal > 0 THEN '?since=' || c_custkey::VARCHAR ELSE '' END AS verdicts_url FROM customer""")
def poll_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    since = F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
    urls = [cadence.state_address(F.lit("http://v"), F.concat_ws(" ", "c_name", "c_mktsegment")).alias("state_url"), cadence.verdicts_address(F.lit("http://v"), F.col("c_name"), since).alias("verdicts_url")]
    return table(spark, sf_dir, "customer").select("c_custkey", *urls)


@REGISTRY.query("poll_cursor", f"{SUBS} SELECT max(arrived_at) AS cursor, 1e12::DOUBLE AS kept FROM subs")
def poll_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll that finds rows moves the cursor, one that finds none keeps it."""
    s = lens.submissions(spark, sf_dir).withColumn("ts", F.col("arrived_at"))
    seen = cadence.next_cursor(state.since(s, 1000.0), 1000.0)
    none = cadence.next_cursor(state.since(s, 1e12), 1e12).withColumnRenamed("cursor", "kept")
    return seen.crossJoin(none)  # one row each


@REGISTRY.query("requeue_reasons", f"""{SUBS}, r AS (SELECT ord, ['stale_round', 'batch_filled', 'rate_limited', 'future_round', 'registration_unavailable', 'hotkey_not_registered', 'proof_fail', 'accepted'][1 + ord % 8] AS reason FROM subs)
SELECT reason, ord % 8 < 5 AS retryable, count(*) AS n FROM r GROUP BY ALL""")
def requeue_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C27 over reasons of both kinds."""
    names = ("stale_round", "batch_filled", "rate_limited", "future_round", "registration_unavailable", "hotkey_not_registered", "proof_fail", "accepted")
    reason = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("ord") % 8 + 1).cast("int"))
    return lens.submissions(spark, sf_dir).select(reason.alias("reason")).withColumn("retryable", F.col("reason").isin(*gates.RETRYABLE)).groupBy("reason", "retryable").agg(F.count(F.lit(1)).alias("n"))
