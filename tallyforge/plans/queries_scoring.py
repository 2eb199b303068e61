"""Queries over scores, state and slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators import posterior, probes, scoring, selection, state
from tallyforge.plans.base import REGISTRY, rounded
from tallyforge.plans.queries_selection import BATCH_CTES, sealed_batch
from tallyforge.plans.registry import table
from tallyforge.sources import lens

ALPHA = f"(2.0::DOUBLE / {DEFAULT.ema_span + 1})"
SLOTS = f"WITH RECURSIVE {BATCH_CTES}, sl AS (SELECT window_n, hotkey, count(*) AS n FROM batch GROUP BY ALL)"
EMA = f"""{SLOTS}, st AS (SELECT window_n, row_number() OVER (ORDER BY window_n) AS step FROM (SELECT DISTINCT window_n FROM subs)),
hk AS (SELECT DISTINCT hotkey FROM sl), dense AS (SELECT hotkey, step, coalesce(n, 0) AS n FROM hk CROSS JOIN st LEFT JOIN sl USING (hotkey, window_n)),
ema(hotkey, step, v) AS (SELECT hotkey, 0::BIGINT, 0.0::DOUBLE FROM hk
  UNION ALL SELECT d.hotkey, d.step, CASE WHEN {ALPHA} * (d.n / 8.0::DOUBLE) + (1 - {ALPHA}) * e.v > 1e-6 THEN {ALPHA} * (d.n / 8.0::DOUBLE) + (1 - {ALPHA}) * e.v ELSE 0.0::DOUBLE END
  FROM ema e JOIN dense d ON d.hotkey = e.hotkey AND d.step = e.step + 1),
sc AS (SELECT hotkey, v AS score FROM ema WHERE step = (SELECT max(step) FROM st) AND v > 1e-6)"""


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.submissions(spark, sf_dir).where("valid")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages over the sealed batches; every window that was opened is an archive record, an empty batch included."""
    windows = lens.submissions(spark, sf_dir).select("window_n").distinct()
    return scoring.ema_scores(sealed_batch(spark, sf_dir), archive=windows)


@REGISTRY.query("slot_share_by_window", f"{SLOTS} SELECT window_n, hotkey, n, round(n / 8.0, 6)::DOUBLE AS share FROM sl")
def slot_share_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, over the sealed batches."""
    return scoring.slots_per_window(sealed_batch(spark, sf_dir)).select("window_n", "hotkey", "n", F.round(F.col("n") / 8, 6).alias("share"))


@REGISTRY.query("ema_scores", f"{EMA} SELECT hotkey, round(score, 6) AS score FROM sc")
def ema_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6, J5."""
    return _scores(spark, sf_dir).select("hotkey", rounded("score"))


@REGISTRY.query("ema_burn_weights", f"""{EMA}, {lens.META_SQL}, lu AS (SELECT hotkey, arg_max(uid, pos) AS uid FROM meta GROUP BY hotkey)
SELECT uid, hotkey, round(score, 6) AS weight FROM sc JOIN lu USING (hotkey)
UNION ALL SELECT 0::BIGINT, NULL, round(b, 6) FROM (SELECT greatest(0.0, 1 - sum(score)) AS b FROM sc) WHERE b > 0""")
def ema_burn_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed batches to weights, with the burn."""
    scores = _scores(spark, sf_dir)
    return scoring.weights(scores, lens.metagraph(spark, sf_dir)).select("uid", "hotkey", rounded("weight"))


@REGISTRY.query("ema_top10", f"{EMA} SELECT hotkey, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, hotkey LIMIT 10")
def ema_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return scoring.top_weights(_scores(spark, sf_dir)).select("hotkey", rounded("score"))


YIELD = f"""WITH RECURSIVE {lens.SUBS_SQL}, o AS (SELECT env, CASE WHEN value > 245 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, row_number() OVER (PARTITION BY env ORDER BY arrived_at, ord) AS r FROM subs),
f(env, r, v) AS (SELECT env, r, x FROM o WHERE r = 1 UNION ALL SELECT o.env, o.r, 0.9::DOUBLE * f.v + 0.1::DOUBLE * o.x FROM f JOIN o ON o.env = f.env AND o.r = f.r + 1),
y AS (SELECT env, arg_max(v, r) AS ema FROM f GROUP BY env)"""


@REGISTRY.query("env_yield_ema", f"{YIELD} SELECT env, round(ema, 6) AS ema FROM y")
def env_yield_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E22."""
    rows = lens.submissions(spark, sf_dir).withColumn("x", (F.col("value") > 245).cast("double"))
    return scoring.ordered_ema(rows, "env", "x", ["arrived_at", "ord"], DEFAULT.yield_alpha).select("env", rounded("ema"))


@REGISTRY.query("largest_remainder_slots", f"""{YIELD}, q AS (SELECT env, row_number() OVER (ORDER BY env) AS pos, 3 * greatest(ema, 1e-9) / sum(greatest(ema, 1e-9)) OVER () AS quota FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY quota - floor(quota) DESC, pos) AS k, 3 - sum(floor(quota)) OVER () AS left_over FROM q)
SELECT env, (1 + floor(quota) + CASE WHEN k <= left_over THEN 1 ELSE 0 END)::BIGINT AS slots FROM r""")
def largest_remainder_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    rows = lens.submissions(spark, sf_dir).withColumn("x", (F.col("value") > 245).cast("double"))
    y = scoring.ordered_ema(rows, "env", "x", ["arrived_at", "ord"], DEFAULT.yield_alpha)
    return selection.slot_allocation(y.select(F.col("env").alias("pos"), "env", "ema"))


@REGISTRY.query("bake_deficit", f"""WITH {lens.SUBS_SQL}, t AS (SELECT env, 2 AS slots, count(*) AS have FROM subs GROUP BY env)
SELECT env, round(gap, 9) AS gap FROM (SELECT env, slots / sum(slots) OVER () - have / sum(have) OVER () AS gap FROM t) QUALIFY row_number() OVER (ORDER BY round(gap, 12) DESC, env) = 1""")
def bake_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, E16."""
    counts = lens.submissions(spark, sf_dir).groupBy("env").agg(F.count(F.lit(1)).alias("have"))
    return selection.furthest_below(counts.select("env", F.lit(2).alias("slots")), counts).select("env", rounded("gap", 9))


@REGISTRY.query("cooldown_active", f"WITH {lens.SUBS_SQL}, s AS (SELECT prompt_idx, max(window_n) AS last_window FROM subs WHERE valid AND window_n > 600 - 400 AND window_n < 600 GROUP BY prompt_idx) SELECT prompt_idx, last_window FROM s WHERE 600 - last_window < 24")
def cooldown_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8, E9, D2, M14, J4."""
    return state.cooling(state.last_batched(_valid(spark, sf_dir), 600, 400), 600, 24)


@REGISTRY.query("cooldown_list", f"WITH {lens.SUBS_SQL}, s AS (SELECT prompt_idx, max(window_n) AS w FROM subs WHERE valid AND window_n < 600 GROUP BY 1) SELECT list(DISTINCT prompt_idx ORDER BY prompt_idx) AS cooldown_prompts FROM s WHERE 600 - w < 24")
def cooldown_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, M11."""
    return state.cooldown_list(state.last_batched(_valid(spark, sf_dir), 600, 10_000), 600, 24)


@REGISTRY.query("reject_summary", f"WITH {lens.SUBS_SQL} SELECT window_n, env AS reason, count(*) AS n FROM subs WHERE env <> 'purchase' GROUP BY ALL")
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3; the map is opened again for the comparison."""
    rows = lens.submissions(spark, sf_dir).withColumn("reason", F.when(F.col("env") != "purchase", F.col("env")))
    return state.reject_summary(rows, by=["window_n"]).select("window_n", F.explode("reject_summary").alias("reason", "n"))


@REGISTRY.query("flip_sessions", f"""WITH {lens.SUBS_SQL}, f AS (SELECT hotkey, ord, env, CASE WHEN lag(env) OVER w <> env THEN 1 ELSE 0 END AS flip, arrived_at FROM subs WINDOW w AS (PARTITION BY hotkey ORDER BY arrived_at, ord)),
s AS (SELECT *, sum(flip) OVER (PARTITION BY hotkey ORDER BY arrived_at, ord) AS session FROM f) SELECT hotkey, session::BIGINT AS session, count(*) AS n, min(ord) AS first_ord FROM s GROUP BY ALL""")
def flip_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    rows = state.flip_sessions(lens.submissions(spark, sf_dir), "hotkey", ["arrived_at", "ord"], "env")
    return rows.groupBy("hotkey", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


@REGISTRY.query("replay_with_cooldown")
def replay_with_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive replay of batches, cooldown from the batches before."""
    return state.replay_batches(_valid(spark, sf_dir), cooldown=24)


BETA = f"WITH {lens.REWARDS_SQL}, r AS (SELECT partkey AS prompt_idx, env AS bucket, reward FROM rw)"


@REGISTRY.query("beta_posterior", f"{BETA} SELECT prompt_idx, bucket, 1.0::DOUBLE + sum(reward::INT) AS alpha, 1.0::DOUBLE + count(*) - sum(reward::INT) AS beta FROM r GROUP BY GROUPING SETS ((prompt_idx), (bucket))")
def beta_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E24, M19."""
    rows = lens.reward_groups(spark, sf_dir).select(F.col("partkey").alias("prompt_idx"), F.col("env").alias("bucket"), "reward")
    return posterior.beta_update(rows)


@REGISTRY.query("posterior_lookup", f"""{BETA}, p AS (SELECT prompt_idx, 1.0::DOUBLE + sum(reward::INT) AS a, 1.0::DOUBLE + count(*) - sum(reward::INT) AS b FROM r GROUP BY 1),
k AS (SELECT bucket, 1.0::DOUBLE + sum(reward::INT) AS a, 1.0::DOUBLE + count(*) - sum(reward::INT) AS b FROM r GROUP BY 1)
SELECT p_partkey AS prompt_idx, x.bucket, coalesce(p.a, k.a, 1.0::DOUBLE) AS alpha, coalesce(p.b, k.b, 1.0::DOUBLE) AS beta FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'O' WHEN p_size % 3 = 1 THEN 'F' ELSE 'Z' END AS bucket FROM part) x LEFT JOIN p ON p.prompt_idx = p_partkey LEFT JOIN k ON k.bucket = x.bucket""")
def posterior_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own posterior, else the bucket's, else 1 and 1."""
    rows = lens.reward_groups(spark, sf_dir).select(F.col("partkey").alias("prompt_idx"), F.col("env").alias("bucket"), "reward")
    bucket = F.when(F.col("p_size") % 3 == 0, "O").when(F.col("p_size") % 3 == 1, "F").otherwise("Z")
    return posterior.posterior_for(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_idx"), bucket.alias("bucket")), posterior.beta_update(rows))


@REGISTRY.query("in_zone_score", """WITH p AS (SELECT p_partkey AS prompt_idx, p_size / 50.0::DOUBLE AS p, p_size % 5 AS seen FROM part)
SELECT prompt_idx, round((28 * p**2 * (1-p)**6 + 56 * p**3 * (1-p)**5 + 70 * p**4 * (1-p)**4 + 56 * p**5 * (1-p)**3 + 28 * p**6 * (1-p)**2) * exp(-0.3 * seen), 6) AS score FROM p""")
def in_zone_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, G15."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_idx"), (F.col("p_size") / 50.0).alias("p"), (F.col("p_size") % 5).alias("seen"))
    return p.select("prompt_idx", (posterior.in_zone_probability(F.col("p")) * posterior.competitor_penalty(F.col("seen"))).alias("score")).select("prompt_idx", rounded("score"))


@REGISTRY.query("evidence_decay", """SELECT p_partkey AS prompt_idx, round(1 + power(0.5, p_size % 4) * (p_size - 1), 6)::DOUBLE AS alpha,
(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size // 2 WHEN 2 THEN (p_size // 2) // 2 ELSE ((p_size // 2) // 2) // 2 END)::BIGINT AS seen FROM part""")
def evidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E25, J14."""
    steps = F.col("p_size") % 4
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("prompt_idx"), posterior.decayed(F.col("p_size"), steps).alias("alpha"), posterior.decayed_count(F.col("p_size"), steps).alias("seen")).select("prompt_idx", rounded("alpha"), "seen")


@REGISTRY.query("thompson_next")
def thompson_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the arg-max of seeded draws."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_idx"), (1.0 + F.col("p_size")).alias("alpha"), (51.0 - F.col("p_size")).alias("beta"), F.lit(0).alias("seen"))
    cooling = p.where("prompt_idx % 7 = 0").select("prompt_idx")
    return posterior.next_prompt(p, cooling, seed=11)


AUC = """WITH s AS (SELECT l.quality AS y, (d.n_chars % 97)::DOUBLE AS x, d.lang FROM documents d JOIN labels l USING (doc_id)), r AS (SELECT *, rank() OVER {0} + (count(*) OVER {1} - 1) / 2.0 AS rk FROM s)
SELECT {2} count(*) AS n, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6)::DOUBLE AS auc FROM r {3}"""


@REGISTRY.query("auc_rank", AUC.format("(ORDER BY x)", "(PARTITION BY x)", "", ""))
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E26."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") % 97).cast("double").alias("x"), F.col("quality").alias("y"))
    return probes.auc(rows, "x", "y").select("n", rounded("auc"))


@REGISTRY.query("auc_by_source", AUC.format("(PARTITION BY lang ORDER BY x)", "(PARTITION BY lang, x)", "lang,", "GROUP BY lang"))
def auc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E26 per source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") % 97).cast("double").alias("x"), F.col("quality").alias("y"))
    return probes.auc(rows, "x", "y", ["lang"]).select("lang", "n", rounded("auc"))


@REGISTRY.query("probe_split", """WITH d AS (SELECT doc_id, lang, md5('split:' || doc_id) AS h FROM documents), a AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS r, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS g FROM d),
t AS (SELECT *, r <= 60 OR g <= 20 AS train FROM a), e AS (SELECT *, CASE WHEN train THEN NULL ELSE row_number() OVER (PARTITION BY train ORDER BY h, doc_id) END AS k FROM t)
SELECT doc_id, lang, CASE WHEN train THEN 'train' WHEN k <= 50 THEN 'test' END AS split FROM e""")
def probe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sampling with a floor for rare classes, which is the feature; all rows are returned with their part."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return probes.split_with_floor(rows, "doc_id", "lang", 60, 50, 20)


@REGISTRY.query("learning_prefixes", """SELECT f AS fraction, count(*) AS n, sum(item_id)::BIGINT AS ids FROM (SELECT item_id, percent_rank() OVER (ORDER BY md5('lc:' || item_id), item_id) AS p FROM benchmark), (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS f) WHERE p < f OR f >= 1.0 GROUP BY f""")
def learning_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    rows = table(spark, sf_dir, "benchmark").select("item_id")
    return probes.prefixes(rows, [probes.shuffled(F.col("item_id"), "lc"), F.col("item_id")]).groupBy("fraction").agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("ids"))
