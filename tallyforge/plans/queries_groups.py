"""Queries over reward groups and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators import gates, groups, state
from tallyforge.plans.base import REGISTRY, rounded
from tallyforge.plans.registry import table
from tallyforge.sources import lens

RW = f"WITH {lens.REWARDS_SQL}"


@REGISTRY.query("zone_groups", f"""{RW}, g AS (SELECT grp, count(*) AS n, stddev_pop(reward) AS s, min(reward) = max(reward) AS uniform FROM rw GROUP BY grp)
SELECT grp, n, round(s, 6) AS sigma, s >= 1e-8 AND s >= 0.33 AS in_zone, s >= 0.43 AS producer_zone, uniform FROM g""")
def zone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, C7, C19, C20, C23."""
    return groups.group_zone(lens.reward_groups(spark, sf_dir)).withColumn("sigma", F.round("sigma", 6))


@REGISTRY.query("advantages", f"{RW} SELECT grp, idx, round(CASE WHEN stddev_pop(reward) OVER w < 1e-8 THEN 0.0 ELSE (reward - avg(reward) OVER w) / stddev_pop(reward) OVER w END, 6)::DOUBLE AS adv FROM rw WINDOW w AS (PARTITION BY grp)")
def advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    return groups.advantages(lens.reward_groups(spark, sf_dir)).select("grp", "idx", rounded("adv"))


@REGISTRY.query("step_metrics", f"""{RW}, g AS (SELECT grp, stddev_pop(reward_c) AS s FROM rw GROUP BY grp)
SELECT (SELECT count(*) FROM g) AS n_groups, count(*) AS n_rollouts, round(avg(reward_c), 6) AS reward_mean, round(stddev_pop(reward_c), 6) AS reward_std, round(min(reward_c), 6) AS reward_min, round(max(reward_c), 6) AS reward_max,
(SELECT count(*) FROM g WHERE s < 1e-8) AS n_degenerate, round((SELECT avg((s < 1e-8)::INT) FROM g), 6) AS degenerate_ratio, round((SELECT avg(s) FROM g), 6) AS sigma_mean FROM rw""")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12, M27."""
    out = groups.step_metrics(lens.reward_groups(spark, sf_dir))
    return out.select(*[c if c.startswith("n_") else rounded(c) for c in out.columns])


@REGISTRY.query("early_drop", f"""{RW}, g AS (SELECT grp, min(reward) = max(reward) AS u, bool_or(quantity > 40) AS e, count(*) FILTER (WHERE quantity > 40 AND coalesce(tax >= 0.01, false)) AS n_bt_ok FROM rw GROUP BY grp)
SELECT grp, n_bt_ok, CASE WHEN u THEN 'uniform_rewards' WHEN NOT e THEN 'no_eos' WHEN n_bt_ok = 0 THEN 'no_bt_ok' END AS dropped FROM g""")
def early_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23, C24."""
    rows = lens.reward_groups(spark, sf_dir).withColumns({"in_eos": F.col("quantity") > 40, "p_stop": F.col("tax")})
    return groups.early_drop(rows)


@REGISTRY.query("dist_quantiles", f"""{RW}, p AS (SELECT partkey, (quantity - 0.5) / 50.0 AS p FROM rw), g AS (SELECT partkey, count(*) AS steps, avg(p) AS mean, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.1) AS q10, avg((p <= 0.1)::INT) AS low_frac, avg((p >= 0.9)::INT) AS high_frac FROM p GROUP BY 1)
SELECT partkey, steps, round(mean, 6) AS mean, round(median, 6) AS median, round(q10, 6) AS q10, round(low_frac, 6) AS low_frac, round(high_frac, 6) AS high_frac, CASE WHEN steps >= 30 THEN median >= 0.30 AND q10 >= 0.025 END AS dist_ok FROM g""")
def dist_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-valued verdict."""
    rows = lens.reward_groups(spark, sf_dir).withColumn("p", (F.col("quantity") - 0.5) / 50.0)
    out = groups.distribution_metrics(rows, "partkey", "p")
    return out.select("partkey", "steps", *[rounded(c) for c in ("mean", "median", "q10", "low_frac", "high_frac")], "dist_ok")


@REGISTRY.query("index_p95", f"""{RW}, s AS (SELECT suppkey, list(quantity ORDER BY quantity) AS v, count(*) AS n FROM rw GROUP BY 1)
SELECT suppkey, v[n // 2 + 1] AS upper_median, v[least(n - 1, floor(n * 0.95)::INT) + 1] AS p95_capped, v[floor((n - 1) * 0.95)::INT + 1] AS p95_span, CASE WHEN n % 2 = 1 THEN v[n // 2 + 1] ELSE (v[n // 2] + v[n // 2 + 1]) / 2 END AS median FROM s""")
def index_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three definitions side by side."""
    g = lens.reward_groups(spark, sf_dir).groupBy("suppkey").agg(F.collect_list("quantity").alias("v"))
    return g.select("suppkey", groups.index_quantiles(F.col("v")).alias("q")).select("suppkey", "q.*")


@REGISTRY.query("catch_rate", f"{RW} SELECT idx, count(*) AS n, round(avg((quantity > 25)::INT) * 100, 6) AS rate FROM rw GROUP BY idx")
def catch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15."""
    return groups.catch_rate(lens.reward_groups(spark, sf_dir), "idx", F.col("quantity") > 25).select("idx", "n", rounded("rate"))


@REGISTRY.query("probe_labels", f"""{RW}, g AS (SELECT grp, count(*) AS m, sum((reward = 1)::INT)::BIGINT AS k, stddev_pop(reward_c) AS s FROM rw GROUP BY grp)
SELECT grp, k, m, round(k / m, 6) AS p_correct, k BETWEEN 2 AND m - 2 AS in_zone, round(s, 6) AS sigma_c, s >= 0.43 AS in_zone_c FROM g""")
def probe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E19, E20, M23."""
    return groups.probe_labels(lens.reward_groups(spark, sf_dir)).select("grp", "k", "m", rounded("p_correct"), "in_zone", rounded("sigma_c"), "in_zone_c")


@REGISTRY.query("confusion", f"{RW} SELECT count(*) FILTER (WHERE tax > 0.04 AND reward = 1) AS \"both\", count(*) FILTER (WHERE tax > 0.04 AND reward <> 1) AS only_a, count(*) FILTER (WHERE NOT tax > 0.04 AND reward = 1) AS only_b, count(*) FILTER (WHERE NOT tax > 0.04 AND reward <> 1) AS neither FROM rw")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18."""
    return groups.confusion(lens.reward_groups(spark, sf_dir), F.col("tax") > 0.04, F.col("reward") == 1)


@REGISTRY.query("pass_fraction", f"{RW} SELECT grp, round(avg(reward), 6) AS passed, count(DISTINCT env) AS envs, count(*) = 8 AND count(DISTINCT env) = 1 AS request_ok FROM rw GROUP BY grp")
def pass_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21, C16."""
    g = lens.reward_groups(spark, sf_dir).groupBy("grp").agg(F.avg("reward").alias("passed"), F.count(F.lit(1)).alias("n"), F.collect_list("env").alias("list"))
    return g.select("grp", rounded("passed"), F.size(F.array_distinct("list")).cast("bigint").alias("envs"), gates.request_ok(F.col("n"), F.col("list")).alias("request_ok"))


@REGISTRY.query("source_breakdown", "WITH e AS (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) AS lang) SELECT e.lang, count(d.doc_id) AS n FROM e LEFT JOIN documents d USING (lang) GROUP BY e.lang")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero fill from the list of sources."""
    names = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "xx")], "lang string")
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


def _submission_gates(config=DEFAULT) -> list[gates.Gate]:  # noqa: ANN001
    return [*gates.window_gates(F.col("current"), F.lit("ckpt1"), F.lit(95)), *gates.reward_gates(F.lit(config.sigma_steady), config)]


@REGISTRY.query("first_reject_reason", f"""WITH {lens.SUBS_SQL}, s AS (SELECT ord, window_n, CASE WHEN ord % 11 = 0 THEN window_n + 1 ELSE window_n END AS current, CASE WHEN ord % 13 = 0 THEN 'ckpt0' ELSE 'ckpt1' END AS ck, prompt_idx, prompt_idx % 10 = 3 AS cool, CASE WHEN ord % 17 = 0 THEN 1e-3 ELSE 0.0 END AS gap, (ord % 9) / 8.0 AS p FROM subs)
SELECT ord, CASE WHEN window_n <> current THEN 'window_mismatch' WHEN ck <> 'ckpt1' THEN 'wrong_checkpoint' WHEN prompt_idx >= 95 THEN 'bad_prompt_idx' WHEN cool THEN 'prompt_in_cooldown' WHEN gap > 1e-6 THEN 'reward_mismatch' WHEN sqrt(p * (1 - p)) < 1e-8 OR sqrt(p * (1 - p)) < 0.33 THEN 'out_of_zone' END AS reason FROM s""")
def first_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CASE for the chain."""
    s = lens.submissions(spark, sf_dir)
    p = (F.col("ord") % 9) / 8.0
    s = s.withColumns({
        "current": F.when(F.col("ord") % 11 == 0, F.col("window_n") + 1).otherwise(F.col("window_n")), "checkpoint_hash": F.when(F.col("ord") % 13 == 0, "ckpt0").otherwise("ckpt1"),
        "in_cooldown": F.col("prompt_idx") % 10 == 3, "reward_gap": F.when(F.col("ord") % 17 == 0, 1e-3).otherwise(0.0), "sigma": F.sqrt(p * (1 - p)),
    })
    return s.select("ord", gates.first_failure(_submission_gates()).alias("reason"))


@REGISTRY.query("rollout_gate_chain", f"""{RW}, j AS (SELECT grp, idx, CASE WHEN quantity < 3 THEN 'bad_schema' WHEN partkey % 29 = 0 THEN 'bad_tokens' WHEN partkey % 31 = 0 THEN 'prompt_mismatch' WHEN suppkey % 37 = 0 THEN 'bad_signature' WHEN quantity > 49 THEN 'proof_fail' WHEN tax < 0.005 THEN 'bad_termination'
 WHEN reward_c > 0.95 THEN 'logprob_mismatch' WHEN CASE WHEN idx > 5 THEN NULL ELSE NOT quantity >= 5 END THEN 'distribution_suspicious' END AS reason, quantity, reward_c, tax FROM rw)
SELECT grp, arg_min(reason, struct_pack(i := idx, r := reason)) FILTER (WHERE reason IS NOT NULL) AS rollout_reason, max(quantity) AS sketch_diff_max, round(max(CASE WHEN idx % 4 <> 0 THEN reward_c END), 6) AS lp_dev_max, min(CASE WHEN idx % 3 <> 0 THEN tax END) AS dist_q10_min FROM j GROUP BY grp""")
def rollout_gate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8-C15 and the assembly of the worst measurements; null verdicts pass, infinite deviations are left out."""
    r = lens.reward_groups(spark, sf_dir)
    judged = r.withColumns({
        "schema_ok": F.col("quantity") >= 3, "tokens_ok": F.col("partkey") % 29 != 0, "prompt_ok": F.col("partkey") % 31 != 0, "signature_ok": F.col("suppkey") % 37 != 0,
        "proof_ok": F.col("quantity") <= 49, "termination_ok": F.col("tax") >= 0.005, "real_dev": F.col("reward_c"), "dist_ok": F.when(F.col("idx") <= 5, F.col("quantity") >= 5),
        "sketch_diff": F.col("quantity"), "q10": F.when(F.col("idx") % 3 != 0, F.col("tax")),
    })
    chain = [g if g.reason != "logprob_mismatch" else gates.Gate(g.reason, F.col("real_dev") > 0.95) for g in gates.rollout_gates()]
    judged = judged.withColumn("lp_dev", F.when(F.col("idx") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("reward_c")))
    return gates.assemble(judged, ["grp"], chain).withColumn("lp_dev_max", F.round("lp_dev_max", 6))


@REGISTRY.query("claim_superseded", f"""WITH {lens.SUBS_SQL}, s AS (SELECT *, prompt_idx % 10 <> 3 AS b, valid AS a FROM subs),
c AS (SELECT *, min(CASE WHEN b AND a THEN arrived_at END) OVER (PARTITION BY window_n, prompt_idx) AS claim FROM s)
SELECT ord, CASE WHEN NOT b THEN 'rejected_before' WHEN claim IS NOT NULL AND arrived_at > claim THEN 'superseded' WHEN NOT a THEN 'rejected_after' ELSE 'accepted' END AS outcome FROM c""")
def claim_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5, F2, J3."""
    from tallyforge.operators.selection import first_accepted

    return first_accepted(lens.submissions(spark, sf_dir), F.col("prompt_idx") % 10 != 3, F.col("valid")).select("ord", "outcome")


@REGISTRY.query("field_constraints", f"""WITH {lens.SUBS_SQL} SELECT ord, CASE WHEN prompt_idx - 2 < 0 THEN 'prompt_idx' WHEN window_n - 3 < 0 THEN 'window_start' WHEN ord % 19 = 0 THEN 'merkle_root' WHEN ord % 23 = 0 THEN 'nonce' END AS reason,
CASE WHEN ord % 5 = 0 THEN 'window_not_active' WHEN ord % 7 = 0 THEN 'window_mismatch' END AS server, CASE ord % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'window_not_active' WHEN 2 THEN 'window_mismatch' WHEN 3 THEN 'bad_schema' WHEN 4 THEN 'http_client_error' ELSE 'retry' END AS http, env IN ('stale_round') AS retryable FROM subs""")
def field_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17, C18, C27, C28."""
    s = lens.submissions(spark, sf_dir)
    s = s.withColumns({
        "prompt_idx": F.col("prompt_idx") - 2, "window_start": F.col("window_n") - 3, "checkpoint_hash": F.lit("c"), "nonce": F.when(F.col("ord") % 23 == 0, F.repeat(F.lit("n"), 129)).otherwise("n"),
        "merkle_root": F.when(F.col("ord") % 19 == 0, "xyz").otherwise(F.sha2(F.col("ord").cast("string"), 256)),
    })
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 503, 409, 422, 404, 500)]), (F.col("ord") % 6 + 1).cast("int"))
    server = gates.server_gate(F.when(F.col("ord") % 5 == 0, "training").otherwise("open"), F.col("window_n"), F.when(F.col("ord") % 7 == 0, F.col("window_n") + 1).otherwise(F.col("window_n")))
    return s.select("ord", gates.first_failure(gates.field_gates()).alias("reason"), server.alias("server"), gates.http_reason(status).alias("http"), F.col("env").isin(*gates.RETRYABLE).alias("retryable"))


@REGISTRY.query("retry_phases", f"{RW}, t AS (SELECT grp, count(*) AS total FROM rw GROUP BY grp) SELECT grp, total, total // 2 AS phase, total // 2 < 3 AS retry FROM t")
def retry_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, J12."""
    r = lens.reward_groups(spark, sf_dir).select("grp", "idx")
    return state.retry_queue(r.where("idx <= 3"), r.where("idx > 3"), phase_size=2).withColumn("phase", F.col("phase").cast("bigint"))
