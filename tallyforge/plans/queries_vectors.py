"""Queries over vectors, hashes and protocol arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import hashing
from tallyforge.operators import probes, vectors
from tallyforge.plans.base import REGISTRY, rounded
from tallyforge.plans.registry import table
from tallyforge.sources import lens

VEC = f"WITH {lens.VECTORS_SQL}"
#: Any window's randomness; its coefficients are a literal on both sides.
RANDOMNESS = "a1b2c3d4"
COEFFICIENTS = hashing.coefficient_vector(RANDOMNESS, 16)
BUCKET = "(CASE WHEN abs({0}) < 1e-6 THEN 0 ELSE (CASE WHEN {0} < 0 THEN -1 ELSE 1 END) * least(7, floor(log2(abs({0}) + 1) * 0.8)) END)::BIGINT"


@REGISTRY.query("magnitude_buckets", f"{VEC}, e AS (SELECT vec_id, unnest(v) AS x FROM vec) SELECT {BUCKET.format('x')} AS bucket, count(*) AS n FROM e GROUP BY 1")
def magnitude_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return lens.vectors(spark, sf_dir).select(F.explode("v").alias("x")).groupBy(vectors.magnitude_bucket(F.col("x")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


SKETCH = f"""{VEC}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS r FROM e QUALIFY r <= 16),
p AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM t), s AS (SELECT vec_id, sum({BUCKET.format('x')} * ({COEFFICIENTS})[k])::BIGINT AS raw FROM p GROUP BY 1),
sk AS (SELECT vec_id, ((raw % 2147483647) + 2147483647) % 2147483647 AS sketch FROM s)"""


@REGISTRY.query("sketch_embeddings", f"{SKETCH} SELECT vec_id, sketch FROM sk")
def sketch_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top magnitudes, buckets and coefficients."""
    return lens.vectors(spark, sf_dir).select("vec_id", vectors.sketch(F.col("v"), COEFFICIENTS).alias("sketch"))


@REGISTRY.query("proof_verdict", f"""{SKETCH}, d AS (SELECT a.vec_id // 10 AS rollout, least(abs(a.sketch - b.sketch), 2147483647 - abs(a.sketch - b.sketch)) AS diff, floor(5000 + 5.0 * sqrt(a.vec_id))::BIGINT AS tol FROM sk a JOIN sk b ON b.vec_id = a.vec_id + 1)
SELECT rollout, bool_and(diff <= tol) AND count(diff) >= 8 AS proof_ok, max(diff)::BIGINT AS sketch_diff_max FROM d GROUP BY rollout""")
def proof_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed and recomputed sketches at equal positions."""
    from tallyforge.operators.gates import proof_verdict as verdict

    s = sketch_embeddings(spark, sf_dir)
    other = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("sketch").alias("claimed"))
    rows = s.join(other, "vec_id").select(F.floor(F.col("vec_id") / 10).alias("rollout"), hashing.modular_distance(F.col("sketch"), F.col("claimed")).alias("diff"), hashing.sketch_tolerance(F.col("vec_id")).alias("tolerance"))
    return verdict(rows, ["rollout"], 8)


@REGISTRY.query("topk_threshold", f"{VEC} SELECT vec_id, round(list_reverse_sort(v)[20], 6) AS kth, len(list_filter(v, lambda x: x >= list_reverse_sort(v)[20]))::BIGINT AS kept FROM vec")
def topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ties at the k-th stay."""
    rows = lens.vectors(spark, sf_dir).withColumn("kth", F.get(F.sort_array("v", asc=False), F.lit(19)))
    return rows.select("vec_id", F.size(F.filter("v", lambda x: x >= F.col("kth"))).cast("bigint").alias("kept"), F.round("kth", 6).alias("kth"))


WARP = f"""{VEC}, e AS (SELECT vec_id, unnest(v) / 40.0 / 0.6 AS x, generate_subscripts(v, 1) - 1 AS i FROM vec), k AS (SELECT *, dense_rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS dr, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r, max(x) OVER (PARTITION BY vec_id) AS m FROM e),
p AS (SELECT vec_id, i, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS p FROM k WHERE r <= 20), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
q AS (SELECT vec_id, i, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM c WHERE before < 0.95)"""


@REGISTRY.query("nucleus_probs", f"{WARP} SELECT vec_id, count(*) AS kept, round(max(p), 6) AS top_prob FROM q GROUP BY vec_id")
def nucleus_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature, top-k, top-p, the crossing token included."""
    rows = vectors.warp(lens.vectors(spark, sf_dir, 1.0), "v")
    return rows.select("vec_id", F.size(F.filter("probs", lambda p: p > 0)).cast("bigint").alias("kept"), F.round(F.array_max("probs"), 6).alias("top_prob"))


DRAW = "('0x' || substr(sha256('forced-seed-v2'::BLOB || unhex('0008') || 'a1b2c3d4'::BLOB || unhex(printf('%016x', vec_id)) || unhex('0005') || 'ckpt1'::BLOB || unhex('00000003') || unhex(printf('%08x', label))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


def _draw(df: DataFrame) -> DataFrame:
    return df.withColumn("u", hashing.uniform_draw(F.lit(RANDOMNESS), F.col("vec_id"), F.lit("ckpt1"), F.lit(3), F.col("label")))


@REGISTRY.query("uniform_draw", f"{VEC} SELECT vec_id, {DRAW} AS u FROM vec")
def uniform_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return _draw(lens.vectors(spark, sf_dir)).select("vec_id", "u")


@REGISTRY.query("nucleus_pick", f"""{WARP}, u AS (SELECT vec_id, {DRAW} AS u FROM vec), cdf AS (SELECT vec_id, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) AS cdf FROM q)
SELECT vec_id, coalesce(min(i) FILTER (WHERE cdf > u), 63)::INT AS picked FROM cdf JOIN u USING (vec_id) GROUP BY vec_id""")
def nucleus_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    rows = _draw(vectors.warp(lens.vectors(spark, sf_dir, 1.0), "v"))
    return rows.select("vec_id", vectors.inverse_cdf(F.col("probs"), F.col("u")).alias("picked"))


@REGISTRY.query("seed_consistency", f"""{WARP}, u AS (SELECT vec_id, {DRAW} AS u FROM vec), cdf AS (SELECT vec_id, i, p, sum(p) OVER (PARTITION BY vec_id ORDER BY i) AS cdf FROM q),
pk AS (SELECT vec_id, coalesce(min(i) FILTER (WHERE cdf > u), 63) AS picked, max(p) AS top FROM cdf JOIN u USING (vec_id) GROUP BY vec_id),
r AS (SELECT vec_id // 25 AS rollout, count(*) FILTER (WHERE top < 0.99) AS n_stochastic, count(*) FILTER (WHERE top < 0.99 AND (CASE WHEN vec_id % 7 = 0 THEN -1 ELSE picked END) = picked) AS n_match FROM pk GROUP BY 1),
g AS (SELECT rollout // 4 AS grp, sum(n_stochastic)::BIGINT AS n, sum(n_match) / nullif(sum(n_stochastic), 0) AS group_ratio, min(n_match / nullif(n_stochastic, 0)) FILTER (WHERE n_stochastic >= 20) AS worst_ratio FROM r GROUP BY 1)
SELECT grp, n, round(group_ratio, 6) AS group_ratio, round(worst_ratio, 6) AS worst_ratio, CASE WHEN n >= 30 THEN group_ratio >= 0.8 AND coalesce(worst_ratio >= 0.75, true) END AS seed_ok FROM g""")
def seed_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C33, E27."""
    rows = _draw(vectors.warp(lens.vectors(spark, sf_dir, 1.0), "v")).withColumn("picked", vectors.inverse_cdf(F.col("probs"), F.col("u")))
    rows = rows.select(F.floor(F.col("vec_id") / 25).alias("rollout"), "picked", F.array_max("probs").alias("top_prob"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("picked")).alias("token"))
    per = vectors.seed_consistency(rows, ["rollout"]).withColumn("grp", F.floor(F.col("rollout") / 4))
    return vectors.seed_floors(per, "grp").select("grp", "n", rounded("group_ratio"), rounded("worst_ratio"), "seed_ok")


@REGISTRY.query("logprob_check", f"""WITH {lens.REWARDS_SQL}, d AS (SELECT partkey, exp(abs(-quantity / 10 - (-quantity / 10 + tax))) - 1 AS dev FROM rw), g AS (SELECT partkey, count(*) AS n, median(dev) AS m FROM d GROUP BY 1)
SELECT partkey, n, round(CASE WHEN n >= 32 THEN m END, 6) AS lp_dev, CASE WHEN n >= 32 THEN m <= 0.04 ELSE false END AS lp_ok FROM g""")
def logprob_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: infinity where there are too few positions (null here, for the comparison)."""
    rows = lens.reward_groups(spark, sf_dir).select("partkey", (-F.col("quantity") / 10).alias("model_lp"), (-F.col("quantity") / 10 + F.col("tax")).alias("claimed_lp"))
    out = vectors.logprob_deviation(rows, ["partkey"], epsilon=0.04)
    return out.select("partkey", "n", F.round(F.when(F.col("lp_dev") != float("inf"), F.col("lp_dev")), 6).alias("lp_dev"), "lp_ok")


@REGISTRY.query("pairwise_drift", f"""{SKETCH}, ps AS (SELECT sk.vec_id, sketch, row_number() OVER (PARTITION BY label ORDER BY sk.vec_id) AS pos, label FROM sk JOIN vec USING (vec_id))
SELECT a.label AS a, b.label AS b, count(*) AS n, max(least(abs(a.sketch - b.sketch), 2147483647 - abs(a.sketch - b.sketch)))::BIGINT AS worst, round(avg(least(abs(a.sketch - b.sketch), 2147483647 - abs(a.sketch - b.sketch))), 3) AS mean
FROM ps a JOIN ps b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL""")
def pairwise_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are hardware runs here, a handful."""
    from pyspark.sql import Window as W

    rows = lens.vectors(spark, sf_dir).select("label", "vec_id", vectors.sketch(F.col("v"), COEFFICIENTS).alias("sketch"))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("label").orderBy("vec_id")))
    return probes.pairwise_drift(rows, "label", "pos", "sketch", hashing.modular_distance).withColumn("mean", F.round("mean", 3))


@REGISTRY.query("dot_mod", f"{VEC} SELECT vec_id, ((list_sum(list_transform(list_zip(v, {COEFFICIENTS * 4}), lambda z: round_even(z[1] * 1024, 0)::BIGINT * z[2]))::BIGINT % 2147483647) + 2147483647) % 2147483647 AS dot FROM vec")
def dot_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return lens.vectors(spark, sf_dir).select("vec_id", vectors.dot_mod(F.col("v"), F.array(*[F.lit(c) for c in COEFFICIENTS * 4])).alias("dot"))


@REGISTRY.query("prompt_range", """WITH r AS (SELECT o_orderkey, printf('%08x', o_orderkey) AS rnd, 1000 + o_custkey AS n FROM orders), h AS (SELECT *, ('0x' || substr(sha256('prompt-range/v1|math|' || rnd), 1, 16))::UBIGINT AS d FROM r)
SELECT o_orderkey, CASE WHEN n <= 1500 THEN 0 ELSE d % (n - 1500)::UBIGINT END::BIGINT AS lo, CASE WHEN n <= 1500 THEN n ELSE d % (n - 1500)::UBIGINT + 1500 END::BIGINT AS hi FROM h""")
def prompt_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    o = table(spark, sf_dir, "orders")
    rng = hashing.prompt_range(F.lower(F.lpad(F.hex("o_orderkey"), 8, "0")), F.lit("math"), F.col("o_custkey") + 1000, 1500)
    return o.select("o_orderkey", rng.alias("r")).select("o_orderkey", "r.lo", "r.hi")


@REGISTRY.query("token_hash", "SELECT o_orderkey, sha256(unhex(printf('%08x%08x', o_orderkey, o_custkey))) AS h FROM orders")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.token_hash(F.array("o_orderkey", "o_custkey")).alias("h"))


@REGISTRY.query("tiebreak_hash", f"WITH {lens.SUBS_SQL} SELECT ord, sha256(encode(hotkey) || unhex(printf('%016x', prompt_idx)) || root) AS h FROM subs")
def tiebreak_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1's tie rule."""
    return lens.submissions(spark, sf_dir).select("ord", hashing.tiebreak(F.col("hotkey"), F.col("prompt_idx"), F.col("root")).alias("h"))


@REGISTRY.query("beacon_rounds", """SELECT o_orderkey, CASE WHEN o_custkey * 12 < 3000 THEN 1 ELSE 1 + (o_custkey * 12 - 3000) // 7 END::BIGINT AS round, CASE WHEN o_custkey * 12 < 3000 THEN 0 ELSE 1 + (o_custkey * 12 - 3000) // 7 END::BIGINT AS round0,
CASE WHEN o_custkey * 12 < 3000 THEN 3000 - o_custkey * 12 WHEN (o_custkey * 12 - 3000) % 7 = 0 THEN 0 ELSE 7 - (o_custkey * 12 - 3000) % 7 END::DOUBLE AS seconds FROM orders""")
def beacon_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G16."""
    ts = F.col("o_custkey") * 12
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.beacon_round(ts, 3000, 7).alias("round"), hashing.round_at(ts, 3000, 7).alias("round0"), hashing.seconds_to_boundary(ts, 3000, 7).alias("seconds"))


@REGISTRY.query("window_randomness", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN printf('%08x', o_custkey) ELSE sha256(unhex(printf('%08x', o_custkey)) || unhex(printf('%08x', o_orderkey)) || CASE WHEN o_orderkey % 3 = 0 THEN ''::BLOB ELSE unhex(printf('%016x', o_orderkey)) END) END AS seed,
sha256(unhex(printf('%08x', o_orderkey))) = sha256(unhex(printf('%08x', o_orderkey - o_orderkey % 2))) AS beacon_ok FROM orders""")
def window_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C30, G17, G22."""
    h = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    key = F.col("o_orderkey")
    seed = hashing.window_randomness(F.concat(F.lit("0x"), h("o_custkey")), F.when(key % 5 != 0, h("o_orderkey")), F.when(key % 3 != 0, key))
    ok = hashing.beacon_valid(h("o_orderkey"), F.sha2(F.unhex(h(key - key % 2)), 256))
    return table(spark, sf_dir, "orders").select("o_orderkey", seed.alias("seed"), ok.alias("beacon_ok"))


def _lp(blob: str, width: int = 4) -> str:
    return f"unhex(printf('%0{2 * width}x', octet_length({blob}))) || {blob}"


ENVELOPE = " || ".join(_lp(x) for x in ("encode(hotkey)", "unhex(printf('%016x', window_n))", "unhex(printf('%016x', prompt_idx))", "root", "'ck'::BLOB", "unhex(printf('%016x', ord))", "unhex('a1b2c3d4')", "'n'::BLOB"))
ENVELOPE2 = ENVELOPE.replace(_lp("unhex('a1b2c3d4')"), _lp("unhex('0000000000000002')") + " || " + _lp("unhex('a1b2c3d4')"))


@REGISTRY.query("envelope_binding", f"WITH {lens.SUBS_SQL} SELECT ord, sha256('envelope-v1'::BLOB || {ENVELOPE}) AS v1, sha256('envelope-v2'::BLOB || {ENVELOPE2}) AS v2 FROM subs")
def envelope_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field behind its length."""
    s = lens.submissions(spark, sf_dir)
    args = [F.col("hotkey"), F.col("window_n"), F.col("prompt_idx"), F.hex("root"), F.lit("ck"), F.col("ord"), F.lit("0x" + RANDOMNESS), F.lit("n")]
    return s.select("ord", hashing.envelope_binding(*args).alias("v1"), hashing.envelope_binding(*args, domain="envelope-v2", version=2).alias("v2"))


@REGISTRY.query("problem_ids", "SELECT doc_id, substr(sha256(encode(text)), 1, 16) AS id, floor(5000 + 5.0 * sqrt(n_chars))::BIGINT AS tolerance FROM documents")
def problem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20, C31."""
    return table(spark, sf_dir, "documents").select("doc_id", hashing.problem_id(F.col("text")).alias("id"), hashing.sketch_tolerance(F.col("n_chars")).alias("tolerance"))


@REGISTRY.query("merkle_roots")
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots over canonical JSON leaves of each order's rollouts."""
    leaf = F.to_json(F.struct("idx", "reward", "env"))
    rows = lens.reward_groups(spark, sf_dir).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("idx", leaf.alias("leaf")))).alias("x"))
    return rows.select("grp", hashing.merkle_root_udf(F.transform("x", lambda s: s["leaf"])).alias("root"))


@REGISTRY.query("challenge_positions")
def challenge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions drawn by the seeded generator of CPython."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 1000, F.col("o_custkey")).alias("tokens"), F.lit(RANDOMNESS).alias("r"), F.lit(4).alias("a"), (F.lit(40) + F.col("o_custkey") % 100).alias("b"))
    return rows.select("o_orderkey", hashing.challenge_udf("tokens", "r", "a", "b").alias("positions"))


@REGISTRY.query("forced_termination", f"""WITH {lens.REWARDS_SQL}, t AS (SELECT grp, list(partkey % 20 ORDER BY idx, partkey % 20) AS tokens FROM rw GROUP BY grp),
s AS (SELECT grp, tokens, tokens[2:] AS gen FROM t), e AS (SELECT *, CASE WHEN list_contains(gen, 3) THEN 'eos' WHEN list_contains(gen, 5) THEN 'closed' ELSE 'forced' END AS state FROM s)
SELECT grp, state, CASE state WHEN 'eos' THEN tokens[1:1] || gen[1:list_position(gen, 3)] WHEN 'forced' THEN tokens || [90, 91]::BIGINT[] ELSE tokens END AS primed, CASE WHEN state = 'forced' THEN len(tokens)::INT END AS force_start, CASE WHEN state = 'forced' THEN (len(tokens) + 2)::INT END AS force_end FROM e""")
def forced_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H22, F17."""
    rows = lens.reward_groups(spark, sf_dir).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("idx", (F.col("partkey") % 20).alias("t")))).alias("x"))
    rows = rows.select("grp", F.transform("x", lambda s: s["t"]).alias("tokens"), F.lit(1).alias("plen"))
    out = vectors.forced_termination(rows, "plen", [5], [3], [90, 91])
    return out.select("grp", "state", F.col("primed").cast("array<bigint>").alias("primed"), "force_start", "force_end")


@REGISTRY.query("policy_terms", f"""WITH {lens.REWARDS_SQL} SELECT grp, round(sum(least((1 + tax) * (reward - 0.5), least(greatest(1 + tax, 0.8), 1.28) * (reward - 0.5))), 6) AS surrogate, round(avg(exp(tax - reward_c) - (tax - reward_c) - 1), 6) AS kl FROM rw GROUP BY grp""")
def policy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21."""
    r = lens.reward_groups(spark, sf_dir)
    return r.groupBy("grp").agg(F.sum(vectors.clipped_surrogate(1 + F.col("tax"), F.col("reward") - 0.5)).alias("surrogate"), F.avg(vectors.k3(F.col("reward_c"), F.col("tax"))).alias("kl")).select("grp", rounded("surrogate"), rounded("kl"))


