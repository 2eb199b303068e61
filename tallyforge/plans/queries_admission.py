"""The admission chain over orders as submissions and their lines as rollouts, and the batch it leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators import admission, gates, scoring, selection
from tallyforge.plans.base import REGISTRY, rounded
from tallyforge.plans.registry import table

VOCABULARY, PROMPT, COMPLETION, EOS = 1000, 4, 32, 2


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as submissions: a window is a year, a prompt a customer; some come for another window or checkpoint or are out of range."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cooling = table(spark, sf_dir, "customer").where("c_acctbal < 0 AND c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("cool"))
    o = o.join(cooling, "o_custkey", "left")
    return o.select(
        key.alias("ord"), F.concat(F.lit("h"), F.col("o_custkey") % 50).alias("hotkey"), F.year("o_orderdate").cast("bigint").alias("window_n"), (F.col("o_custkey") + F.when(key % 19 == 0, 10**9).otherwise(0)).alias("prompt_idx"),
        (key * 1.0).cast("double").alias("arrived_at"), (F.year("o_orderdate") + F.when(key % 11 == 0, 1).otherwise(0)).cast("bigint").alias("current"), F.when(key % 13 == 0, "old").otherwise("new").alias("checkpoint_hash"),
        F.coalesce("cool", F.lit(False)).alias("in_cooldown"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as rollouts without their arrays (line numbers repeat here, so part and supplier make them unique)."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    rows = li.select(
        F.col("l_orderkey").alias("ord"), ((F.col("l_linenumber") * 10_000_000 + pk) * 1_000_000 + sk).alias("idx"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"), pk.alias("pk"), sk.alias("sk"),
        F.col("l_quantity").cast("bigint").alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("o_custkey").alias("cust"),
    )
    return rows.withColumn("truth", F.col("reward") + F.when(F.col("pk") % 41 == 0, 0.5).otherwise(0.0))


def with_arrays(rows: DataFrame) -> DataFrame:
    """Lines with their arrays; every array is made from the line, and some break one rule."""
    q, pk, sk, c = F.col("q"), F.col("pk"), F.col("sk"), F.col("cust")
    at = lambda low, high: F.sequence(F.lit(low), F.lit(high))
    canonical = F.transform(at(0, PROMPT - 1), lambda i: ((c + i) % 997).cast("int"))
    given = F.transform(at(0, PROMPT - 1), lambda i: ((c + i + F.when((pk % 31 == 0) & (i == 3), 1).otherwise(0)) % 997).cast("int"))
    body = F.transform(at(PROMPT, PROMPT + COMPLETION - 2), lambda i: ((pk + i * sk) % 997).cast("int"))
    body = F.when(pk % 29 == 0, F.transform(body, lambda t, k: F.when(k == 10 - PROMPT, VOCABULARY).otherwise(t))).otherwise(body)
    tokens = F.concat(given, body, F.array(F.when(q % 17 == 0, 5).otherwise(EOS)))
    lp = lambda i: -0.01 * ((i * q) % 30)
    rows = rows.withColumns({
        "canonical": canonical, "tokens": tokens, "prompt_length": F.lit(PROMPT), "completion_length": F.lit(COMPLETION),
        "commitments": F.transform(at(1, PROMPT + COMPLETION), lambda i: (i * pk) % 1000), "logprobs": F.transform(at(PROMPT, PROMPT + COMPLETION - 1), lp),
    })
    return rows.withColumns({
        "commitments": F.when(F.col("q") < 3, F.slice("commitments", 1, PROMPT + COMPLETION - 1)).otherwise(F.col("commitments")),
        "signature": F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>"), F.when(F.col("pk") % 37 == 0, F.lit("x"))), 256), "positions": at(PROMPT, PROMPT + COMPLETION - 1),
        "diffs": F.transform(at(PROMPT, PROMPT + COMPLETION - 1), lambda i: (pk * i) % 4000),
        "gap": F.when(F.col("disc") > 0.095, 0.2).otherwise(F.col("disc") / 10), "p_stop": F.when(F.col("tax") < 0.005, 0.005).otherwise(0.5),
        "chosen": F.when(pk % 23 == 0, F.transform(at(0, COMPLETION - 1), lambda i: (i % 10) / 100)).otherwise(F.transform(at(0, COMPLETION - 1), lambda i: 0.5 + ((i + pk) % 50) / 100)),
    }).withColumns({
        "diffs": F.when(sk % 43 == 0, F.transform("diffs", lambda x, k: x + F.when(k == 20 - PROMPT, 30_000).otherwise(0))).otherwise(F.col("diffs")), "model_lp": F.transform("logprobs", lambda x: x + F.col("gap")),
    }).drop("gap")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its arrays."""
    return with_arrays(lines(spark, sf_dir))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submission with its reason."""
    before = gates.window_gates(F.col("current"), F.lit("new"), F.lit(10**9))
    binding = F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")), 256)
    return admission.admit(
        submissions(spark, sf_dir), lines(spark, sf_dir), before, gates.reward_gates(F.lit(DEFAULT.sigma_steady)), admission.cheap_gates(VOCABULARY), admission.dear_gates(binding, F.array(F.lit(EOS))), arrays=with_arrays
    )


ADMITTED = """li AS (SELECT l_orderkey AS ord, (l_linenumber::BIGINT * 10000000 + l_partkey) * 1000000 + l_suppkey AS idx, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, l_partkey AS pk, l_suppkey AS sk, l_quantity::BIGINT AS q, l_discount AS disc, l_tax AS tax FROM lineitem),
s AS (SELECT o_orderkey AS ord, 'h' || (o_custkey % 50) AS hotkey, year(o_orderdate)::BIGINT AS window_n, o_custkey + CASE WHEN o_orderkey % 19 = 0 THEN 1000000000 ELSE 0 END AS prompt_idx,
  CASE WHEN o_orderkey % 11 = 0 THEN 'window_mismatch' WHEN o_orderkey % 13 = 0 THEN 'wrong_checkpoint' WHEN o_orderkey % 19 = 0 THEN 'bad_prompt_idx' WHEN c_custkey IS NOT NULL THEN 'prompt_in_cooldown' END AS first
  FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING') ON c_custkey = o_custkey),
g AS (SELECT ord, stddev_pop(reward) AS sigma, CASE WHEN bool_or(pk % 41 = 0) THEN 'reward_mismatch' WHEN stddev_pop(reward) < 0.33 THEN 'out_of_zone' END AS grp FROM li GROUP BY ord),
r AS (SELECT ord, idx, CASE WHEN q < 3 THEN 'bad_schema' WHEN pk % 29 = 0 THEN 'bad_tokens' WHEN pk % 31 = 0 THEN 'prompt_mismatch' WHEN pk % 37 = 0 THEN 'bad_signature' WHEN sk % 43 = 0 THEN 'proof_fail'
  WHEN q % 17 = 0 OR tax < 0.005 THEN 'bad_termination' WHEN disc > 0.095 THEN 'logprob_mismatch' WHEN pk % 23 = 0 THEN 'distribution_suspicious' END AS why,
  list_max(list_transform(range(4, 36), lambda i: (pk * i) % 4000)) AS sketch, exp(disc / 10) - 1 AS dev FROM li),
ro AS (SELECT ord, arg_min(why, struct_pack(i := idx, w := why)) FILTER (WHERE why IS NOT NULL) AS roll, max(sketch) AS sketch_diff_max, max(dev) AS lp_dev_max FROM r GROUP BY ord),
own AS (SELECT s.*, CASE WHEN first IS NULL THEN sigma END AS sigma, CASE WHEN first IS NULL THEN grp END AS grp, CASE WHEN first IS NULL AND grp IS NULL THEN roll END AS roll, sketch_diff_max, lp_dev_max FROM s LEFT JOIN g USING (ord) LEFT JOIN ro USING (ord)),
cl AS (SELECT window_n, prompt_idx, min(ord) AS claim FROM own WHERE first IS NULL AND grp IS NULL AND roll IS NULL GROUP BY ALL),
admitted AS (SELECT own.*, coalesce(first, CASE WHEN ord > claim THEN 'superseded' END, grp, roll) AS reason FROM own LEFT JOIN cl USING (window_n, prompt_idx))"""


@REGISTRY.query("admission_chain", f"WITH {ADMITTED} SELECT ord, reason, round(sigma, 6) AS sigma, CASE WHEN reason IS NULL THEN sketch_diff_max END AS sketch_diff_max, CASE WHEN reason IS NULL THEN round(lp_dev_max, 6) END AS lp_dev_max FROM admitted")
def admission_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From token arrays to the reason, staged."""
    ok = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return admitted(spark, sf_dir).select("ord", "reason", "sigma", "sketch_diff_max", F.round("lp_dev_max", 6).alias("lp_dev_max")).select("ord", "reason", rounded("sigma"), ok("sketch_diff_max"), ok("lp_dev_max"))


SEALED = f"{ADMITTED}, ba AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_n ORDER BY ord) AS slot FROM admitted WHERE reason IS NULL) WHERE slot <= 8)"


def sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of every window: its first admitted submissions of distinct prompts."""
    accepted = admitted(spark, sf_dir).where("reason IS NULL").withColumn("root", F.unhex(F.sha2(F.col("ord").cast("string"), 256)))
    return selection.select_batch(accepted.select("ord", "hotkey", "window_n", "prompt_idx", "arrived_at", "root"))


_ALPHA = f"(2.0::DOUBLE / {DEFAULT.ema_span + 1})"


@REGISTRY.query("sealed_batch_weights", f"""WITH {SEALED}, meta AS (SELECT c_custkey AS pos, 'h' || (c_custkey % 60) AS hotkey, (c_nationkey + 1)::BIGINT AS uid FROM customer),
steps AS (SELECT window_n, row_number() OVER (ORDER BY window_n) AS step FROM (SELECT DISTINCT window_n FROM s)), top AS (SELECT max(step) AS t FROM steps),
sl AS (SELECT window_n, hotkey, count(*) AS n FROM ba GROUP BY ALL),
sc AS (SELECT hotkey, sum({_ALPHA} * n / 8.0::DOUBLE * pow(1 - {_ALPHA}, t - step)) AS score FROM sl JOIN steps USING (window_n), top GROUP BY hotkey),
lu AS (SELECT hotkey, arg_max(uid, pos) AS uid FROM meta GROUP BY hotkey)
SELECT uid, hotkey, round(score, 6) AS weight FROM sc JOIN lu USING (hotkey) UNION ALL SELECT 0::BIGINT, NULL, round(b, 6) FROM (SELECT greatest(0.0, 1 - sum(score)) AS b FROM sc) WHERE b > 0""")
def sealed_batch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5-E7 over sealed batches: windows without a batch are archive records that tick, and the burn is a row of its own."""
    windows = submissions(spark, sf_dir).select("window_n").distinct()
    scores = scoring.ema_scores(sealed(spark, sf_dir), archive=windows)
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("h"), F.col("c_custkey") % 60).alias("hotkey"), (F.col("c_nationkey") + 1).cast("bigint").alias("uid"))
    return scoring.weights(scores, meta).select("uid", "hotkey", rounded("weight"))
