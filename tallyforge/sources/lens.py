"""Views of the driver's tables as the engine's inputs: submissions, reward groups, verdicts, vectors, prompts, metagraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import table

#: Microseconds since the first window of the test tables, whatever the session's time zone is.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))"


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as submissions: ord, hotkey, window_n (hour), prompt_idx, arrived_at (seconds), valid, root (32 bytes)."""
    return as_submissions(table(spark, sf_dir, "events"))


def as_submissions(e: DataFrame) -> DataFrame:
    """The same view of a table or a stream of events."""
    micros = F.expr(MICROS)
    return e.select(
        F.col("event_id").alias("ord"),
        F.col("user_id").cast("string").alias("hotkey"),
        F.floor(micros / 3_600_000_000).cast("bigint").alias("window_n"),
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_idx"),
        (micros / 1e6).alias("arrived_at"),
        (F.col("event_type") != "error").alias("valid"),
        F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("root"),
        F.col("event_type").alias("env"),
        F.col("value").alias("value"),
    )


#: The same view in DuckDB, as a common table expression named subs.
SUBS_SQL = """subs AS (SELECT event_id AS ord, user_id::VARCHAR AS hotkey,
  floor(epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00' + TIMESTAMP '1970-01-01 00:00:00') / 3600000000)::BIGINT AS window_n,
  json_extract_string(props, '$.k')::BIGINT AS prompt_idx,
  epoch_us(ts - TIMESTAMP '2024-01-01 00:00:00' + TIMESTAMP '1970-01-01 00:00:00') / 1e6 AS arrived_at,
  event_type <> 'error' AS valid, unhex(sha256(event_id::VARCHAR)) AS root, event_type AS env, value FROM events)"""


def reward_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as rollouts: grp, idx, reward (0 or 1), reward_c (continuous), env, claimed."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("grp"),
        F.col("l_linenumber").cast("bigint").alias("idx"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        (F.col("l_discount") * 10).alias("reward_c"),
        F.col("l_linestatus").alias("env"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
    )


REWARDS_SQL = """rw AS (SELECT l_orderkey AS grp, l_linenumber::BIGINT AS idx, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
  l_discount * 10 AS reward_c, l_linestatus AS env, l_quantity AS quantity, l_tax AS tax, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str, scale: float = 40.0) -> DataFrame:
    """embeddings as logits or hidden states: vec_id, v (array of double, scaled), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"), "label")


VECTORS_SQL = "vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 40.0) AS v, label FROM embeddings)"


def metagraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as registered keys: pos, hotkey, uid (repeated keys show the last-wins rule)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 100).cast("string").alias("hotkey"), (F.col("c_nationkey") + 1).cast("bigint").alias("uid"), (F.col("c_acctbal") > 0).alias("permit"), F.col("c_name").alias("axon"))


META_SQL = "meta AS (SELECT c_custkey AS pos, (c_custkey % 100)::VARCHAR AS hotkey, (c_nationkey + 1)::BIGINT AS uid, c_acctbal > 0 AS permit, c_name AS axon FROM customer)"
