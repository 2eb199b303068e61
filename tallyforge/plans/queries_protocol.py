"""Queries over windows' lives, environments, canonical JSON, end tokens and field constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import hashing, text
from tallyforge.operators import environments, gates, lifecycle
from tallyforge.plans.base import REGISTRY
from tallyforge.plans.registry import table
from tallyforge.sources import lens
from tallyforge.streaming import stateful, windows

NAMES = ("opened", "sealed", "trained", "published", "sealed", "skipped", "kept", "unknown")
_STEP = " ".join(f"WHEN s = '{a}' AND e = '{e}' THEN '{to}'" for (a, e), to in lifecycle.STEPS.items())
_LIFE = f"""WITH RECURSIVE {lens.SUBS_SQL}, o AS (SELECT hotkey AS key, ord, (['opened', 'sealed', 'trained', 'published', 'sealed', 'skipped', 'kept', 'unknown'])[(ord * 7 + prompt_idx) % 8 + 1] AS e, row_number() OVER (PARTITION BY hotkey ORDER BY ord) AS r FROM subs),
f(key, r, ord, event, before, after) AS (SELECT key, 0::BIGINT, 0::BIGINT, '', 'ready', 'ready' FROM (SELECT DISTINCT key FROM o)
  UNION ALL SELECT key, r, ord, e, s, CASE {_STEP} ELSE s END FROM (SELECT o.*, f.after AS s FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1))
SELECT key, ord, event, before, after, before <> after AS accepted FROM f WHERE r > 0"""


def _life(subs: DataFrame) -> DataFrame:
    return subs.select(F.col("hotkey").alias("key"), "ord", F.element_at(F.array(*[F.lit(n) for n in NAMES]), ((F.col("ord") * 7 + F.col("prompt_idx")) % 8 + 1).cast("int")).alias("event"))


@REGISTRY.query("window_lifecycle", _LIFE)
def window_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal steps and refused ones, key by key."""
    return lifecycle.follow(_life(lens.submissions(spark, sf_dir)), "key", ["ord"])


@REGISTRY.query("stream_lifecycle", _LIFE)
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 as a stream with state by key."""
    stream = lens.as_submissions(windows.capped_source(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema))
    return stateful.landed(lifecycle.following(_life(stream)), "lifecycle")


def catalogue(spark: SparkSession, sf_dir: str) -> environments.Catalogue:
    """Two environments over part: sizes, rewarded as numbers, and brands, rewarded as texts."""
    part = table(spark, sf_dir, "part")
    problems = lambda truth: part.select((F.col("p_partkey") - F.lit(part.agg(F.min("p_partkey")).first()[0])).alias("idx"), F.col("p_name").alias("prompt"), truth.alias("ground_truth"))
    found = environments.Catalogue()
    number = lambda given, truth: F.coalesce(text.same_number(given, truth), F.lit(False)).cast("double")
    found.register(environments.Environment("click", problems(F.col("p_size").cast("string")), number))
    found.register(environments.Environment("view", problems(F.col("p_brand")), lambda given, truth: (given == truth).cast("double")))
    return found


@REGISTRY.query("environment_rewards", f"""WITH {lens.SUBS_SQL}, p AS (SELECT *, p_partkey - min(p_partkey) OVER () AS idx, count(*) OVER () AS n FROM part)
SELECT ord, env, substr(sha256(p_name), 1, 16) AS id, CASE env WHEN 'click' THEN (ord % 5 = p_size % 5)::INT WHEN 'view' THEN (ord % 3 = 0)::INT END::DOUBLE AS reward FROM subs JOIN p ON idx = (ord * 13) % n WHERE env IN ('click', 'view')""")
def environment_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by wrapped index and rewards, by the row's environment."""
    known = catalogue(spark, sf_dir)
    rows = known.problems_at(lens.submissions(spark, sf_dir).select("ord", "env", (F.col("ord") * 13).alias("index")))
    size = F.col("ground_truth").try_cast("int")
    given = F.when(F.col("env") == "click", F.concat((size * 2 + F.when(F.col("ord") % 5 == size % 5, 0).otherwise(1)).cast("string"), F.lit("/2"))).otherwise(F.when(F.col("ord") % 3 == 0, F.col("ground_truth")).otherwise("none"))
    return rows.select("ord", "env", "id", known.reward(F.col("env"), given, F.col("ground_truth")).alias("reward"))


@REGISTRY.query("case_ids", r"""WITH c AS (SELECT p_partkey, substr(sha256(p_name), 1, 16) AS id, '[{"args":[' || p_size || ',"' || p_brand || '"],"compare":null,"entry":{"kind":"function","name":"f' || p_partkey || '"},"expected":{"a":[true,-' || p_size || '],"z":"\u00e9\ud83d\ude00"}}]' AS cases FROM part)
SELECT p_partkey, cases, substr(sha256(id || cases), 1, 16) AS case_id FROM c""")
def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a problem's cases over canonical JSON, from cases written with other orders and blanks."""
    raw = F.concat(F.lit('[ {"expected": {"z": "é\U0001f600", "a": [true, -'), F.col("p_size"), F.lit(']}, "entry": {"name": "f'), F.col("p_partkey"), F.lit('", "kind": "function"}, "compare": null, "args": ['), F.col("p_size"), F.lit(', "'), F.col("p_brand"), F.lit('"]}]'))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_json(raw).alias("cases"), text.case_id(hashing.problem_id(F.col("p_name")), raw).alias("case_id"))


@REGISTRY.query("end_tokens", "SELECT p_partkey, list_sort(list_distinct(CASE p_size % 4 WHEN 0 THEN [p_size, 2] WHEN 1 THEN [p_size, 7, p_partkey % 5] WHEN 2 THEN [2] ELSE [9, 2] END::BIGINT[])) AS ids FROM part")
def end_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of end tokens over a model's and a tokenizer's configurations."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    kind = F.col("p_size") % 4
    one = F.when(kind == 0, size).when(kind == 1, F.concat(F.lit("["), size, F.lit(", null, 7]"))).when(kind == 2, '"text"').otherwise('[9, "2", {"x": 1}]')
    two = F.when(kind == 1, F.concat(F.lit("["), (key % 5).cast("string"), F.lit(","), size, F.lit("]"))).when(kind == 3, F.lit(None)).otherwise("2")
    return table(spark, sf_dir, "part").select("p_partkey", environments.end_tokens([one, two]).alias("ids"))


@REGISTRY.query("precommit_constraints", f"""WITH {lens.SUBS_SQL} SELECT ord, CASE ord % 15 WHEN 1 THEN 'miner_hotkey' WHEN 2 THEN 'prompt_idx' WHEN 3 THEN 'window_start' WHEN 4 THEN 'merkle_root' WHEN 5 THEN 'checkpoint_hash' WHEN 6 THEN 'environment' WHEN 7 THEN 'payload_bytes'
 WHEN 8 THEN 'payload_sha256' WHEN 9 THEN 'drand_round' WHEN 10 THEN 'protocol_version' WHEN 11 THEN 'nonce' WHEN 12 THEN 'precommit_signature' END AS precommit,
 CASE WHEN ord % 15 = 4 THEN 'merkle_root' WHEN ord % 15 = 3 THEN 'window_n' WHEN ord % 15 = 13 THEN 'accepted' WHEN ord % 15 = 14 THEN 'reason' WHEN ord % 15 = 0 THEN 'ts' END AS verdict FROM subs""")
def precommit_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: the fields of precommits and verdicts."""
    k = F.col("ord") % 15
    at = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    digest = F.sha2(F.col("ord").cast("string"), 256)
    s = lens.submissions(spark, sf_dir).withColumns({
        "miner_hotkey": at(1, "", F.col("hotkey")), "prompt_idx": at(2, F.lit(-1), F.col("prompt_idx")), "window_start": at(3, F.lit(-1), F.col("window_n")), "merkle_root": at(4, F.substring(digest, 1, 63), digest),
        "checkpoint_hash": at(5, F.repeat(F.lit("c"), 257), F.lit("")), "environment": at(6, F.repeat(F.lit("e"), 65), F.col("env")), "payload_bytes": at(7, F.lit(0), F.col("ord") + 1), "payload_sha256": at(8, F.lit(None), digest),
        "drand_round": at(9, F.lit(None), F.col("ord")), "protocol_version": at(10, F.lit(-1), F.lit(None)), "nonce": at(11, "", F.lit("n")), "precommit_signature": at(12, F.concat(digest, F.lit("zz")), digest),
    }).withColumn("precommit", gates.first_failure(gates.precommit_gates()))
    v = s.withColumns({"window_n": at(3, F.lit(-1), F.lit(None)), "accepted": at(13, F.lit(None), F.lit(True)), "reason": at(14, "other", F.lit("accepted")), "ts": at(0, F.lit(float("nan")), F.lit(1.0))})
    return v.select("ord", "precommit", gates.first_failure(gates.verdict_gates(F.array(F.lit("accepted"), F.lit("out_of_zone")))).alias("verdict"))
