"""Streams over the given tables, run to their end and landed as tables; their SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators import scoring
from tallyforge.plans.base import REGISTRY, rounded
from tallyforge.plans.queries_scoring import EMA
from tallyforge.plans.queries_selection import sealed_batch
from tallyforge.plans.registry import table
from tallyforge.session import materialize
from tallyforge.sources import lens
from tallyforge.streaming import stateful, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of submissions, one file a batch, with the row's own time."""
    path = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream's path may name a folder or match a file but not name one
    stream = windows.capped_source(spark, path, table(spark, sf_dir, "events").schema)
    return lens.as_submissions(stream).withColumn("ts", F.timestamp_seconds("arrived_at"))


@REGISTRY.query("stream_claims", f"WITH {lens.SUBS_SQL} SELECT DISTINCT window_n, prompt_idx FROM subs WHERE valid")
def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid row of a window and prompt claims it, whatever comes later."""
    return windows.landed(windows.claims(_events(spark, sf_dir), delay="800 hours").select("window_n", "prompt_idx"), "claims")


@REGISTRY.query("stream_firing", f"WITH {lens.SUBS_SQL} SELECT DISTINCT window_n FROM subs")
def stream_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One firing a window."""
    return windows.landed(windows.fired_once(_events(spark, sf_dir)).select("window_n"), "fired")


@REGISTRY.query("stream_seals", f"""WITH {lens.SUBS_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY window_n, prompt_idx ORDER BY arrived_at, ord) = 1)::INT AS fresh FROM subs WHERE valid),
c AS (SELECT window_n, arrived_at, sum(fresh) OVER (PARTITION BY window_n ORDER BY arrived_at, ord ROWS UNBOUNDED PRECEDING) AS d FROM f)
SELECT window_n, min(arrived_at) AS sealed_at, 8::BIGINT AS n, 'full' AS reason FROM c WHERE d >= 8 GROUP BY window_n""")
def stream_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window seals at its eighth distinct prompt."""
    return windows.landed(windows.sealed_windows(_events(spark, sf_dir)), "seals", empty_batches=False)


@REGISTRY.query("stream_cooldown", f"""WITH RECURSIVE {lens.SUBS_SQL}, o AS (SELECT prompt_idx, window_n, row_number() OVER (PARTITION BY prompt_idx ORDER BY window_n) AS r FROM subs WHERE valid),
f(prompt_idx, r, window_n, cooling, last) AS (SELECT prompt_idx, r, window_n, false, window_n FROM o WHERE r = 1
  UNION ALL SELECT o.prompt_idx, o.r, o.window_n, o.window_n - f.last < 24, CASE WHEN o.window_n - f.last < 24 THEN f.last ELSE o.window_n END FROM f JOIN o ON o.prompt_idx = f.prompt_idx AND o.r = f.r + 1)
SELECT prompt_idx, window_n, cooling FROM f""")
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt that was batched cools for 24 windows; state ends by timers."""
    rows = _events(spark, sf_dir).where("valid").select("prompt_idx", "window_n", F.lit(True).alias("batched"))
    return stateful.landed(stateful.cooled(rows, 24), "cooldown")


@REGISTRY.query("stream_ema_resumed", f"{EMA}, half AS (SELECT max(step) // 2 AS h FROM st) SELECT e.hotkey, e.step, round(e.v, 6) AS score FROM ema e JOIN dense d USING (hotkey, step), half WHERE d.n > 0 AND step > h")
def stream_ema_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of the later half of the records as a stream that starts from the archive of the earlier half."""
    batch = sealed_batch(spark, sf_dir)
    steps = scoring.archive_steps(lens.submissions(spark, sf_dir))
    half = (steps.agg(F.max("step")).first()[0] or 0) // 2  # one number
    earlier = steps.where(F.col("step") <= half)
    start = stateful.ema_start(batch.join(earlier, "window_n", "left_semi"), archive=earlier)
    own = scoring.slots_per_window(batch).join(steps, "window_n").select("hotkey", "step", "n").where(F.col("step") > half)
    feed = materialize(own, "slots-feed")
    rows = windows.capped_source(spark, feed.scratch_path, feed.schema, files=1000)
    return stateful.landed(stateful.running_ema(rows, initial=start, config=DEFAULT), "ema").select("hotkey", "step", rounded("score"))


@REGISTRY.query("stream_flushes", f"""WITH {lens.SUBS_SQL}, c AS (SELECT *, window_n // 240 AS ck FROM subs),
m AS (SELECT *, CASE WHEN lag(env) OVER (PARTITION BY hotkey, ck ORDER BY ord) <> env THEN 1 ELSE 0 END AS turn FROM c),
g AS (SELECT *, sum(turn) OVER (PARTITION BY hotkey, ck ORDER BY ord) AS run FROM m),
r AS (SELECT hotkey, ck, run, min(env) AS flushed, count(*) AS n FROM g GROUP BY ALL)
SELECT hotkey AS key, flushed, n, 'change' AS why FROM r QUALIFY run < max(run) OVER (PARTITION BY hotkey, ck)""")
def stream_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key flushes what it gathered when its value changes, and drops it when the checkpoint advances."""
    rows = _events(spark, sf_dir).select(F.col("hotkey").alias("key"), "ord", F.col("env").alias("value"), F.floor(F.col("window_n") / 240).cast("string").alias("checkpoint"), "ts")
    return stateful.landed(stateful.flushed(rows, idle=10 * 365 * 86_400), "flushes")
