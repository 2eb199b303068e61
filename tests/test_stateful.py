"""Streams with a life: starts from archives, eviction, late rows, clearing; each against the batch operator or a plain fold."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators import scoring
from tallyforge.sources import lens
from tallyforge.streaming import stateful, windows


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get(stateful.PROVIDER_KEY)
    spark.conf.set(stateful.PROVIDER_KEY, stateful.PROVIDER)
    yield
    spark.conf.set(stateful.PROVIDER_KEY, before)


def fed(spark, tmp_path, parts):
    """A stream of one file a batch."""
    path = str(tmp_path / uuid.uuid4().hex)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/part={k}")
    return windows.capped_source(spark, f"{path}/*", parts[0].schema)


def drained(stream):
    """The rows, and the state rows after every batch."""
    name = "t" + uuid.uuid4().hex
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


@pytest.fixture(scope="module")
def slots(spark, data):
    subs = lens.submissions(spark, data).where("valid")
    batch = subs
    steps = scoring.archive_steps(batch)
    own = scoring.slots_per_window(batch).join(steps, "window_n")
    return batch.cache(), own.select("window_n", "hotkey", "step", "n").cache()


def test_average_from_archive_equals_one_that_never_stopped(spark, tmp_path, slots):
    batch, own = slots
    middle = own.agg(F.percentile_approx("window_n", 0.5)).first()[0]
    old, new = own.where(F.col("window_n") <= middle), own.where(F.col("window_n") > middle)
    pick = lambda df: df.select("hotkey", "step", "n").orderBy("step")
    whole, _ = drained(stateful.running_ema(fed(spark, tmp_path, [pick(old), pick(new)])))
    start = stateful.ema_start(batch.where(F.col("window_n") <= middle))
    resumed, _ = drained(stateful.running_ema(fed(spark, tmp_path, [pick(new)]), initial=start))
    first = old.agg(F.max("step")).first()[0]
    want = {(r["hotkey"], r["step"]): r["score"] for r in whole.where(F.col("step") > first).collect()}
    got = {(r["hotkey"], r["step"]): r["score"] for r in resumed.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    last = own.agg(F.max("step")).first()[0]
    final = {}
    for r in whole.orderBy("step").collect():
        final[r["hotkey"]] = r["score"] * (1 - DEFAULT.ema_alpha) ** (last - r["step"])
    assert all(abs(final[r["hotkey"]] - r["score"]) < 1e-9 for r in scoring.ema_scores(batch).collect())


def test_late_record_does_not_tick(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "hotkey string, step bigint, n bigint")
    parts = [rows(("a", 1, 8), ("a", 5, 4)), rows(("a", 3, 8), ("a", 5, 8), ("a", 6, 2))]
    got, _ = drained(stateful.running_ema(fed(spark, tmp_path, parts), late=100))
    alpha = DEFAULT.ema_alpha
    one = alpha
    five = alpha * 0.5 + (1 - alpha) ** 4 * one
    want = {1: one, 5: five, 6: alpha * 0.25 + (1 - alpha) * five}
    found = {r["step"]: r["score"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())


def _prompts(spark, low, high):
    """Two prompts a window, the first of them seen again three windows later."""
    base = spark.range(low, high).select(F.col("id").alias("window_n"))
    rows = base.select("window_n", F.explode(F.array(F.col("window_n") * 2, F.col("window_n") * 2 + 1, (F.col("window_n") - 3) * 2)).alias("prompt_idx"))
    return rows.select("prompt_idx", "window_n", F.lit(True).alias("batched"))


def test_cooldown_state_stays_bounded_and_starts_from_an_archive(spark, tmp_path):
    n = 50
    parts = [_prompts(spark, low, low + 1000) for low in range(0, 10_000, 1000)]
    whole, state_rows = drained(stateful.cooled(fed(spark, tmp_path, parts), n))
    cooling = {(r["prompt_idx"], r["window_n"]): r["cooling"] for r in whole.collect()}
    assert len(cooling) == 30_000 and all(v == (p < 2 * w) for (p, w), v in cooling.items() if p >= 0)
    per = 2 * 2 + 2  # two variables of two prompts a window, and their timers
    assert max(state_rows) <= per * 2 * (1000 + n) * 2 and state_rows[-1] <= per * 2 * (1000 + n)
    batch = _prompts(spark, 0, 9000).where("prompt_idx >= 2 * window_n")
    start = stateful.cooldown_start(batch, 9000, n)
    assert start.count() == 2 * (n - 1)
    resumed, _ = drained(stateful.cooled(fed(spark, tmp_path, parts[9:]), n, initial=start))
    got = {(r["prompt_idx"], r["window_n"]): r["cooling"] for r in resumed.collect()}
    assert got == {k: v for k, v in cooling.items() if k[1] >= 9000}


def test_flush_on_change_clears_on_checkpoint_and_idles_out(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, ord bigint, value string, checkpoint string, ts timestamp")
    parts = [
        rows(("a", 1, "x", "c1", at(1)), ("a", 2, "x", "c1", at(2)), ("a", 3, "y", "c1", at(3)), ("b", 4, "x", "c1", at(4))),
        rows(("a", 5, "z", "c2", at(5)), ("a", 6, "w", "c2", at(6))),
        rows(("c", 7, "q", "c2", at(300))),
        rows(("c", 8, "q", "c2", at(301))),
    ]
    got, state_rows = drained(stateful.flushed(fed(spark, tmp_path, parts), idle=3600))
    assert {tuple(r) for r in got.collect()} == {("a", "x", 2, "change"), ("a", "z", 1, "change"), ("a", "w", 1, "idle"), ("b", "x", 1, "idle")}
    assert state_rows[-1] < max(state_rows)
