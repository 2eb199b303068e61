"""Firing, floors, publishing, restarts and addresses on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import cadence

TICKS = "window_n bigint, state string, randomness string, pool bigint"


def test_fires_only_when_all_hold(spark):
    rows = [(1, "open", "r", 3), (2, "open", "r", 3), (3, "open", "r", 3), (4, "training", "r", 3), (5, "open", "", 3), (6, "open", "r", 0), (7, None, None, None), (None, "open", "r", 1)]
    windows = lambda *ns: spark.createDataFrame([(n,) for n in ns], "window_n bigint")
    got = cadence.should_fire(spark.createDataFrame(rows, TICKS), windows(2, 2, None), windows(3)).collect()
    assert {r["window_n"]: r["fire"] for r in got} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, None: True}
    assert len(got) == len(rows)


def test_floors(spark):
    rows = spark.createDataFrame([(0.3, 0.2), (None, 0.2), (0.3, None), (0.1, 0.1)], "q double, m double")
    ask = lambda *floors: [r[0] for r in rows.select(cadence.passes_floors(F.col("q"), F.col("m"), *floors)).collect()]
    assert ask() == [True] * 4
    assert ask(0.3, 0.2) == [True, False, False, False]
    assert ask(0.0, 0.2) == [True, True, False, False]


def test_publishing(spark):
    windows = spark.createDataFrame([(1, 2), (2, 8), (3, 8), (4, 9), (6, 7), (8, 8), (9, None)], "window_n bigint, n bigint")
    plan = lambda **k: [r["window_n"] for r in cadence.publish_plan(windows, 4, 8, **k).where("published").orderBy("window_n").collect()]
    assert plan() == [2, 4, 8] and plan(has_checkpoint=True) == [4, 8]
    assert cadence.publish_plan(windows.where("n < 8"), 4, 8).where("published OR trained").count() == 0
    assert [r["window_n"] for r in cadence.publish_plan(windows, 4, 8).where("trained").orderBy("window_n").collect()] == [2, 3, 4, 8]


def test_restart_without_archives(spark):
    row = cadence.resume_point(spark.createDataFrame([], "window_n bigint"), spark.createDataFrame([("checkpoint 1",), ("checkpoints",), (None,)], "title string")).first()
    assert (row["window_n"], row["checkpoint_n"]) == (0, 1)


def test_addresses(spark):
    row = spark.range(1).select(
        cadence.state_address(F.lit("u"), F.lit("a b/é*~")).alias("a"), cadence.state_address(F.lit("u"), F.lit(None).cast("string")).alias("b"),
        cadence.verdicts_address(F.lit("u"), F.lit("k+1"), F.lit(1.5)).alias("c"), cadence.verdicts_address(F.lit("u"), F.lit("k"), F.lit(None).cast("double")).alias("d"),
    ).first()
    assert tuple(row) == ("u/state?env=a%20b%2F%C3%A9%2A~", "u/state", "u/verdicts/k%2B1?since=1.5", "u/verdicts/k")
