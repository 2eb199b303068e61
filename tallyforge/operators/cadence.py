"""When a producer fires and what is retried, which windows train and publish, where a restart resumes, and poll addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators.scoring import small

#: The states of a window in their order.
STATES = ("open", "training", "publishing", "ready")
#: Fixed value: titles of commits that hold a checkpoint begin with it.
CHECKPOINT_TITLE = "checkpoint "


def should_fire(ticks: DataFrame, fired: DataFrame, forfeited: DataFrame) -> DataFrame:
    """Adds fire to ticks (window_n, state, randomness, pool): the window is open, has randomness and a pool, and was neither fired nor forfeited.

    A null state, randomness or pool does not fire. The lists of windows may hold repeats.
    """
    spent = fired.select("window_n").unionByName(forfeited.select("window_n")).where("window_n IS NOT NULL").distinct()
    ready = (F.col("state") == "open") & (F.length("randomness") > 0) & (F.col("pool") > 0)
    marked = ticks.join(small(spent.withColumn("_spent", F.lit(True))), "window_n", "left")
    return marked.withColumn("fire", F.coalesce(ready, F.lit(False)) & F.col("_spent").isNull()).drop("_spent")


def passes_floors(q10: Column, median: Column, q10_floor: float = 0.0, median_floor: float = 0.0) -> Column:
    """Whether both measurements reach their floors; a floor of zero is off, and a null fails a floor that is on."""
    checks = [F.coalesce(value >= floor, F.lit(False)) for value, floor in ((q10, q10_floor), (median, median_floor)) if floor > 0]
    out = F.lit(True)
    for check in checks:
        out = out & check
    return out


def publish_plan(windows: DataFrame, every: int, size: int = DEFAULT.batch_size, has_checkpoint: bool = False) -> DataFrame:
    """Adds trained and published to windows (window_n, n), one row a window.

    Full batches train. Of those every ``every``-th window publishes, and the first one at all where no checkpoint exists.
    """
    full = F.coalesce(F.col("n") >= size, F.lit(False))
    turn = F.col("window_n") % every == 0
    if not has_checkpoint:
        first = windows.where(full).agg(F.min("window_n").alias("_first"))  # one row
        windows = windows.crossJoin(F.broadcast(first))
        turn = turn | F.col("window_n").eqNullSafe(F.col("_first"))
    return windows.withColumns({"trained": full, "published": full & turn}).drop("_first")


def state_changes(windows: DataFrame) -> DataFrame:
    """(window_n, step, state) of windows (window_n, sealed): a window that was sealed passes through all states, one that was not stays open."""
    names = F.array(*[F.lit(s) for s in STATES])
    passed = F.when(F.col("sealed"), names).otherwise(F.slice(names, 1, 1))
    return windows.select("window_n", F.posexplode(passed).alias("step", "state"))


def resume_point(archived: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: window_n, the last archived window (0 without any), and checkpoint_n, how many commit titles are checkpoints."""
    last = archived.agg(F.coalesce(F.max("window_n"), F.lit(0)).cast("bigint").alias("window_n"))
    count = commits.agg(F.count_if(F.col("title").startswith(CHECKPOINT_TITLE)).alias("checkpoint_n"))
    return last.crossJoin(count)  # one row each


def quoted(value: Column) -> Column:
    """Percent encoding with nothing but letters, digits and ``_.-~`` left as it is."""
    out = F.url_encode(value)
    for form, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(want))
    return out


def state_address(base: Column, env: Column) -> Column:
    """Where the state is polled; a null environment asks for the first one."""
    return F.concat(base, F.lit("/state"), F.coalesce(F.concat(F.lit("?env="), quoted(env)), F.lit("")))


def verdicts_address(base: Column, hotkey: Column, since: Column) -> Column:
    """Where a key's verdicts are polled, after a cursor if there is one."""
    return F.concat(base, F.lit("/verdicts/"), quoted(hotkey), F.coalesce(F.concat(F.lit("?since="), since.cast("string")), F.lit("")))


def next_cursor(rows: DataFrame, cursor: float) -> DataFrame:
    """One row: the cursor of the next poll, the latest ts of this one or the cursor as it was."""
    return rows.agg(F.greatest(F.max("ts"), F.lit(cursor)).alias("cursor"))
