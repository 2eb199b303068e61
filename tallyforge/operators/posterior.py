"""Beta posteriors of prompts and buckets, in-zone scores and the choice of the next prompt."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def in_zone_probability(p: Column, n: int = 8, low: int = 2, high: int = 6) -> Column:
    """Chance of low..high successes of n at probability p."""
    return sum((F.lit(float(comb(n, k))) * F.pow(p, F.lit(k)) * F.pow(1 - p, F.lit(n - k)) for k in range(low, high + 1)), F.lit(0.0))


def competitor_penalty(seen: Column, gamma: float = 0.3) -> Column:
    """How much a prompt loses for each time that another key was first."""
    return F.exp(F.lit(-gamma) * F.coalesce(seen, F.lit(0)))


def beta_update(rows: DataFrame) -> DataFrame:
    """(prompt_idx, bucket, alpha, beta): both levels in one pass; rewards are cut to whole numbers, as counts are.

    Prompt rows have a null bucket and bucket rows a null prompt_idx.
    """
    k, n = F.sum(F.col("reward").cast("int")), F.count(F.lit(1))
    return rows.groupingSets([[F.col("prompt_idx")], [F.col("bucket")]], "prompt_idx", "bucket").agg((1.0 + k).alias("alpha"), (1.0 + n - k).alias("beta"))


def decayed(value: Column, steps: Column, factor: float = 0.5) -> Column:
    """An evidence count after some checkpoints: 1 + f^steps (value - 1)."""
    return 1 + F.pow(F.lit(factor), steps) * (value - 1)


def decayed_count(value: Column, steps: Column, factor: float = 0.5) -> Column:
    """A whole count, cut to a whole number at every step."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), value.cast("bigint"), lambda a, i: F.when(i <= steps, F.floor(a * factor)).otherwise(a))


def posterior_for(prompts: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Adds alpha and beta: the prompt's own, else its bucket's, else 1 and 1."""
    own = posteriors.where("prompt_idx IS NOT NULL").select("prompt_idx", F.col("alpha").alias("pa"), F.col("beta").alias("pb"))
    shared = posteriors.where("bucket IS NOT NULL").select("bucket", F.col("alpha").alias("ba"), F.col("beta").alias("bb"))
    joined = prompts.join(own, "prompt_idx", "left").join(shared, "bucket", "left")
    return joined.select(*prompts.columns, F.coalesce("pa", "ba", F.lit(1.0)).alias("alpha"), F.coalesce("pb", "bb", F.lit(1.0)).alias("beta"))


def thompson_draw(seed: int):  # noqa: ANN201
    """A pandas UDF (prompt_idx, alpha, beta) -> draw; each prompt's draw depends on the seed and its index only."""

    @pandas_udf(T.DoubleType())
    def draw(prompt: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng((seed, int(p))).beta(a, b) for p, a, b in zip(prompt, alpha, beta)], dtype=float)

    return draw


def next_prompt(prompts: DataFrame, cooling: DataFrame, seed: int) -> DataFrame:
    """One row: the prompt outside cooldown with the largest score of its draw; ties to the smallest index."""
    rows = prompts.join(cooling, "prompt_idx", "left_anti").withColumn("draw", thompson_draw(seed)("prompt_idx", "alpha", "beta"))
    scored = rows.withColumn("score", in_zone_probability(F.col("draw")) * competitor_penalty(F.col("seen")))
    return scored.orderBy(F.desc("score"), "prompt_idx").limit(1)


def eligible_prompts(prompts: DataFrame, lo: Column, hi: Column, biased: DataFrame | None = None, cooling: DataFrame | None = None) -> DataFrame:
    """Prompts of the window's range outside cooldown; a bias set narrows them only where it leaves some."""
    rows = prompts.where((F.col("prompt_idx") >= lo) & (F.col("prompt_idx") < hi))
    rows = rows if cooling is None else rows.join(cooling, "prompt_idx", "left_anti")
    if biased is None:
        return rows
    narrowed = rows.join(biased, "prompt_idx", "left_semi")
    return narrowed if narrowed.limit(1).count() else rows
