"""Operators over vectors in a row: buckets and sketches of hidden states, sampling from logits, log-probability checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyforge.config import DEFAULT, EngineConfig


def magnitude_bucket(x: Column, buckets: int = DEFAULT.sketch_buckets) -> Column:
    """Signed logarithmic bucket of an activation: NaN and tiny values are 0, infinities the outermost."""
    size = F.least(F.lit(buckets - 1), F.floor(F.log2(F.abs(x) + 1.0) * (buckets / 10.0)))
    sign = F.when(x < 0, -1).otherwise(1)
    return F.when(F.isnan(x) | x.isNull(), 0).when(F.abs(x) == float("inf"), sign * (buckets - 1)).when(F.abs(x) < 1e-6, 0).otherwise(sign * size).cast("bigint")


def top_indices(v: Column, k: int = DEFAULT.sketch_topk) -> Column:
    """Positions of the k largest magnitudes, ascending; ties to the lower position."""
    ranked = F.sort_array(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
    return F.sort_array(F.transform(F.slice(ranked, 1, k), lambda s: s["i"]))


def sketch(v: Column, coefficients: list[int], buckets: int = DEFAULT.sketch_buckets, modulus: int = DEFAULT.sketch_modulus) -> Column:
    """Sum of buckets of the top magnitudes times the window's coefficients, modulo."""
    own = F.transform(top_indices(v, len(coefficients)), lambda i: magnitude_bucket(F.get(v, i), buckets))
    total = F.aggregate(F.zip_with(own, F.array(*[F.lit(c) for c in coefficients]), lambda b, c: F.coalesce(b, F.lit(0)) * c), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.pmod(total, F.lit(modulus))


def dot_mod(h: Column, r: Column, scale: int = 1024, modulus: int = DEFAULT.sketch_modulus) -> Column:
    """Sum of round(h * scale) * r, modulo."""
    total = F.aggregate(F.zip_with(h, r, lambda a, b: F.rint(a * scale).cast("bigint") * b), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.pmod(total, F.lit(modulus))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Probabilities of a row of logits, the largest subtracted first."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def normalised(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else nucleus(np.asarray(x, dtype=np.float64), temperature, 0, 1.0))

    return normalised(v)


def log_softmax(v: Column) -> Column:
    """Log-probabilities of a row of logits, by the logarithm of the sum of exponentials."""

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def logs(rows: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> np.ndarray:
            x = np.asarray(x, dtype=np.float64)
            return x - (x.max() + np.log(np.exp(x - x.max()).sum())) if len(x) else x

        return rows.map(lambda x: None if x is None else one(x))

    return logs(v)


def nucleus(logits: np.ndarray, temperature: float, top_k: int, top_p: float) -> np.ndarray:
    """Probabilities of one row of logits after temperature, top-k (ties at the k-th stay) and top-p.

    Positions are taken by falling probability, ties by position, until the mass before one reaches top_p; the position
    that crosses it is the last one kept, and one that is merely as likely is not.
    """
    w = logits / temperature
    if top_k and top_k < len(w):
        w = np.where(w < np.partition(w, -top_k)[-top_k], -np.inf, w)
    e = np.exp(w - w.max()) if len(w) else w
    p = e / e.sum() if len(w) else w
    if top_p and top_p < 1:
        alive = np.flatnonzero(p)
        order = alive[np.argsort(-p[alive], kind="stable")]
        before = np.cumsum(p[order]) - p[order]
        kept = np.zeros_like(p)
        chosen = order[before < top_p]
        kept[chosen] = p[chosen]
        p = kept / kept.sum() if len(chosen) else kept
    return p


def warp(df: DataFrame, v: str, temperature: float = 0.6, top_k: int = 20, top_p: float = 0.95, out: str = "probs") -> DataFrame:
    """Adds ``out``: the ``nucleus`` probabilities of each row of logits; null and empty rows stay as they are.

    One numpy pass a row in Arrow batches: the work is linear in the row but for the sort of what top-k left, where a
    chain of array lambdas would be evaluated anew for each element.
    """

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else nucleus(np.asarray(x, dtype=np.float64), temperature, top_k, top_p))

    return df.withColumn(out, probabilities(v))


def inverse_cdf(probs: Column, u: Column) -> Column:
    """The first position whose cumulated probability exceeds u; the last one if none does."""

    @pandas_udf(T.IntegerType())
    def pick(rows: pd.Series, draws: pd.Series) -> pd.Series:
        return pd.Series([min(int(np.searchsorted(np.cumsum(p), d, side="right")), len(p) - 1) for p, d in zip(rows, draws)], dtype="Int32")

    return pick(probs, u)


def seed_consistency(rows: DataFrame, keys: list[str], threshold: float = 0.99) -> DataFrame:
    """Per key: stochastic positions, matches of the forced pick, and their ratio. Needs top_p_value, picked, token."""
    stochastic = F.col("top_prob") < threshold
    g = rows.groupBy(*keys).agg(F.count_if(stochastic).alias("n_stochastic"), F.count_if(stochastic & (F.col("picked") == F.col("token"))).alias("n_match"))
    return g.withColumn("ratio", F.col("n_match") / F.nullif(F.col("n_stochastic"), F.lit(0)))


def seed_floors(per_rollout: DataFrame, key: str, config: EngineConfig = DEFAULT, min_group: int = 30, min_rollout: int = 20) -> DataFrame:
    """Per group: ratio of sums and smallest ratio against their floors; too few positions give null."""
    worst = F.min(F.when(F.col("n_stochastic") >= min_rollout, F.col("ratio")))
    g = per_rollout.groupBy(key).agg(F.sum("n_stochastic").alias("n"), (F.sum("n_match") / F.nullif(F.sum("n_stochastic"), F.lit(0))).alias("group_ratio"), worst.alias("worst_ratio"))
    ok = F.when(F.col("n") >= min_group, (F.col("group_ratio") >= config.seed_group_floor) & F.coalesce(F.col("worst_ratio") >= config.seed_rollout_floor, F.lit(True)))
    return g.withColumn("seed_ok", ok)


def logprob_deviation(rows: DataFrame, keys: list[str], expected: int = DEFAULT.challenge_positions, epsilon: float = DEFAULT.logprob_epsilon) -> DataFrame:
    """Per key: median of exp(abs(model - claimed)) - 1 over challenged positions; too few positions fail with infinity."""
    dev = F.exp(F.abs(F.col("model_lp") - F.col("claimed_lp"))) - 1
    g = rows.groupBy(*keys).agg(F.count("claimed_lp").alias("n"), F.median(dev).alias("m"))
    out = F.when(F.col("n") >= expected, F.col("m")).otherwise(F.lit(float("inf")))
    return g.select(*keys, "n", out.alias("lp_dev"), (out <= epsilon).alias("lp_ok"))


def first_eos(tokens: Column, eos: list[int]) -> Column:
    """Tokens up to the first end token, or all."""
    ends = F.filter(F.array(*[F.array_position(tokens, F.lit(e)) for e in eos]), lambda p: p > 0)
    return F.when(F.size(ends) > 0, F.slice(tokens, F.lit(1), F.array_min(ends).cast("int"))).otherwise(tokens)


def forced_termination(rows: DataFrame, prompt_length: str, close: list[int], eos: list[int], force: list[int]) -> DataFrame:
    """Adds state (eos, closed, forced), primed tokens, and force_start and force_end for forced rows."""
    gen = F.slice("tokens", F.col(prompt_length) + 1, F.greatest(F.lit(0), F.size("tokens") - F.col(prompt_length)))
    ended = F.arrays_overlap(gen, F.array(*[F.lit(e) for e in eos]))
    closed = F.arrays_overlap(gen, F.array(*[F.lit(c) for c in close]))
    state = F.when(ended, "eos").when(closed, "closed").otherwise("forced")
    out = rows.withColumn("state", state)
    head = F.slice("tokens", F.lit(1), F.col(prompt_length))
    primed = F.when(F.col("state") == "eos", F.concat(head, first_eos(gen, eos))).when(F.col("state") == "forced", F.concat("tokens", F.array(*[F.lit(x) for x in force]))).otherwise(F.col("tokens"))
    n = F.size("tokens")
    forced = F.col("state") == "forced"
    return out.withColumns({"primed": primed, "force_start": F.when(forced, n), "force_end": F.when(forced, n + len(force))})


def clipped_surrogate(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.28) -> Column:
    """The clipped policy objective of a token."""
    return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * advantage)


def k3(model_lp: Column, reference_lp: Column) -> Column:
    """The k3 estimate of the divergence from a reference."""
    d = reference_lp - model_lp
    return F.exp(d) - d - 1
