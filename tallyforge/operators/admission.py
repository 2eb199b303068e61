"""The admission chain from submitted arrays to a verdict: cheap gates first, dear ones only for rows that are still in.

A submission passes window gates, then the claim on its prompt, then gates over its whole group of rollouts, then the gates of its rollouts in
order. The first failure names the reason. Stages are joined by the submission's number, and each sees only what the stage before
has left: arrays of submissions that fail a window or group gate are never read by rollout gates, and dear gates see
the rollouts before the first cheap failure, as no later one can name the reason. What a stage leaves is a row of a few numbers a
submission, and the next is a semi-join of the rollouts with it. Arrays that are made from columns come after that join, so
they are never shuffled and only rows that are left make them. The claim is a minimum per window and prompt,
summed up before the shuffle, so a flood of submissions for one prompt meets in no task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT, EngineConfig
from tallyforge.functions.hashing import sketch_tolerance
from tallyforge.operators.gates import Gate, commit_schema_ok, first_failure, prompt_ok, termination_ok, tokens_ok
from tallyforge.session import ensure_checkpoint_dir


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, however often ``use`` names it and inside whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interpolated(values: Column, share: float) -> Column:
    """The percentile of an array by linear interpolation between its sorted values; null for an empty one."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * share
        low = F.floor(at).cast("int")
        return F.get(s, low) + (at - low) * (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low))

    return bound(F.sort_array(values), between)


def proof_ok(positions: Column, diffs: Column, expected: int = DEFAULT.challenge_positions) -> Column:
    """Whether enough challenged positions are there and each difference is within its position's tolerance."""
    within = F.forall(F.arrays_zip(positions.alias("p"), diffs.alias("d")), lambda x: x["d"] <= sketch_tolerance(x["p"]))
    return (F.size(positions) >= expected) & (F.size(diffs) == F.size(positions)) & within


def logprob_deviation(positions: Column, model: Column, claimed: Column, tokens: Column, prompt_length: Column, completion_length: Column, expected: int = DEFAULT.challenge_positions) -> Column:
    """Median of exp(abs(model - claimed)) - 1 over the challenged positions, in either layout of the claim; infinite with too few."""
    shift = F.when(F.size(claimed) == F.size(tokens), F.lit(0)).when(F.size(claimed) == completion_length, prompt_length)  # the layout, once a row
    inputs = F.struct(positions.alias("positions"), model.alias("model"), claimed.alias("claimed"), shift.alias("shift"))

    def gaps(x: Column) -> Column:
        of = lambda p: F.exp(F.abs(F.get(x["model"], p - prompt_length) - F.get(x["claimed"], p - x["shift"]))) - 1
        return F.sort_array(F.filter(F.transform(x["positions"], of), lambda g: g.isNotNull()))

    def median(s: Column) -> Column:
        n, half = F.size(s), F.floor(F.size(s) / 2).cast("int")
        mid = F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)
        return F.when(n >= expected, mid).otherwise(F.lit(float("inf")))

    return bound(bound(inputs, gaps), median)


def distribution_ok(chosen: Column, config: EngineConfig = DEFAULT) -> Column:
    """Median and 10th percentile of the chosen probabilities against their floors; null with too few values."""
    ok = lambda s: (interpolated(s, 0.5) >= config.distribution_median) & (interpolated(s, 0.1) >= config.distribution_q10)
    return F.when(F.size(chosen) >= config.distribution_min_steps, bound(chosen, ok))


def cheap_gates(vocabulary: int, config: EngineConfig = DEFAULT) -> list[Gate]:
    """Gates over a rollout's own arrays: schema, tokens, prompt. Needs canonical, the prompt's tokens."""
    schema = commit_schema_ok(F.col("tokens"), F.col("commitments"), F.col("prompt_length"), F.col("completion_length"), F.col("logprobs"))
    return [
        Gate("bad_schema", ~F.coalesce(schema, F.lit(False))),
        Gate("bad_tokens", ~tokens_ok(F.col("tokens"), vocabulary, config.max_context)),
        Gate("prompt_mismatch", ~prompt_ok(F.col("tokens"), F.col("prompt_length"), F.col("canonical"))),
    ]


def dear_gates(binding: Column, eos: Column, config: EngineConfig = DEFAULT) -> list[Gate]:
    """Gates over what the verifier has measured: signature (against its binding), proof, termination, log-probabilities, distribution."""
    return [
        Gate("bad_signature", F.col("signature") != binding),
        Gate("proof_fail", ~proof_ok(F.col("positions"), F.col("diffs"), config.challenge_positions)),
        Gate("bad_termination", ~termination_ok(F.col("tokens"), eos, F.col("p_stop"), config.stop_probability)),
        Gate("logprob_mismatch", F.col("lp_dev") > config.logprob_epsilon),
        Gate("distribution_suspicious", ~distribution_ok(F.col("chosen"), config)),
    ]


def admit(subs: DataFrame, rollouts: DataFrame, before: list[Gate], group: list[Gate], cheap: list[Gate], dear: list[Gate], measured: dict[str, Column] | None = None, config: EngineConfig = DEFAULT, arrays: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """subs with reason (null if accepted), sigma, sketch_diff_max, lp_dev_max and dist_q10_min.

    subs: ord (unique), window_n, prompt_idx, arrived_at and what ``before`` reads. rollouts: ord, idx, reward, truth and
    what the gates read. ``measured`` adds columns that dear gates read, made only for rows that reach them. ``arrays`` adds
    what rollout gates read and rollouts lack; it meets only what each stage has left.
    """
    ensure_checkpoint_dir(subs.sparkSession)
    entered = subs.withColumn("_before", first_failure(before))
    inside = rollouts.join(entered.where(F.col("_before").isNull()).select("ord"), "ord", "left_semi")
    groups = inside.groupBy("ord").agg(F.max(F.abs(F.col("reward") - F.col("truth"))).alias("reward_gap"), F.stddev_pop("reward").alias("sigma"))
    groups = groups.select("ord", "sigma", first_failure(group).alias("_group")).checkpoint()  # the stages below read it again, as they do stopped

    left = rollouts.join(groups.where("_group IS NULL").select("ord"), "ord", "left_semi")
    seen = arrays(left).select("ord", "idx", first_failure(cheap).alias("why"))
    stops = seen.groupBy("ord").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("idx", "why"))).alias("_stop"))  # no filter: it would go below the joins and take the gates with it
    stopped = groups.join(stops, "ord", "left").select("ord", "sigma", "_group", F.col("_stop.idx").alias("_until"), F.col("_stop.why").alias("_cheap")).checkpoint()
    until = stopped.where("_group IS NULL").select(F.col("ord").alias("_ord"), "_until")
    reached = arrays(rollouts.join(until, (F.col("ord") == F.col("_ord")) & (F.col("_until").isNull() | (F.col("idx") < F.col("_until"))), "left_semi"))
    deviation = logprob_deviation(F.col("positions"), F.col("model_lp"), F.col("logprobs"), F.col("tokens"), F.col("prompt_length"), F.col("completion_length"), config.challenge_positions)
    reached = reached.withColumns({"lp_dev": deviation, "chosen": F.sort_array("chosen")} | (measured or {}))  # sorting again what is in order is one pass
    judged = reached.select("ord", "idx", first_failure(dear).alias("why"), F.array_max("diffs").cast("bigint").alias("sketch"), "lp_dev", interpolated(F.col("chosen"), 0.1).alias("q10"))
    finite = F.when(F.col("lp_dev") < float("inf"), F.col("lp_dev"))
    rolled = judged.groupBy("ord").agg(
        F.min(F.when(F.col("why").isNotNull(), F.struct("idx", "why")))["why"].alias("_dear"), F.max("sketch").alias("sketch_diff_max"), F.max(finite).alias("lp_dev_max"), F.min("q10").alias("dist_q10_min")
    )
    own = entered.join(stopped.drop("_until"), "ord", "left").join(rolled, "ord", "left").withColumn("_rollout", F.coalesce("_dear", "_cheap")).checkpoint()  # read twice below; no gate runs twice
    passed = own.where(F.coalesce("_before", "_group", "_rollout").isNull())
    claims = passed.groupBy("window_n", "prompt_idx").agg(F.min(F.struct("arrived_at", "ord")).alias("_claim"))
    own = own.join(claims, ["window_n", "prompt_idx"], "left")
    superseded = F.when(F.struct("arrived_at", "ord") > F.col("_claim"), "superseded")
    return own.select(*subs.columns, F.coalesce("_before", superseded, "_group", "_rollout").alias("reason"), "sigma", "sketch_diff_max", "lp_dev_max", "dist_q10_min")
