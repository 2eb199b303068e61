"""Ordered validation gates: the first failing gate names the reason, at submission and at rollout scope.

A gate is a name and a predicate that means "fails"; a null predicate passes, which is how a missing measurement and the
three-valued distribution verdict are accepted. A chain becomes one CASE expression, so nothing past the first failure
is evaluated for a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT, EngineConfig


@dataclass(frozen=True)
class Gate:
    """A reason and when a row fails with it."""

    reason: str
    fails: Column


#: Reasons after which a producer may try again.
RETRYABLE = ("stale_round", "batch_filled", "rate_limited", "future_round", "registration_unavailable")


def first_failure(gates: list[Gate]) -> Column:
    """The reason of the first failing gate, null if none fails."""
    out = F.lit(None).cast("string")
    for gate in reversed(gates):
        out = F.when(gate.fails, F.lit(gate.reason)).otherwise(out)
    return out


def window_gates(current_window: Column, checkpoint: Column, universe: Column) -> list[Gate]:
    """Gates before the claim: window, checkpoint (an empty one disables it), prompt range, cooldown."""
    return [
        Gate("window_mismatch", F.col("window_n") != current_window),
        Gate("wrong_checkpoint", (checkpoint != "") & (F.col("checkpoint_hash") != checkpoint)),
        Gate("bad_prompt_idx", F.col("prompt_idx") >= universe),
        Gate("prompt_in_cooldown", F.col("in_cooldown")),
    ]


def reward_gates(threshold: Column, config: EngineConfig = DEFAULT) -> list[Gate]:
    """Gates over the whole group: claimed rewards, then the zone."""
    return [
        Gate("reward_mismatch", F.col("reward_gap") > config.reward_tolerance),
        Gate("out_of_zone", (F.col("sigma") < config.sigma_degenerate) | (F.col("sigma") < threshold)),
    ]


def commit_schema_ok(tokens: Column, commitments: Column, prompt_length: Column, completion_length: Column, logprobs: Column, minimum: int = 32) -> Column:
    """Lengths that have to agree in a commit."""
    n, lp = F.size(tokens), F.size(logprobs)
    return (n >= minimum) & (F.size(commitments) == n) & (prompt_length + completion_length == n) & ((lp == n) | (lp == completion_length))


def tokens_ok(tokens: Column, vocabulary: Column | int, max_context: int = DEFAULT.max_context) -> Column:
    """Non-empty, not too long, every id inside the vocabulary."""
    return (F.size(tokens) > 0) & (F.size(tokens) <= max_context) & F.forall(tokens, lambda t: (t >= 0) & (t < vocabulary))


def prompt_ok(tokens: Column, prompt_length: Column, canonical: Column) -> Column:
    """Whether the first tokens are the canonical prompt."""
    return F.slice(tokens, F.lit(1), prompt_length) == canonical


def termination_ok(tokens: Column, eos: Column, p_stop: Column, floor: float = DEFAULT.stop_probability) -> Column:
    """Last token is an end token and its probability reaches the floor; a missing probability passes."""
    return F.array_contains(eos, F.element_at(tokens, -1)) & F.coalesce(p_stop >= floor, F.lit(True))


def logprob_layout(logprobs: Column, tokens: Column, prompt_length: Column, completion_length: Column, at: Column) -> Column:
    """The claimed log-probability of an absolute position in either layout; null if the length fits neither."""
    return F.when(F.size(logprobs) == F.size(tokens), F.get(logprobs, at)).when(F.size(logprobs) == completion_length, F.get(logprobs, at - prompt_length))


def rollout_gates(config: EngineConfig = DEFAULT) -> list[Gate]:
    """Gates of one rollout, over verdict columns of a rollout row."""
    return [
        Gate("bad_schema", ~F.col("schema_ok")),
        Gate("bad_tokens", ~F.col("tokens_ok")),
        Gate("prompt_mismatch", ~F.col("prompt_ok")),
        Gate("bad_signature", ~F.col("signature_ok")),
        Gate("proof_fail", ~F.col("proof_ok")),
        Gate("bad_termination", ~F.col("termination_ok")),
        Gate("logprob_mismatch", F.col("lp_dev") > config.logprob_epsilon),
        Gate("distribution_suspicious", ~F.col("dist_ok")),
    ]


def proof_verdict(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Per rollout: whether enough challenged positions are within tolerance, and the largest difference."""
    return rows.groupBy(*keys).agg((F.bool_and(F.col("diff") <= F.col("tolerance")) & (F.count("diff") >= expected)).alias("proof_ok"), F.max("diff").alias("sketch_diff_max"))


def assemble(rollouts: DataFrame, keys: list[str], gates: list[Gate]) -> DataFrame:
    """Per submission: the reason of its lowest failing rollout, and the worst measurements ignoring inf and null."""
    judged = rollouts.withColumn("reason", first_failure(gates))
    finite = F.when(~F.isnan("lp_dev") & (F.abs("lp_dev") != float("inf")), F.col("lp_dev"))
    return judged.groupBy(*keys).agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("idx", "reason")))["reason"].alias("rollout_reason"),
        F.max("sketch_diff").alias("sketch_diff_max"),
        F.max(finite).alias("lp_dev_max"),
        F.min("q10").alias("dist_q10_min"),
    )


def request_ok(rollout_count: Column, envs: Column, size: int = DEFAULT.group_size) -> Column:
    """Exactly ``size`` rollouts of one environment."""
    return (rollout_count == size) & (F.size(F.array_distinct(envs)) == 1)


def field_gates() -> list[Gate]:
    """Constraints on the fields of a request."""
    return [
        Gate("prompt_idx", F.col("prompt_idx") < 0),
        Gate("window_start", F.col("window_start") < 0),
        Gate("merkle_root", ~F.col("merkle_root").rlike("^[0-9a-fA-F]{64}$")),
        Gate("checkpoint_hash", F.length("checkpoint_hash") > 256),
        Gate("nonce", F.length("nonce") > 128),
    ]


def _outside(name: str, low: int, high: int | None = None) -> Column:
    """Whether a text is missing or its length is outside."""
    n = F.coalesce(F.length(name), F.lit(-1))
    return (n < low) | (n > high) if high is not None else n < low


def _negative(name: str, low: int = 0) -> Column:
    return F.coalesce(F.col(name) < low, F.lit(True))


def _not_hex(name: str, digits: int) -> Column:
    return ~F.coalesce(F.col(name).rlike(f"^[0-9a-fA-F]{{{digits}}}$"), F.lit(False))


def precommit_gates() -> list[Gate]:
    """Constraints on the fields of a precommit, in the order of its fields; a missing field fails, but the version may be missing."""
    signature = ~F.coalesce(F.col("precommit_signature").rlike("^[0-9a-fA-F]+$"), F.lit(False)) | _outside("precommit_signature", 2, 256)
    return [
        Gate("miner_hotkey", _outside("miner_hotkey", 1)), Gate("prompt_idx", _negative("prompt_idx")), Gate("window_start", _negative("window_start")), Gate("merkle_root", _not_hex("merkle_root", 64)),
        Gate("checkpoint_hash", _outside("checkpoint_hash", 0, 256)), Gate("environment", _outside("environment", 1, 64)), Gate("payload_bytes", _negative("payload_bytes", 1)), Gate("payload_sha256", _not_hex("payload_sha256", 64)),
        Gate("drand_round", _negative("drand_round")), Gate("protocol_version", F.col("protocol_version") < 0), Gate("nonce", _outside("nonce", 1, 128)), Gate("precommit_signature", signature),
    ]


def verdict_gates(reasons: Column) -> list[Gate]:
    """Constraints on the fields of a verdict: its root, a window that is missing or not negative, a known reason, and flags and a time that are there."""
    return [
        Gate("merkle_root", _not_hex("merkle_root", 64)), Gate("window_n", F.col("window_n") < 0), Gate("accepted", F.col("accepted").isNull()),
        Gate("reason", ~F.coalesce(F.array_contains(reasons, F.col("reason")), F.lit(False))), Gate("ts", F.col("ts").isNull() | F.isnan("ts")),
    ]


def unknown_fields(payload: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON text that a strict schema does not know."""
    return F.array_except(F.json_object_keys(payload), F.array(*[F.lit(x) for x in allowed]))


def http_reason(status: Column) -> Column:
    """What a status code means for a producer."""
    return F.when(status == 200, "accepted").when(status == 503, "window_not_active").when(status == 409, "window_mismatch").when(status == 422, "bad_schema").when(status.between(400, 499), "http_client_error").when(status >= 500, "retry").otherwise("unknown")


def server_gate(state: Column, window: Column, current: Column) -> Column:
    """The reason before the queue, null if a request may enter."""
    return F.when(current.isNull(), "no_window").when(state != "open", "window_not_active").when(window != current, "window_mismatch")
