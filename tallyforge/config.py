"""Parameters of the engine in one frozen record; every operator takes it or single values from it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Fixed values of the data model's rules, each of them a parameter."""

    batch_size: int = 8
    sigma_steady: float = 0.33
    sigma_bootstrap: float = 0.33
    sigma_producer: float = 0.43
    sigma_degenerate: float = 1e-8
    bootstrap_windows: int = 100
    cooldown_windows: int = 1_000_000
    ema_span: int = 72
    ema_prune: float = 1e-6
    quota_per_hotkey: int = 8
    reward_tolerance: float = 1e-6
    stop_probability: float = 0.01
    logprob_epsilon: float = 0.10
    challenge_positions: int = 32
    distribution_min_steps: int = 30
    distribution_median: float = 0.30
    distribution_q10: float = 0.025
    max_context: int = 16384
    sketch_base: int = 5000
    sketch_growth: float = 5.0
    sketch_modulus: int = 2_147_483_647
    sketch_topk: int = 16
    sketch_buckets: int = 8
    slot_total: int = 8
    slot_floor: int = 1
    yield_alpha: float = 0.1
    clock_alpha: float = 0.2
    group_size: int = 8
    block_seconds: int = 12
    seed_group_floor: float = 0.80
    seed_rollout_floor: float = 0.75

    @property
    def ema_alpha(self) -> float:
        """The weight of a new archive record."""
        return 2.0 / (self.ema_span + 1)


DEFAULT = EngineConfig()
