"""Scores, groups, selection and state against sequential loops and the known cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.config import DEFAULT
from tallyforge.operators import gates, groups, posterior, scoring, selection, state

SUBS = "ord bigint, window_n bigint, hotkey string, prompt_idx bigint, arrived_at double, root binary, valid boolean"


def batch(spark, rows):
    return spark.createDataFrame([(w, h) for w, h in rows], "window_n bigint, hotkey string")


def loop_ema(rows, alpha=DEFAULT.ema_alpha, b=DEFAULT.batch_size, prune=DEFAULT.ema_prune):
    scores: dict[str, float] = {}
    for w in sorted({w for w, _ in rows}):
        slots: dict[str, int] = {}
        for x, h in rows:
            if x == w:
                slots[h] = slots.get(h, 0) + 1
        scores = {h: alpha * slots.get(h, 0) / b + (1 - alpha) * scores.get(h, 0.0) for h in scores.keys() | slots.keys()}
        scores = {h: v for h, v in scores.items() if v > prune}
    return scores


def test_ema_equals_the_loop_and_forgets_order(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 700) * 3, f"h{rng.randint(0, 6)}") for _ in range(400)] + [(0, "early")]
    want = loop_ema(rows)
    rng.shuffle(rows)
    got = {r["hotkey"]: r["score"] for r in scoring.ema_scores(batch(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[h] - want[h]) < 1e-12 for h in want)


def test_weights_known_case(spark):
    rows = [(1, "alice"), (1, "bob"), (2, "alice"), (3, "bob"), (3, "carol")]
    scores = scoring.ema_scores(batch(spark, rows))
    meta = spark.createDataFrame([(0, "alice", 5), (1, "alice", 10), (2, "bob", 20)], "pos bigint, hotkey string, uid bigint")
    got = {r["uid"]: r["weight"] for r in scoring.weights(scores, meta).collect()}
    assert set(got) == {0, 10, 20} and got[10] > 0 and got[0] == pytest.approx(1 - sum(loop_ema(rows).values()))
    assert scoring.ema_scores(batch(spark, [])).count() == 0


def test_zone_and_degenerate_groups(spark):
    rows = [(g, i, float(x)) for g, xs in enumerate(([1] * 8, [1] * 4 + [0] * 4, [1], [1, 0, 0, 0, 0, 0, 0, 0])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "grp bigint, idx bigint, reward double")
    got = {r["grp"]: r for r in groups.group_zone(df).collect()}
    assert [got[g]["in_zone"] for g in range(4)] == [False, True, False, True]
    assert got[1]["sigma"] == 0.5 and got[3]["producer_zone"] is False and got[2]["sigma"] == 0.0
    assert {r["adv"] for r in groups.advantages(df).where("grp = 0").collect()} == {0.0}


def submissions(spark, rows):
    full = [(k, w, h, p, float(t), bytes([k % 251]) * 32, v) for k, (w, h, p, t, v) in enumerate(rows)]
    return spark.createDataFrame(full, SUBS)


def test_select_batch_equals_the_greedy_loop(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 3), f"h{rng.randint(0, 5)}", rng.randint(0, 20), rng.randint(0, 50), True) for _ in range(200)]
    df = submissions(spark, rows)
    cool = spark.createDataFrame([(3,), (4,)], "prompt_idx bigint")
    ordered = sorted(df.select("*", *[c.alias(f"o{i}") for i, c in enumerate(selection.arrival_order())]).collect(), key=lambda r: (r["o0"], r["o1"], r["o2"]))
    want: dict[int, list[int]] = {}
    for r in ordered:
        own = want.setdefault(r["window_n"], [])
        taken = {rows[k][2] for k in own}
        if len(own) < 8 and r["prompt_idx"] not in taken | {3, 4}:
            own.append(r["ord"])
    got: dict[int, list[int]] = {}
    for r in selection.select_batch(df, cool).orderBy("window_n", "slot").collect():
        got.setdefault(r["window_n"], []).append(r["ord"])
    assert got == want
    assert selection.select_batch(df, None, 0).count() == 0


def test_superseded_counts_accepted_rows_only(spark):
    df = submissions(spark, [(1, "a", 42, 1, False), (1, "b", 42, 2, True), (1, "c", 42, 3, True), (1, "d", 7, 4, True)])
    got = [r["outcome"] for r in selection.first_accepted(df, F.col("prompt_idx") != 7, F.col("valid")).orderBy("ord").collect()]
    assert got == ["rejected_after", "accepted", "superseded", "rejected_before"]


def test_replay_equals_sequential_cooldown(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 30), "h", rng.randint(0, 12), rng.randint(0, 1000), True) for _ in range(300)]
    got = [(r["window_n"], r["slot"], r["prompt_idx"]) for r in state.replay_batches(submissions(spark, rows), 5, 3).orderBy("window_n", "slot").collect()]
    last: dict[int, int] = {}
    want = []
    for w in range(31):
        picked: list[int] = []
        for _, (_, _, p, _, _) in sorted(((t, k), r) for k, r in enumerate(rows) for t in [r[3]] if r[0] == w):
            if len(picked) < 3 and p not in picked and (p not in last or w - last[p] >= 5):
                picked.append(p)
        want += [(w, k, p) for k, p in enumerate(picked, 1)]
        last.update({p: w for p in picked})
    assert got == want


def test_cooldown_rules(spark):
    df = spark.createDataFrame([(100, 42), (90, 42), (10, 7)], "window_n bigint, prompt_idx bigint")
    known = state.last_batched(df, 150, 100)
    assert [(r["prompt_idx"], r["last_window"]) for r in known.collect()] == [(42, 100)]
    assert state.cooling(known, 120, 50).count() == 1 and state.cooling(known, 150, 50).count() == 0 and state.cooling(known, 120, 0).count() == 0
    with pytest.raises(ValueError):
        state.last_batched(df, 1, -1)


@pytest.mark.parametrize("yields,total,floor", [([None, 0.9, 0.1], 8, 1), ([0.5, 0.5, 0.5], 8, 1), ([0.2] * 5, 4, 1), ([1.0, 0.0], 2, 1)])
def test_slots_sum_to_the_total(spark, yields, total, floor):
    from tallyforge.config import EngineConfig

    df = spark.createDataFrame([(k, f"e{k}", y) for k, y in enumerate(yields)], "pos bigint, env string, ema double")
    got = selection.slot_allocation(df, EngineConfig(slot_total=total, slot_floor=floor)).collect()
    assert sum(r["slots"] for r in got) == total
    assert all(r["slots"] >= min(floor, total // len(yields)) for r in got)


def test_band_prefers_good_endings(spark):
    rows = [(1, i, float(i % 2), i >= 6, 0.1 * i, 0.5, True) for i in range(12)]
    df = spark.createDataFrame(rows, "grp bigint, idx bigint, reward double, bt_ok boolean, q10 double, p_stop double, in_eos boolean")
    got = selection.band_subset(df).collect()
    assert len(got) == 8 and {r["k"] for r in got} == {4} and sum(r["bt_ok"] for r in got) == 6
    assert selection.band_subset(df.where("idx < 6")).count() == 0


def test_gate_order_and_null_verdicts(spark):
    df = spark.createDataFrame([(1, 1, None, 5.0, 0.1), (1, 0, False, float("inf"), None), (2, 0, None, 0.01, 0.3)], "grp int, idx int, dist_ok boolean, lp_dev double, q10 double")
    cols = {c: F.lit(True) for c in ("schema_ok", "tokens_ok", "prompt_ok", "signature_ok", "proof_ok", "termination_ok")} | {"sketch_diff": F.lit(7)}
    got = {r["grp"]: r for r in gates.assemble(df.withColumns(cols), ["grp"], gates.rollout_gates()).collect()}
    assert got[1]["rollout_reason"] == "logprob_mismatch" and got[1]["lp_dev_max"] == 5.0 and got[1]["dist_q10_min"] == 0.1
    assert got[2]["rollout_reason"] is None


def test_schema_gates(spark):
    df = spark.createDataFrame([([1, 2, 3, 9], [7, 8, 9, 9], 2, 2, [0.1, 0.2])], "tokens array<int>, sketches array<int>, p int, c int, lp array<double>")
    got = df.select(
        gates.commit_schema_ok(F.col("tokens"), F.col("sketches"), F.col("p"), F.col("c"), F.col("lp"), 4).alias("ok"),
        gates.commit_schema_ok(F.col("tokens"), F.col("sketches"), F.col("p"), F.col("c"), F.col("lp")).alias("short"),
        gates.tokens_ok(F.col("tokens"), 9).alias("vocabulary"), gates.prompt_ok(F.col("tokens"), F.col("p"), F.array(F.lit(1), F.lit(2))).alias("prompt"),
        gates.termination_ok(F.col("tokens"), F.array(F.lit(9)), F.lit(0.001)).alias("stop"), gates.termination_ok(F.col("tokens"), F.array(F.lit(9)), F.lit(None).cast("double")).alias("no_logits"),
        gates.logprob_layout(F.col("lp"), F.col("tokens"), F.col("p"), F.col("c"), F.lit(3)).alias("lp3"),
        gates.unknown_fields(F.lit('{"a":1,"zz":2}'), ["a"]).alias("extra"),
    ).first()
    assert (got["ok"], got["short"], got["vocabulary"], got["prompt"], got["stop"], got["no_logits"], got["lp3"], got["extra"]) == (True, False, False, True, False, True, 0.2, ["zz"])


def test_ordered_ema_equals_a_plain_fold(spark):
    import random

    from tallyforge.operators import scoring

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.uniform(-50, 500), k, rng.random()) for k in range(300)] + [("c", 5.0, 0, 0.25)]
    df = spark.createDataFrame(rows, "k string, t double, ord bigint, x double")
    for start in ("first", "zero"):
        want = {}
        for k, _, _, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
            want[k] = (x if start == "first" else 0.1 * x) if k not in want else 0.9 * want[k] + 0.1 * x
        for span in (1.0, 40.0, 1e6):
            got = {r["k"]: r["ema"] for r in scoring.ordered_ema(df, "k", "x", ["t", "ord"], 0.1, start, span).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_prefixes_equal_a_global_rank(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tallyforge.operators import probes

    rows = spark.createDataFrame([(i // 2,) for i in range(401)], "id bigint")
    order = [probes.shuffled(F.col("id"), "s"), F.col("id")]
    place = F.percent_rank().over(W.orderBy(*order))
    want = rows.withColumn("p", place).collect()
    for digits in (1, 3):
        got = probes.prefixes(rows, order, digits=digits).groupBy("fraction").agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert {r["fraction"]: (r["s"], r["n"]) for r in got} == {f: (sum(r["id"] for r in want if r["p"] < f or f == 1), sum(1 for r in want if r["p"] < f or f == 1)) for f in (0.25, 0.5, 0.75, 1.0)}
    assert probes.prefixes(rows.limit(1), order).count() == 4 and probes.prefixes(rows.where("false"), order).count() == 0


def test_next_prompt_is_the_arg_max_of_its_draws(spark, data):
    import numpy as np

    from tallyforge.plans.queries_scoring import thompson_next

    def score(prompt, size):
        p = np.random.default_rng((11, prompt)).beta(1.0 + size, 51.0 - size)
        return sum(math.comb(8, k) * p**k * (1 - p) ** (8 - k) for k in range(2, 7))

    parts = spark.read.parquet(f"{data}/part.parquet").select("p_partkey", "p_size").collect()
    want = max((score(r["p_partkey"], r["p_size"]), -r["p_partkey"]) for r in parts if r["p_partkey"] % 7)
    got = thompson_next(spark, data).collect()
    assert [r["prompt_idx"] for r in got] == [-want[1]] and got[0]["score"] == pytest.approx(want[0])


def test_bias_narrows_only_where_it_leaves_prompts(spark):
    prompts = spark.range(20).withColumnRenamed("id", "prompt_idx")
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "prompt_idx bigint")
    got = lambda **sets: sorted(r[0] for r in posterior.eligible_prompts(prompts, F.lit(5), F.lit(10), **sets).collect())
    assert got() == [5, 6, 7, 8, 9] and got(cooling=some(5, 7, 30)) == [6, 8, 9]
    assert got(cooling=some(5, 7), biased=some(6, 7, 15)) == [6]
    assert got(biased=some(15, 30)) == [5, 6, 7, 8, 9] and got(cooling=some(6), biased=some(6)) == [5, 7, 8, 9]


def test_latest_is_a_top_n(spark):
    rows = spark.createDataFrame([(k * 7 % 23, k) for k in range(23)], "ts bigint, k bigint")
    assert sorted(r["ts"] for r in state.latest(rows, 4, F.col("ts")).collect()) == [19, 20, 21, 22]
    assert state.latest(rows.where("false"), 4, F.col("ts")).count() == 0
