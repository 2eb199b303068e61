"""The staged admission chain: reasons against a plain loop, all reasons present, dear gates see only what is left."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import functions as F

from tallyforge.operators import admission, gates
from tallyforge.plans import queries_admission as qa

ALL = {"window_mismatch", "wrong_checkpoint", "bad_prompt_idx", "prompt_in_cooldown", "superseded", "reward_mismatch", "out_of_zone", "bad_schema", "bad_tokens", "prompt_mismatch", "bad_signature", "proof_fail", "bad_termination", "logprob_mismatch", "distribution_suspicious", None}


def test_every_reason_occurs(spark):
    assert {r[0] for r in qa.admitted(spark, "/root/testdata/sf0.01").select("reason").distinct().collect()} == ALL


def test_dear_gates_see_only_what_is_left(spark, data):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def costly(ord_, idx):
        seen.add(1)
        return False

    subs, rows = qa.submissions(spark, data), qa.rollouts(spark, data)
    before = gates.window_gates(F.col("current"), F.lit("new"), F.lit(10**9))
    dear = [gates.Gate("costly", F.col("costly"))]
    out = admission.admit(subs, rows, before, gates.reward_gates(F.lit(0.33)), admission.cheap_gates(qa.VOCABULARY), dear, {"costly": costly("ord", "idx")})
    reasons = {r["ord"]: r["reason"] for r in out.collect()}
    cheap = {"bad_schema", "bad_tokens", "prompt_mismatch"}
    lines = {}
    for r in rows.select("ord", "idx", "q", "pk").collect():
        lines.setdefault(r["ord"], []).append((r["idx"], r["q"] < 3 or r["pk"] % 29 == 0 or r["pk"] % 31 == 0))
    reached = 0
    for ord_, own in lines.items():
        if reasons[ord_] is None or reasons[ord_] in cheap | {"superseded"}:
            stop = min((i for i, bad in own if bad), default=99)
            reached += sum(i < stop for i, _ in own)
    assert 0 < seen.value <= reached < sum(map(len, lines.values())) / 2


def test_helpers_equal_statistics(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],), ([5.0],), ([1.0, 2.0],)], "v array<double>")
    got = [tuple(r) for r in df.select(admission.interpolated(F.col("v"), 0.5), admission.interpolated(F.col("v"), 0.1)).collect()]
    assert [g[0] for g in got] == [statistics.median(v) for v in ([3, 1, 2, 10], [5], [1, 2])] and abs(got[0][1] - 1.3) < 1e-12


def test_dear_gates_see_the_rollouts_before_the_first_cheap_failure(spark, data):
    """As above, with idx of any size: the bound of 99 there is less than every idx of the view."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def costly(ord_, idx):
        seen.add(1)
        return False

    subs, rows = qa.submissions(spark, data), qa.rollouts(spark, data)
    before = gates.window_gates(F.col("current"), F.lit("new"), F.lit(10**9))
    out = admission.admit(subs, rows, before, gates.reward_gates(F.lit(0.33)), admission.cheap_gates(qa.VOCABULARY), [gates.Gate("costly", F.col("costly"))], {"costly": costly("ord", "idx")})
    reasons = {r["ord"]: r["reason"] for r in out.collect()}
    lines = {}
    for r in rows.select("ord", "idx", "q", "pk").collect():
        if reasons[r["ord"]] in (None, "superseded", "bad_schema", "bad_tokens", "prompt_mismatch"):
            lines.setdefault(r["ord"], []).append((r["idx"], r["q"] < 3 or r["pk"] % 29 == 0 or r["pk"] % 31 == 0))
    reached = sum(i < min((k for k, bad in own if bad), default=10**30) for own in lines.values() for i, _ in own)
    assert 0 < seen.value <= reached


def test_arrays_are_worked_out_once_a_row(spark, data):
    c = [F.col(n) for n in ("positions", "model_lp", "logprobs", "tokens", "prompt_length", "completion_length")]
    plan = lambda column: qa.rollouts(spark, data).select(column.alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0].lower()
    assert plan(admission.logprob_deviation(*c)).count("exp(") == 1
    assert plan(admission.interpolated(F.col("chosen"), 0.1)).count("sort_array(") == 1


def test_deviation_of_short_and_missing_claims(spark):
    df = spark.createDataFrame([(1, [0.0, 0.1, 0.3], [0.0, 0.0, 0.0]), (2, [0.0, 0.1], [0.0, 0.0, 0.0]), (3, [0.0, 0.1, 0.3], [0.0, 0.0]), (4, None, [0.0]), (5, [0.2, 0.2, 0.2], [9.0, 0.0, 0.0, 0.0])], "k int, model array<double>, claimed array<double>")
    dev = admission.logprob_deviation(F.array(*[F.lit(p) for p in (1, 2, 3)]), F.col("model"), F.col("claimed"), F.array(*[F.lit(t) for t in (7, 7, 7, 7)]), F.lit(1), F.lit(3), 3)
    got = {r["k"]: r["x"] for r in df.select("k", dev.alias("x")).collect()}
    assert abs(got[1] - (math.exp(0.1) - 1)) < 1e-12 and got[2] == got[3] == got[4] == math.inf and abs(got[5] - (math.exp(0.2) - 1)) < 1e-12
