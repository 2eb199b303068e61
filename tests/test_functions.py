"""Hashes, graders and text functions against plain Python."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import grading, hashing, text
from tallyforge.operators import posterior, probes, vectors

PAIRS = [
    ("1/2", "0.5", True), (r"\frac{1}{2}", "0.5", True), (r"2\sqrt{3}", r"\sqrt{12}", True), ("x^2+2x+1", "(x+1)^2", True), ("(1,2)", "(1, 2)", True), ("[1,2)", "(1,2)", False),
    (r"119^\circ", "119", True), (r"\frac{\sqrt{3}}{3}", r"\frac{1}{\sqrt{3}}", True), ("a+b", "b+a", True), ("9**9**9**9", "1", False), ("1/0", "2", False), (r"\sqrt[3]{8}", "2", True),
    (r"\begin{pmatrix}1\\2\end{pmatrix}", r"\begin{pmatrix}1\\2.0\end{pmatrix}", True), (r"3\pi", "9.42477796076938", True), ("(" * 90 + "1", "1", False), (r"\unknown{2}", "2", False),
]


@pytest.mark.parametrize("given_,truth,same", PAIRS)
def test_answers(given_, truth, same):
    assert grading.answers_equal(given_, truth) is same


def test_rewards_and_json():
    assert grading.math_reward(r"so \boxed{\frac{3}{4}}", "0.75") == 1.0
    assert grading.math_reward("x\n42 is it", "42") == 1.0
    assert grading.math_reward(None, "1") == 0.0
    assert not grading.json_equal(1, True) and grading.json_equal({"a": [1.0]}, {"a": [1.0 + 1e-9]}) and not grading.json_equal([1], [1, 2])
    assert grading.json_safe({1: (1, {2})}) == {"1": [1, [2]]}
    with pytest.raises(ValueError):
        grading.json_safe(float("nan"))
    assert json.loads(grading.code_facts("import os\nos.abort()\n")) == []


def test_hashes(spark):
    row = spark.range(1).select(
        hashing.uniform_draw(F.lit("ab"), F.lit(7), F.lit("ck"), F.lit(1), F.lit(2)).alias("u"), hashing.token_hash(F.array(F.lit(1), F.lit(70000))).alias("h"),
        hashing.clean_hex(F.lit(" 0xabc")).alias("hex"), hashing.window_randomness(F.lit("0x12"), F.lit(None).cast("string"), F.lit(1)).alias("plain"),
    ).first()
    message = b"forced-seed-v2" + b"\0\2ab" + (7).to_bytes(8, "big") + b"\0\2ck" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big")
    assert row["u"] == int.from_bytes(hashlib.sha256(message).digest()[:8], "big") / 2.0**64
    assert row["h"] == hashlib.sha256((1).to_bytes(4, "big") + (70000).to_bytes(4, "big")).hexdigest()
    assert (row["hex"], row["plain"]) == ("0abc", "12")
    assert hashing.merkle_root([]) is None
    assert hashing.merkle_root([{"b": 1, "a": 2}]) == hashing.merkle_root([{"a": 2, "b": 1}])
    assert len(hashing.challenge_indices([1, 2], "ab", 3, 100)) == 32 and hashing.challenge_indices([1], "ab", 3, 5) == [3, 4]
    assert all(-127 <= c <= 127 for c in hashing.coefficient_vector("a", 16))


ADVERSARIAL = [r"\boxed{3.5/2}", r"\boxed{}", r"\boxed{1/0}", r"\boxed{9^{9^{9}}}", r"\boxed{\frac{1}{0}}", r"\boxed{" + "(" * 500, r"\boxed{\sqrt{-1}}", r"\boxed{0^{-1}}", "1/", "", "\x00", r"\boxed{" + "9" * 5000 + "}"]


@pytest.mark.parametrize("completion", ADVERSARIAL)
def test_reward_never_raises_and_an_empty_truth_earns_nothing(completion):
    assert grading.safe_reward(completion, "7") == 0.0 and grading.safe_reward(completion, "") == 0.0 and grading.safe_reward(completion, r"\ $") == 0.0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\boxedfracsqt{}[]()^*/+-.,0123 x", max_size=60), st.text(max_size=20))
def test_reward_of_any_text(completion, truth):
    assert grading.math_reward(completion, truth) in (0.0, 1.0) and grading.math_reward("\\boxed{" + completion + "}", truth) in (0.0, 1.0)


def test_words_earn_by_text_alone_and_towers_end():
    import time

    for given, truth in (("east", "seat"), ("no", "on"), ("listen", "silent"), ("xy", "yx"), ("f(x)", "x f")):
        assert grading.math_reward("\\boxed{" + given + "}", truth) == 0.0
    assert grading.math_reward(r"\boxed{east}", "east") == 1.0 and grading.math_reward(r"\boxed{y*x}", "x*y") == 1.0 and grading.math_reward(r"\boxed{2\pi*r}", r"r*2\pi") == 1.0
    began = time.perf_counter()
    for depth in (6, 7, 8, 20):
        for tower in ("(" * depth + "9" + "^9)" * depth, "(" * depth + "x+9" + ")^9" * depth, "(" * depth + "1/9" + "^9)" * depth, "\\sqrt{" * 5 + "7" + "}^9" * 5):
            assert grading.safe_reward("\\boxed{" + tower + "}", "7") == 0.0
    assert time.perf_counter() - began < 20


def test_nested_latex_and_numbers():
    assert grading.math_reward(r"\boxed{\frac{1}{\sqrt{\frac{4}{9}}}}", "1.5") == 1.0 and grading.math_reward(r"\boxed{3.5/2}", "7/4") == 1.0
    assert grading.as_number("1/0") is None and grading.as_number("3.5/2") is None and grading.as_number("-12.50") == -12.5


def test_long_numbers_are_compared_exactly(spark):
    big = "1" + "0" * 30
    rows = [(big, big + ".0", True), (big, big[:-1] + "1", False), ("0.50", "1/2", True), ("x" * 20, big, None), ("1/0", "2", None), ("0." + "0" * 20 + "1", "0", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("a", "b", "want", text.same_number(F.col("a"), F.col("b")).alias("same")).collect()
    assert [r["same"] for r in got] == [r["want"] for r in got]


def lp(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def test_prf_and_challenges():
    import random

    want = hashlib.shake_256(lp(b"open", b"ab", b"")).digest(32)
    assert hashing.prf(b"open", b"ab", b"", out_bytes=32) == want and hashing.prf(b"x", out_bytes=0) == b""
    assert hashing.prf(b"l", b"a", b"b", out_bytes=8) != hashing.prf(b"l", b"ab", out_bytes=8)
    raw = hashlib.shake_256(lp(b"sketch", bytes.fromhex("0abc"))).digest(12)
    assert hashing.projection_vector("0xabc", 3) == [int.from_bytes(raw[k : k + 4], "big", signed=True) for k in (0, 4, 8)]
    tokens = [1, 70000, 2**32 + 5]
    digest = hashlib.sha256(b"".join((t % 2**32).to_bytes(4, "big") for t in tokens)).digest()
    seed = hashlib.shake_256(lp(b"open", digest, b"\xab")).digest(32)
    few = random.Random(seed).sample(range(1000), 32)
    many = list(range(60))
    random.Random(seed).shuffle(many)
    assert hashing.challenge_indices(tokens, "ab", 10, 1010) == sorted(10 + i for i in few)
    assert hashing.challenge_indices(tokens, "ab", 10, 70) == sorted(10 + i for i in many[:32])
    assert hashing.challenge_indices(tokens, "ab", 3, 3) == []
    with pytest.raises(ValueError):
        hashing.challenge_indices([], "ab", 0, 10)


def test_bindings_and_digests(spark):
    row = spark.range(1).select(
        hashing.commit_binding(F.array(F.lit(1), F.lit(2)), F.lit("0xabc"), F.lit("m"), F.lit(-1), F.lit("[]")).alias("commit"),
        hashing.precommit_binding(F.lit("hk"), F.lit(5), F.lit(6), F.lit("ab"), F.lit(None).cast("string"), F.lit("math"), F.lit(99), F.lit("cd"), F.lit(7), F.lit(""), F.lit(2), F.lit("n")).alias("pre"),
        hashing.environment_seed(F.lit("w"), F.lit("h"), F.lit(3)).alias("seed"), hashing.root_matches(F.lit("AB"), F.lit("ab")).alias("same"),
    ).first()
    sha = lambda *x: hashlib.sha256(b"".join(x))
    words = sha((1).to_bytes(4, "big"), (2).to_bytes(4, "big")).digest()
    assert row["commit"] == sha(b"commit-v1", lp(words, b"\x0a\xbc", b"m", b"\xff" * 4, sha(b"[]").digest())).hexdigest()
    n8 = lambda n: n.to_bytes(8, "big")
    assert row["pre"] == sha(b"upload-precommit-v2", lp(b"hk", n8(5), n8(6), b"\xab", b"", b"math", n8(99), b"\xcd", n8(7), b"", n8(2), b"n")).hexdigest()
    assert row["seed"] == int(sha(b"seed|w:h:3").hexdigest()[:8], 16) and row["same"]
    body = json.dumps([{"env_name": "e", "index": 0, "tokens": [4, 5]}], sort_keys=True, separators=(",", ":")).encode()
    assert hashing.selection_digest([[4, 5]], "e") == sha(b"selection-stream-v1\0", body).hexdigest()
    leaf = lambda x: sha(json.dumps(x).encode()).digest()
    assert hashing.legacy_root([1, 2, 3]) == sha(sha(leaf(1), leaf(2)).digest(), sha(leaf(3), leaf(3)).digest()).hexdigest()


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="\\boxedf{}12 ", max_size=40))
def test_boxed_reader_is_balanced(s):
    got = grading.boxed(s)
    assert got is None or got.count("{") == got.count("}")


def test_boxed_columns_equal_python(spark):
    cases = ["no", r"\boxed{1}", r"a \boxed{\frac{1}{2}} b \fbox{3} }", r"\boxed{{1}", r"\fbox{a}\boxed{b{c}d} tail", ""]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.strip_box(text.last_boxed(F.col("t"))).alias("b"))
    assert {r["t"]: r["b"] for r in df.collect()} == {c: grading.boxed(c) for c in cases}


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 1))
def test_in_zone_probability_is_a_probability(p):
    from math import comb

    assert -1e-12 <= sum(comb(8, k) * p**k * (1 - p) ** (8 - k) for k in range(2, 7)) <= 1 + 1e-12


def test_posterior_and_decay(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 0.9), (2, "a", 0.0)], "prompt_idx bigint, bucket string, reward double")
    got = {(r["prompt_idx"], r["bucket"]): (r["alpha"], r["beta"]) for r in posterior.beta_update(df).collect()}
    assert got == {(1, None): (2.0, 2.0), (2, None): (1.0, 2.0), (None, "a"): (2.0, 3.0)}
    row = spark.range(1).select(posterior.decayed(F.lit(5.0), F.lit(0)).alias("a"), posterior.decayed(F.lit(5.0), F.lit(1), 0.0).alias("b"), posterior.decayed_count(F.lit(7), F.lit(2)).alias("c"), posterior.decayed_count(F.lit(7), F.lit(0)).alias("d")).first()
    assert tuple(row) == (5.0, 1.0, 1, 7)
    prompts = spark.createDataFrame([(k, 2.0, 2.0, 0) for k in range(20)], "prompt_idx bigint, alpha double, beta double, seen int")
    cooling = spark.createDataFrame([(k,) for k in range(10)], "prompt_idx bigint")
    assert posterior.next_prompt(prompts, cooling, 3).first()["prompt_idx"] >= 10


def test_sampling_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=30)], float(rng.random())) for k in range(20)]
    df = vectors.warp(spark.createDataFrame(rows, "id int, v array<double>, u double"), "v", 0.6, 10, 0.9)
    for r in df.select("id", "probs", vectors.inverse_cdf(F.col("probs"), F.col("u")).alias("pick")).collect():
        lg = np.array(rows[r["id"]][1]) / 0.6
        lg[lg < np.sort(lg)[-10]] = -np.inf
        p = np.exp(lg - lg.max())
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        cum = np.cumsum(p[order])
        q = np.zeros_like(p)
        keep = order[(cum - p[order]) < 0.9]
        q[keep] = p[keep]
        q /= q.sum()
        assert np.allclose(q, r["probs"])
        assert r["pick"] == min(int(np.searchsorted(np.cumsum(q), rows[r["id"]][2], side="right")), 29)


def test_a_tie_at_the_crossing_token_is_cut(spark):
    import numpy as np

    got = vectors.nucleus(np.zeros(4), 1.0, 0, 0.5)
    assert got.tolist() == [0.5, 0.5, 0.0, 0.0] and vectors.nucleus(np.zeros(0), 1.0, 20, 0.9).tolist() == []
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, None), (3, [])], "k int, v array<double>")
    rows = {r["k"]: r for r in vectors.warp(df, "v").select("k", "probs", vectors.softmax(F.col("v")).alias("s"), vectors.log_softmax(F.col("v")).alias("l")).collect()}
    assert rows[2]["probs"] is None and rows[3]["probs"] == [] and np.allclose(np.exp(rows[1]["l"]), rows[1]["s"]) and sum(rows[1]["s"]) == pytest.approx(1)


def test_buckets_at_the_edges(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1e-7, 1.0, -1.0, 1e9, -3.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", vectors.magnitude_bucket(F.col("x")).alias("b"))
    assert [r["b"] for r in df.orderBy("k").collect()] == [0, 7, -7, 0, 0, 0, 7, -1]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.8, 1), ("b", 0.5, 1)], "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in probes.auc(df, "s", "y", ["g"]).collect()}
    assert got == {"a": 0.875, "b": None}


def test_text_model_separates(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang IN ('en', 'de')").select("text", F.length("text").cast("double").alias("n"), (F.col("lang") == "en").cast("int").alias("y"))
    model, prepared = probes.tfidf_model(docs, "text", "y", ["n"], vocabulary=500)
    right = model.transform(prepared).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.95


def test_graders_run_in_all_partitions_and_once_a_pair(spark, data, monkeypatch):
    from tallyforge.plans import queries_text

    for query in (queries_text.math_reward, queries_text.same_number, queries_text.json_equal, queries_text.code_facts):
        assert query(spark, data).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    graded = []
    monkeypatch.setattr(grading, "safe_reward", lambda given, truth: graded.append((given, truth)) or float(given == truth))
    given, truth = pd.Series(["1", None, "2", "1", None, "1"]), pd.Series(["1", "2", "1", "1", "2", None])
    assert grading.math_reward_udf.func(given, truth).tolist() == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0] and len(graded) == 4
