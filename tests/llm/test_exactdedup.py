"""Exact dedup: against brute force, with hashes that clash, on odd rows, hot groups and empty tables."""

from __future__ import annotations

import hashlib
import random

import pytest
from conftest import spark_rows
from pyspark.sql import functions as F

from tallyforge.llm import exactdedup, skew

SCHEMA = "doc_id bigint, text string, rid string, h string, t string"
LONG = "".join(f"Sentence {k} of a long text, it goes on. " for k in range(3000))
ROWS = [
    (1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (None, ""), (None, "only here"), (None, "Twice"), (None, "tWICE"), (6, "ÄB"), (7, "äb"), (8, "Äb"),
    (9, LONG), (10, LONG.upper()), (11, LONG[:-2] + "x "), (12, LONG + LONG), (13, "x" * 30_000), (14, "X" * 30_000), (14, "x" * 30_000), (15, "x" * 29_999),
    (-(1 << 63), "low"), (None, "low"),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(lower(t), []).append((i is not None, i or 0, k))
    out = []
    for t, own in groups.items():
        some, keep, top = max(own)
        out += [(i if known else None, keep if some else None, len(own), k == top, hashlib.sha256(t.encode()).hexdigest()) for known, i, k in own]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in ROWS], SCHEMA)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(c) % 3, lambda c: F.lit(1).cast("bigint")])
def test_odd_rows_and_clashing_hashes(odd, hashed):
    assert got(exactdedup.copy_groups(odd, hashed=hashed)) == brute(ROWS)


def test_chunks_are_the_text_and_follow_content(spark):
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefghijklmnop .\n") for _ in range(60_000))
    df = spark.createDataFrame([(body,), ("shifted by this. " + body,), ("",), ("é" * 9000,)], "t string")
    rows = [r[0] for r in df.select(exactdedup.chunks(F.col("t"))).collect()]
    assert "".join(rows[0]) == body and "".join(rows[3]) == "é" * 9000 and rows[2] == [] and [len(x) for x in rows[3]] == [8192, 808]
    assert all(exactdedup.LEAST <= len(x) <= exactdedup.MOST for x in rows[0][:-1])
    assert len(set(rows[0]) & set(rows[1])) > len(rows[0]) // 2


def test_drop_copies_keeps_all_columns(odd):
    kept = exactdedup.drop_copies(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({lower(t) for _, t in ROWS}) and set(ids) >= {2, 5, 10, 14, 15, -(1 << 63)} and not {1, 4, 9, 13} & set(ids)
    empty = odd.where("false")
    assert exactdedup.drop_copies(empty).count() == exactdedup.copy_groups(empty).count() == 0


def test_hot_group_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 20)
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 4}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = exactdedup.copy_groups(df)
    assert got(found) == brute(rows)
    hot = skew.hot_keys(spark.createDataFrame([(1, 300), (2, 20), (3, 580)], "h bigint, n bigint"), "h", "n")
    assert hot == {1: 15, 3: 29}


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(7, "a")] * 5 + [(None, None)] * 3, "doc_id bigint, text string")
    found = exactdedup.copy_groups(df).drop("rid")
    assert spark_rows(found.where("kept").select("doc_id", "group_size")) == ["(7, 5)", "(None, 3)"]
