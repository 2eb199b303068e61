"""How many pairs of lines are verified."""

from __future__ import annotations

import random

from tallyforge.llm import linededup
from tallyforge.session import materialize


def test_near_copies_are_not_verified_pair_by_pair(spark, monkeypatch):
    """Near copies of a line that is not the earliest one with their words: each is settled by the nearest one, not by all."""
    n, words = 60, [f"word{k}" for k in range(20)]
    halves = [words[:10] + [f"x{k}" for k in range(10)], words[10:] + [f"y{k}" for k in range(10)]]
    copies = [[*words[: k % 20], f"own{k}", *words[k % 20 + 1 :]] for k in range(n)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([*halves, words, *copies])], "doc_id long, text string")
    pairs = []

    def counted(df, name):
        out = materialize(df, name)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    got = {r["doc_id"]: r["_ld_gone"] for r in linededup.dedup_lines(docs).collect()}
    assert [k for k, gone in got.items() if not gone] == [0, 1, 2]
    assert sum(pairs) < 4 * n


def test_lines_alike_in_rare_words_only_are_no_pairs(spark, monkeypatch):
    """Lines that share all their rare words and half of the common ones: the maps of whole lines tell them apart before any pair is written."""
    n, pool, rare = 60, [f"common{k}" for k in range(46)], [f"rare{k}" for k in range(17)]
    picks = [random.Random(k).sample(pool, 23) for k in range(n)]
    docs = [(k, " ".join(rare + p)) for k, p in enumerate(picks)] + [(n, "\n".join(" ".join([w] * 500) for w in pool))]
    sizes = []

    def counted(df, name):
        out = materialize(df, name)
        if {"x", "y"} <= {*out.columns}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sets = [{*rare, *p} for p in picks]
    unlike = [k for k in range(n) if all(5 * len(sets[k] & s) < 4 * len(sets[k] | s) for s in sets[:k])]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["doc_id"]) if not r["_ld_gone"]] == [*unlike, n]
    assert sum(sizes) < 4 * n
