"""Vector codes: against brute force on the table and on odd rows; the search against a full scan."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import skew, vectorcodes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Python over (vec_id, label, components) of kept rows."""
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(ordered[0][2]) // parts
    cut = lambda v, p: np.array(v[p * width : (p + 1) * width], dtype=object)
    books = [[cut(r[2], p) for r in ordered[:entries]] for p in range(parts)]

    def assign():
        out = []
        for p in range(parts):
            m = np.array([list(cut(r[2], p)) for r in kept], dtype=np.int64)
            b = np.array([list(e) for e in books[p]], dtype=np.int64)
            d = ((m[:, None, :] - b[None, :, :]) ** 2).sum(2)
            out.append((d.argmin(1), d.min(1)))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(r[2], p) for r, c in zip(kept, found[p][0]) if c == e]
                if own:
                    books[p][e] = np.array([int(s) // len(own) for s in sum(own)], dtype=object)
    found = assign()
    error = [int(sum(found[p][1][k] for p in range(parts))) for k in range(len(kept))]
    labels = {}
    for (_, lab, _), e in zip(kept, error):
        labels[lab] = labels.get(lab, 0) + e
    code = ["".join(f"{found[p][0][k]:02x}" for p in range(parts)) for k in range(len(kept))]
    flat = [int(x) for p in range(parts) for e in books[p] for x in e]
    return sorted(repr((i, c, e, labels[lab])) for (i, lab, _), c, e in zip(kept, code, error)), flat


def got(df):
    return sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in df.collect())


def test_query_equals_brute_force(spark, data):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, flat = brute(rows)
    found = vectorcodes.op11_vector_codes(spark, data)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(found) == want
    assert {r[0] for r in found.select("codebooks_sha256").distinct().collect()} == {vectorcodes.codebooks_digest(np.array(flat))}


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k) if k % 9 else None, int(k % 3) if k % 4 else None, [float(x) for x in rng.normal(size=8).round(1)]) for k in range(300)]
    rows += [(1, 1, rows[1][2]), (1, 1, rows[2][2]), (400, 2, None), (401, 2, [None] + [0.0] * 7), (402, None, [math.nan] * 8), (403, 1, [math.inf] + [0.0] * 7), (404, 0, [-300.7] * 8), (405, 0, [0.1] * 8), (405, 0, [0.1] * 8)]
    schema = "vec_id bigint, label int, embedding array<double>, x string, codes string, error string, n string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)
    for entries in (256, 7):
        want, flat = brute(rows, entries=entries)
        codes, books = vectorcodes.compress(df, entries=entries)
        assert got(codes) == want and books.ravel().tolist() == flat
    few = df.where("vec_id IN (404, 405)")
    codes, books = vectorcodes.compress(few)
    assert books.shape == (4, 3, 2) and {r["error"] for r in codes.collect()} == {0}
    other = spark.createDataFrame([(500, 1, [1.0] * 3), (501, 1, []), (502, 1, [1e300] * 8), (503, 9, [1e9] * 8)], "vec_id bigint, label int, embedding array<double>")
    codes = vectorcodes.compress(df.select("vec_id", "label", "embedding").union(other))[0].collect()
    assert {r["code"] for r in codes if r["vec_id"] and r["vec_id"] >= 500} == {None} and len(codes) == 309 - 4 + 4
    assert vectorcodes.compress(df.where("false"))[0].count() == 0 and vectorcodes.compress(other)[0].where("code IS NULL").count() == 4


def test_hot_label_is_dealt(spark, monkeypatch):
    rows = [(k, 1 if k % 3 else k, [float(k % 11), 0.5, float(k % 7), -1.0]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    monkeypatch.setattr(skew, "HOT_LEAST", 20)
    assert got(vectorcodes.compress(df, entries=16)[0]) == brute(rows, entries=16)[0]


@pytest.mark.parametrize("size", [1 << 3, 1 << 22, 1 << 26])
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_search_equals_full_scan(size, data):
    cell = st.integers(-size, size)
    entries = np.array(data.draw(st.lists(st.lists(cell, min_size=3, max_size=3), min_size=1, max_size=20)), np.int64)
    x = np.array(data.draw(st.lists(st.lists(cell, min_size=3, max_size=3), min_size=1, max_size=20)), np.int64)
    start = np.array(data.draw(st.lists(st.integers(0, len(entries) - 1), min_size=len(x), max_size=len(x))), np.int64)
    code, error = vectorcodes.Codebook(entries).nearest(x, start)
    d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    assert code.tolist() == d.argmin(1).tolist() and error.tolist() == d.min(1).tolist()
