"""Prefix sums, lifecycles, environments, canonical JSON, polled sources, state sinks, bounded files and remembered scans."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import environments, lifecycle, probes
from tallyforge.operators.prefix import running
from tallyforge.sources import bounded, polls, readers, statesink


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_a_loop(spark, how, inclusive):
    rows = [(k * 37 % 1009, (k * 7) % 13 - 6 if k % 5 else None) for k in range(1000)]
    got = {r["k"]: r["out"] for r in running(spark.createDataFrame(rows, "k bigint, v bigint"), ["k"], "v", "out", how, inclusive).collect()}
    total, want = 0 if how == "sum" else None, {}
    for k, v in sorted(rows):
        fold = total
        if v is not None:
            fold = total + v if how == "sum" else v if total is None else max(total, v)
        want[k] = fold if inclusive else total
        total = fold
    assert got == want
    with pytest.raises(ValueError):
        running(spark.range(1), ["id"], "id", "x", "min")


def test_no_window_over_all_rows_in_one_task(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("score"), (F.col("id") % 3 == 0).alias("label"))
    plan = probes.auc(rows, "score", "label")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[-1] or plan.count("Window") <= 4
    starts = readers.start_of_range(spark.range(0, 1_000_000, 5000).withColumnRenamed("id", "idx"), spark.range(0, 1_000_000, 77_777).select(F.col("id").alias("start")))
    assert all(r["start"] == r["idx"] // 77_777 * 77_777 for r in starts.collect())


def test_lifecycle_refuses_illegal_steps(spark):
    events = ["sealed", "opened", "opened", "sealed", "published", "skipped", "kept", None, "opened"]
    df = spark.createDataFrame([("w", i, e) for i, e in enumerate(events)] + [("other", 0, "opened")], "key string, ord bigint, event string")
    got = sorted((r["ord"], r["before"], r["after"], r["accepted"]) for r in lifecycle.follow(df, "key", ["ord"]).where("key = 'w'").collect())
    states = ["ready", "ready", "open", "open", "training", "training", "publishing", "ready", "ready", "open"]
    assert got == [(i, states[i], states[i + 1], states[i] != states[i + 1]) for i in range(9)]


def test_catalogue_loads_wraps_and_rewards(spark):
    known = environments.Catalogue()
    problems = spark.createDataFrame([(0, "p0", "a"), (1, "p1", "b")], "idx bigint, prompt string, ground_truth string")
    known.register(environments.Environment("x", problems, lambda g, t: (g == t).cast("double")))
    with pytest.raises(ValueError):
        known.load("y")
    with pytest.raises(ValueError):
        known.register(known.load("x"))
    rows = spark.createDataFrame([("x", 5), ("x", 2), ("y", 0)], "env string, index bigint")
    at = {r["index"]: (r["prompt"], r["id"]) for r in known.problems_at(rows).collect()}
    assert at == {5: ("p1", hashlib.sha256(b"p1").hexdigest()[:16]), 2: ("p0", hashlib.sha256(b"p0").hexdigest()[:16])}
    given = spark.createDataFrame([("x", "a", "a"), ("x", None, "a"), ("y", "a", "a")], "env string, c string, t string")
    assert [r[0] for r in given.select(known.reward(F.col("env"), F.col("c"), F.col("t"))).collect()] == [1.0, 0.0, None]


def test_canonical_json_equals_sorted_dumps(spark):
    leaf = st.none() | st.booleans() | st.integers(-(10**30), 10**30) | st.text(max_size=6)
    tree = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)
    values = []

    @settings(max_examples=150, deadline=None)
    @given(tree)
    def draw(v):
        values.append(v)

    draw()
    values = [v for v in values if not any(0xD800 <= ord(c) < 0xE000 for c in json.dumps(v, ensure_ascii=False))]
    df = spark.createDataFrame([(i, json.dumps(v, indent=1, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)], "i int, j string")
    got = {r["i"]: r["c"] for r in df.select("i", text.canonical_json(F.col("j")).alias("c")).collect()}

    def ordered(v):  # by UTF-16 units, which is by code points but for keys beyond the basic plane
        if isinstance(v, dict):
            return {k: ordered(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be"))}
        return [ordered(x) for x in v] if isinstance(v, list) else v

    assert got == {i: json.dumps(ordered(v), separators=(",", ":")) for i, v in enumerate(values)}
    assert spark.createDataFrame([("{bad",), (None,)], "j string").select(text.canonical_json(F.col("j")).alias("c")).where("c IS NULL").count() == 2


@pytest.fixture
def server():
    store = {"k 1": [], "k2": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            from urllib.parse import unquote

            url = urlparse(self.path)
            key, since = unquote(url.path.rsplit("/", 1)[-1]), float(parse_qs(url.query)["since"][0])
            body = json.dumps([r for r in store.get(key, []) if r.get("ts", 9e9) > since] if key != "odd" else {"no": "list"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield store, f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_polled_stream_goes_on_and_replays(spark, server, tmp_path):
    store, base = server
    row = lambda ts: {"ts": ts, "merkle_root": f"r{ts}", "window_n": 1, "accepted": True, "reason": "accepted", "rewarded": None}
    store["k 1"] += [row(1.0), row(2.5)]
    store["k2"] += [row(2.0), {"bad": 1}]

    def run():
        query = polls.polled(spark, base, ["k 1", "k2", "odd"], since=1.0, per_task=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["key"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("k 1", 2.5), ("k2", 2.0)]
    store["k 1"].append(row(3.0))
    store["k2"].append(row(3.0))
    assert run() == [("k 1", 2.5), ("k 1", 3.0), ("k2", 2.0), ("k2", 3.0)]
    assert run() == [("k 1", 2.5), ("k 1", 3.0), ("k2", 2.0), ("k2", 3.0)]
    reader = polls.PollReader({"base": base, "keys": '["k 1", "k2"]'})
    spans = reader.partitions({"since": 1.0}, {"since": 2.5})
    once = [r for s in spans for r in reader.read(s)]
    store["k 1"].append(row(9.0))
    assert [r for s in spans for r in reader.read(s)] == once and {r[1] for r in once} == {2.5, 2.0}


def test_state_sink_writes_an_epoch_once(spark, tmp_path):
    path = str(tmp_path / "state")
    sink = statesink.StateSink(path)
    state = lambda n: spark.createDataFrame([(k, n) for k in range(3)], "k int, n int")
    assert statesink.read_state(spark, path, "k int, n int").count() == 0
    sink(state(0), 0)
    os.makedirs(f"{path}/_writing-0-{uuid.uuid4().hex}")  # a writer that was lost
    sink(state(1), 1)
    sink(state(7), 1)  # replayed with other rows: the first write stays
    sink(state(8), 0)  # older
    assert {r["n"] for r in statesink.read_state(spark, path, "k int, n int").collect()} == {1}
    sink(state(2), 2)
    assert statesink.epochs(spark, path) == [1, 2] and not [n for n in os.listdir(path) if n.startswith("_writing")]
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().selectExpr("CAST(value AS INT) AS k", "1 AS n")
    query = rate.writeStream.foreachBatch(statesink.StateSink(str(tmp_path / "s2"))).trigger(once=True).start()
    query.awaitTermination()
    assert statesink.read_state(spark, str(tmp_path / "s2"), "k int, n int").count() == 5


def test_bombs_are_refused_without_being_expanded(spark, tmp_path):
    files = {
        "ok.json.gz": gzip.compress(b'[{"x": 1}, {"x": 2}]'), "bomb.json.gz": gzip.compress(b"[" + b" " * 50_000_000 + b"]"), "object.json.gz": gzip.compress(b'{"x": 1}'), "broken.json.gz": gzip.compress(b'[{"x": 1}]' * 3)[:-9],
        "two.json.gz": gzip.compress(b'[{"x": 3},') + gzip.compress(b' {"x": 4}]'), "plain.json": b'[{"x": 5}]', "large.json": b"[" + b" " * 5000 + b"]", "bytes.json": b"[\xff]", "empty.json.gz": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r["path"]): r["rollouts"] and [x["x"] for x in r["rollouts"]] for r in bounded.rollout_files(spark, str(tmp_path), "x: int", cap=60_000, ratio=20).collect()}
    assert got == {n: None for n, data in files.items() if data} | {"ok.json.gz": [1, 2], "two.json.gz": [3, 4], "plain.json": [5], "large.json": []}
    import tracemalloc

    tracemalloc.start()
    assert bounded.gunzip_within(files["bomb.json.gz"], 20 * len(files["bomb.json.gz"])) is None
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    assert bounded.gunzip_within(files["bomb.json.gz"], 10**8) == b"[" + b" " * 50_000_000 + b"]"


def test_second_scan_reads_no_data_file(spark, tmp_path):
    path, memo = str(tmp_path / "data"), str(tmp_path / "memo")
    rows = lambda n: spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"), "id")
    rows(90).coalesce(1).write.parquet(path)
    first = bounded.eligible_remembered(spark, path, "s", ["a"], memo)
    assert sorted(r["idx"] for r in first.collect()) == list(range(0, 90, 3))
    kept = os.listdir(memo)
    again = bounded.eligible_remembered(spark, path, "s", ["a"], memo)
    assert os.listdir(memo) == kept and all("/memo/" in f for f in again.inputFiles()) and again.count() == 30
    assert bounded.eligible_remembered(spark, path, "s", ["a", "b"], memo).count() == 90 and len(os.listdir(memo)) == 2
    rows(30).coalesce(1).write.mode("append").parquet(path)
    assert bounded.eligible_remembered(spark, path, "s", ["a"], memo).count() == 40
    assert bounded.eligible_remembered(spark, path, "s", ["a"], memo, max_files=1).count() in (30, 10)


def test_field_constraints_keep_their_column_of_retries(spark, data):
    from tallyforge.plans import queries_groups

    df = queries_groups.field_constraints(spark, data)
    assert set(df.columns) == {"ord", "reason", "server", "http", "retryable"} and "retryable" in queries_groups.REGISTRY.oracles["field_constraints"]
    assert df.count() == spark.read.parquet(f"{data}/events.parquet").count()
