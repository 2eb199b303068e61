"""Round trips through sources and sinks, and streams against batch results."""

from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import selection
from tallyforge.sources import lens, readers, writers
from tallyforge.streaming import windows as streams


def test_archive_round_trip_and_corrupt_records(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(5, "v", "ab", "math", [("a", 1)], {"bad": 2}), (7, "v", "cd", "math", [], {})], "window_start bigint, validator_hotkey string, randomness string, environment string, batch array<struct<hotkey:string,prompt_idx:bigint>>, reject_summary map<string,int>")
    writers.write_archive(rows, path)
    writers.write_archive(rows.where("window_start = 7").withColumn("randomness", F.lit("ef")), path)
    with gzip.open(os.path.join(path, "window=5", "broken.json.gz"), "wt") as f:
        f.write("{not json\n")
    got = readers.read_archive(spark, path).collect()
    assert [(r["window_start"], r["randomness"]) for r in got] == [(5, "ab"), (7, "ef")]
    assert got[0]["batch"][0]["hotkey"] == "a" and got[0]["reject_summary"] == {"bad": 2}
    assert [r["window_start"] for r in readers.read_archive(spark, path, 7, 2).collect()] == [5]
    assert [r["window_n"] for r in readers.window_keys(spark, path).collect()] == [5, 7]
    assert readers.capped_files(spark, path, cap=10).count() == 0


def test_archive_ranges_read_their_folders_only(spark, tmp_path):
    path, flat = str(tmp_path / "archive"), str(tmp_path / "flat")
    schema = "window_start bigint, validator_hotkey string, randomness string, environment string, batch array<struct<hotkey:string,prompt_idx:bigint>>, reject_summary map<string,int>"
    rows = spark.createDataFrame([(k, "v", "ab", "math", [], {}) for k in range(6)], schema)
    writers.write_archive(rows, path)
    writers.write_json_lines(rows, flat)
    got = readers.read_archive(spark, path, 5, 2)
    assert [r["window_start"] for r in got.collect()] == [3, 4] and "window" not in got.columns
    scan = next(line for line in got._jdf.queryExecution().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [(" in scan and "window#" in scan.split("PartitionFilters: [")[1]
    assert [r["window_start"] for r in readers.read_archive(spark, flat, 5, 2).collect()] == [3, 4]


def test_index_over_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    for k, part in enumerate((["math", "gsm"], ["gsm", "code"])):
        spark.createDataFrame([(x, k) for x in part], "src string, k int").coalesce(1).write.parquet(f"{path}/p{k}")
    files = [f"{path}/p0", f"{path}/p1"]
    got = readers.indexed_parquet(spark, files, ["src"]).orderBy("idx").collect()
    assert [(r["idx"], r["src"]) for r in got] == [(0, "math"), (1, "gsm"), (2, "gsm"), (3, "code")]
    wanted = spark.createDataFrame([(5,)], "want bigint")
    assert readers.lookup(readers.indexed_parquet(spark, files, ["src"]), wanted, 4).first()["src"] == "gsm"


def test_eligible_indices_cover_all_files(spark, tmp_path):
    from tallyforge.plans import catalog

    path = str(tmp_path / "documents.parquet")
    for part in (["de", "en", "fr"], ["fr", "es"], ["de"]):
        spark.createDataFrame([(x,) for x in part], "lang string").coalesce(1).write.mode("append").parquet(path)
    files = readers.first_files(spark, path, 3)
    langs = [r["lang"] for f in files for r in spark.read.parquet(f).collect()]
    want = [k for k, x in enumerate(langs) if x in ("de", "fr")]
    assert sorted(r["idx"] for r in catalog.REGISTRY.queries["eligible_indices"](spark, str(tmp_path)).collect()) == want
    first = spark.read.parquet(files[0]).count()
    assert sorted(r["idx"] for r in readers.eligible_indices(spark, path, "lang", ["de", "fr"], 1).collect()) == [k for k in want if k < first]


def test_pool_lists_json_csv(spark, tmp_path):
    pool = str(tmp_path / "pool")
    rows = spark.createDataFrame([(1, 3, "math"), (2, 4, "code")], "prompt_idx bigint, checkpoint_n int, env_name string")
    writers.write_pool(rows, pool)
    assert readers.read_pool(spark, pool, F.lit(4)).where("stale").count() == 1
    (tmp_path / "list").mkdir()
    (tmp_path / "list/a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert readers.rollout_file(spark, str(tmp_path / "list"), "x int").count() == 2
    assert readers.rollout_file(spark, str(tmp_path / "list"), "x int", cap=1).count() == 0
    writers.write_json_lines(rows, str(tmp_path / "jl"))
    assert readers.json_lines(spark, str(tmp_path / "jl"), "prompt_idx bigint").count() == 2
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert readers.csv_rows(spark, str(tmp_path / "csv"), "prompt_idx bigint, checkpoint_n int, env_name string").count() == 2
    assert writers.path_exists(spark, pool) and writers.delete_path(spark, pool) and not writers.path_exists(spark, pool)
    writers.delete_path(spark, pool)


def test_sealed_map_and_metrics(spark):
    text = writers.seal_map({"3": "a"}, b"k")
    assert writers.open_map(text, b"k") == {"3": "a"} and writers.open_map(text.replace('"a"', '"b"'), b"k") == {} and writers.open_map("x", b"k") == {}
    seen, warned = [], []
    sink = writers.metrics_sink(seen.append, warned.append)
    sink(spark.createDataFrame([(1,)], "n int"), 0)
    broken = writers.metrics_sink(lambda row: 1 / 0, warned.append)
    broken(spark.createDataFrame([(1,)], "n int"), 1)
    broken(spark.createDataFrame([(1,)], "n int"), 2)
    assert seen == [{"n": 1, "epoch": 0}] and len(warned) == 1


@pytest.fixture
def feed(spark, data, tmp_path):
    """Submissions as two files of a stream."""
    path = str(tmp_path / "feed")
    subs = lens.submissions(spark, data).withColumn("ts", F.timestamp_seconds("arrived_at")).orderBy("arrived_at").limit(400).cache()
    subs.coalesce(1).write.parquet(path)
    return subs, path, subs.schema


def test_stream_seals_like_batch(spark, feed):
    from tallyforge.config import EngineConfig

    subs, path, schema = feed
    stream = streams.capped_source(spark, path, schema)
    got = {r["window_n"]: r["sealed_at"] for r in streams.drain(streams.sealed_windows(stream, EngineConfig(batch_size=2)), "sealed").collect()}
    want = {r["window_n"]: r["sealed_at"] for r in selection.seal_points(subs.where("valid"), 2).where("sealed_at IS NOT NULL").collect()}
    assert got == want and want


def test_stream_claims_and_firing(spark, feed):
    subs, path, schema = feed
    stream = streams.capped_source(spark, path, schema)
    assert streams.drain(streams.claims(stream), "claims").count() == subs.where("valid").select("window_n", "prompt_idx").distinct().count()
    assert streams.drain(streams.fired_once(streams.capped_source(spark, path, schema)), "fired").count() == subs.select("window_n").distinct().count()
    late = streams.on_window(stream.withColumn("current_window", F.lit(0)), "window_n")
    assert "late" in late.columns
