"""What the steps of text operators leave on disk."""

from __future__ import annotations

import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyforge.session import discard, materialize


def test_tables_between_steps_are_compressed_by_zstd(spark):
    out = materialize(spark.range(1000).withColumn("s", F.col("id").cast("string")), "trial")
    folder = out.scratch_path.removeprefix("file:")
    kinds = {pq.ParquetFile(f"{folder}/{f}").metadata.row_group(0).column(1).compression for f in os.listdir(folder) if f.endswith(".parquet")}
    assert kinds == {"ZSTD"} and out.count() == 1000
    discard(out)
