"""A state table that is replaced whole, once an epoch: written aside, then renamed, so a reader sees the old state or the new one."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs that are there, in order."""
    target, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"epoch=(\d+)", n)))


@dataclass(frozen=True)
class StateSink:
    """A ``foreachBatch`` function. An epoch that is already there, or older than one that is, is not written again, so a
    batch that is replayed after a failure leaves one state. The ``keep`` newest epochs stay; leftovers of a writer that was lost are
    cleared by the next one. The path's file system has to rename folders in one step."""

    path: str
    keep: int = 2

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        there = epochs(spark, self.path)
        if there and epoch <= there[-1]:
            return
        aside = f"{self.path}/_writing-{epoch}-{uuid.uuid4().hex}"
        batch.write.parquet(aside)
        source, fs = _folder(spark, aside)
        final, _ = _folder(spark, f"{self.path}/epoch={epoch}")
        if fs.exists(final) or not fs.rename(source, final):
            fs.delete(source, True)
            return
        for old in [*there, epoch][: -self.keep]:
            fs.delete(_folder(spark, f"{self.path}/epoch={old}")[0], True)
        for status in fs.listStatus(_folder(spark, self.path)[0]):
            name = status.getPath().getName()
            if (m := re.match(r"_writing-(\d+)-", name)) and int(m[1]) <= epoch:
                fs.delete(status.getPath(), True)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest state, empty before the first epoch."""
    there = epochs(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/epoch={there[-1]}") if there else spark.createDataFrame([], schema)
