"""Sources: pruned and globally indexed parquet, window archives as JSON, capped files, pools, JSON lines and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.prefix import running

#: The archive's schema; a record that does not fit it is corrupt and skipped.
ARCHIVE_SCHEMA = (
    "window_start bigint, validator_hotkey string, randomness string, environment string, "
    "batch array<struct<hotkey:string,prompt_idx:bigint,sigma:double,prompt:string,ground_truth:string,"
    "rollouts:array<struct<tokens:array<int>,reward:double,completion_length:int,eos_terminated:boolean,completion_text:string>>,"
    "response_time:double,merkle_root:string,claimed_checkpoint_hash:string,sketch_diff_max:bigint,lp_dev_max:double,dist_q10_min:double>>, "
    "runners_up array<struct<hotkey:string,prompt_idx:bigint,sigma:double,response_time:double,merkle_root:string,sketch_diff_max:bigint,lp_dev_max:double,dist_q10_min:double>>, "
    "reject_summary map<string,int>"
)


def indexed_parquet(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """The columns and idx, a global row number: files by name, rows as they lie in them.

    Row counts come per file (a metadata-sized table); only it is ordered in one place, never the rows.
    """
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("_file", F.coalesce(F.sum("n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").select((F.col("_start") + F.col("_row")).alias("idx"), *columns)


def lookup(indexed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows of wanted (want) with their row, the index taken modulo n."""
    return wanted.withColumn("idx", F.pmod("want", F.lit(n))).join(indexed, "idx")


def first_files(spark: SparkSession, path: str, k: int) -> list[str]:
    """The first k file names of a folder, by name, from the listing alone."""
    return sorted(spark.read.parquet(path).inputFiles())[:k]


def eligible_indices(spark: SparkSession, path: str, column: str, allowed: list[str], max_files: int | None = None) -> DataFrame:
    """Absolute indices of rows of the first files (of all without a number) whose column is allowed."""
    files = path if max_files is None else first_files(spark, path, max_files)
    rows = indexed_parquet(spark, files, [column])
    return rows.where(F.col(column).isin(allowed)).select("idx")


def read_archive(spark: SparkSession, path: str, current: int | None = None, n: int | None = None) -> DataFrame:
    """Archive records of windows in [max(0, current - n), current), oldest first; corrupt records and files are skipped.

    Folders ``window=`` are partitions, so a range of windows lists and reads those folders only. Files outside such folders are
    read whole and cut by the record's own window.
    """
    schema = ARCHIVE_SCHEMA + ", _corrupt string, window bigint"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    rows = reader.json(path)
    if current is not None and n is not None:
        within = lambda c: (F.col(c) >= max(0, current - n)) & (F.col(c) < current)
        rows = rows.where((F.col("window").isNull() | within("window")) & within("window_start"))
    return rows.where(F.col("_corrupt").isNull() & F.col("window_start").isNotNull()).drop("_corrupt", "window").orderBy("window_start")


def window_keys(spark: SparkSession, path: str) -> DataFrame:
    """Sorted window numbers that the file names of an archive hold."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    number = F.regexp_extract("path", r"window[_=-](\d+)", 1)
    return files.select(number.alias("w")).where("w <> ''").select(F.col("w").cast("bigint").alias("window_n")).distinct().orderBy("window_n")


def capped_files(spark: SparkSession, path: str, cap: int = 350_000_000) -> DataFrame:
    """(path, modified, length) of files up to the cap; the content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= cap).select("path", F.col("modificationTime").alias("modified"), "length")


def rollout_file(spark: SparkSession, path: str, schema: str, cap: int = 350_000_000) -> DataFrame:
    """Rows of JSON list files within the cap; other JSON gives none."""
    paths = [r["path"] for r in capped_files(spark, path, cap).collect()]  # one folder's file names
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(paths)


def read_pool(spark: SparkSession, path: str, checkpoint: Column) -> DataFrame:
    """Pool entries, oldest file first, and whether their checkpoint is stale; those that would not fit any more are the last ones."""
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    meta = rows.select("*", F.col("_metadata.file_modification_time").alias("saved"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return meta.withColumn("stale", F.col("checkpoint_n") != checkpoint).orderBy("saved", "_file", "_row").drop("_file", "_row")


def stale_count(pool: DataFrame) -> DataFrame:
    """One row: how many entries a pool holds, and how many of them are stale."""
    return pool.agg(F.count(F.lit(1)).alias("entries"), F.count_if("stale").alias("stale"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema."""
    return spark.read.schema(schema).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def first_routable(meta: DataFrame) -> DataFrame:
    """The first permitted entry with an address."""
    return meta.where(F.col("permit") & (F.coalesce("axon", F.lit("")) != "")).orderBy("pos").limit(1)


def unzip_metagraph(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(pos, hotkey, uid, permit, axon) from rows of parallel arrays, with the columns ``keep`` of the row."""
    keep = keep or []
    return rows.select(*keep, F.posexplode(F.arrays_zip("hotkeys", "uids", "permits", "axons")).alias("pos", "z")).select(*keep, "pos", F.col("z.hotkeys").alias("hotkey"), F.col("z.uids").alias("uid"), F.col("z.permits").alias("permit"), F.col("z.axons").alias("axon"))


def first_match(mirror: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of source that the mirror knows: of each key the first with cases."""
    w = W.partitionBy(key).orderBy(order)
    usable = source.join(mirror.select(key).distinct(), key, "left_semi").where(F.length(F.coalesce("cases", F.lit(""))) > 0)
    return usable.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def start_of_range(points: DataFrame, starts: DataFrame) -> DataFrame:
    """Greatest lower bound: for each idx the last start at or below it, by one ordered pass over both.

    The rows are dealt by ranges of idx, and each range begins with the last start below it, so no task sees everything.
    """
    both = points.select("idx", F.lit(None).cast("bigint").alias("start"), F.lit(1).alias("kind")).unionAll(starts.select(F.col("start").alias("idx"), "start", F.lit(0).alias("kind")))
    width = 1 << 16
    both = both.withColumn("range", F.floor(F.col("idx") / width))
    carry = both.groupBy("range").agg(F.max("start").alias("top"))
    carry = running(carry, ["range"], "top", "carry", "max")
    w = W.partitionBy("range").orderBy("idx", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("start", ignorenulls=True).over(w)).where("kind = 1").join(carry, "range")
    return found.select("idx", F.coalesce("own", "carry").alias("start"))
