"""Benchmark decontamination: a prefix-filtered set join of item windows against document words.

A window is a run of ``window`` consecutive words of an item (a shorter item is one window). Its tokens are the
shingles inside it (``shingle`` words, or the whole window if that is shorter). A window occurs only where all of its
shingles do, so for containment its prefix is one token, and the rarest one is joined:

1. document shingles that are benchmark shingles are found in one scan (64-bit hashes, positions kept);
2. their counts over the whole corpus order each window's shingles by rarity;
3. only the rarest shingle of each window proposes candidates; the shingle's offset in the window gives the one
   possible start (positional filter), and windows that would stick out of the document are dropped (length filter);
4. each candidate is verified word by word against the document, so hash collisions cannot add a hit.

The benchmark's shingles are broadcast only while their counted number is within ``BROADCAST_SHINGLES``; beyond it
the same join shuffles. Documents meet their own candidates under their id, one row each; no two documents meet. Only texts
that have candidates move for that, while their counted keys are within ``BROADCAST_KEYS``; beyond it all texts do.
Steps are written as tables: the benchmark's few rows then come back in few tasks, however many the session's shuffles have,
and the driver's memory follows the tasks.

Defined results: null or empty texts have no words and no hits; a null doc_id is matched by the hash of its text;
repeated documents each give a row; items with a null id mark words but are in no list; with an empty benchmark
nothing is hit; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.textops import NON_ALNUM, alnum_words, row_key, split_words
from tallyforge.plans.registry import table
from tallyforge.session import discard, materialize

WINDOW = 10
SHINGLE = 3
#: Rows of (hash) that may be broadcast: 16 bytes each, 16 MB at most.
BROADCAST_SHINGLES = 1_000_000
#: Keys of documents with candidates that may be broadcast, 8 bytes each.
BROADCAST_KEYS = 2_000_000


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _shingles(words: Column, size: int) -> Column:
    """The hashes of all shingles of a size, in order."""
    return F.transform(_starts(words, size), lambda i: _shingle(words, i, size))


def _starts(words: Column, size: Column | int) -> Column:
    """0 .. n - size, or nothing."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows: win (id), words, len, items (ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    parts = items.select("item_id", F.explode(F.transform(_starts(F.col("w"), length), lambda i: F.slice(F.col("w"), i + 1, length))).alias("words"))
    return parts.groupBy("words").agg(F.array_compact(F.collect_set("item_id")).alias("items")).select(F.xxhash64("words").alias("win"), "words", F.size("words").alias("len"), "items")


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every shingle of every window: win, len, off, h, size."""
    sized = []
    for size in range(1, shingle + 1):
        mine = windows.where((F.col("len") >= shingle) if size == shingle else (F.col("len") == size))
        sized.append(mine.select("win", "len", F.posexplode(_shingles(F.col("words"), size)).alias("off", "h"), F.lit(size).alias("size")))
    out = sized[0]
    for part in sized[1:]:
        out = out.unionAll(part)
    return out


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents as key, doc_id, words; candidates as key, start, win, words, items)."""
    spark = docs.sparkSession
    windows = materialize(item_windows(benchmark, window), "item-windows")
    grams = materialize(window_shingles(windows, shingle), "item-shingles")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most `shingle` values
    known = grams.select("h", "size").distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    words = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id"), alnum_words(F.col("text")).alias("words"))
    found = None
    for size in sizes:
        at = words.select("key", F.size("words").alias("n"), F.posexplode(_shingles(F.col("words"), size)).alias("pos", "h"))
        at = at.join(known.where(F.col("size") == size).select("h"), "h")
        found = at if found is None else found.unionAll(at)
    if found is None:
        discard(windows, grams)
        return words, spark.createDataFrame([], "key bigint, start int, win bigint, words array<string>, items array<string>")
    found = materialize(found, "met-shingles")
    rarity = found.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    first = grams.join(rarity, "h").groupBy("win", "len").agg(F.min(F.struct("df", "h", "off")).alias("p"), F.count(F.lit(1)).alias("present"))
    # a window with a shingle that no document holds occurs nowhere
    full = F.when(F.col("len") >= shingle, F.col("len") - shingle + 1).otherwise(1)
    first = first.where(F.col("present") == full).select("win", "len", F.col("p.h").alias("h"), F.col("p.off").alias("off"))
    hits = found.join(first, "h").select("key", (F.col("pos") - F.col("off")).alias("start"), "len", "n", "win")
    hits = hits.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))).select("key", "start", "win").distinct()
    candidates = materialize(hits.join(windows, "win").select("key", "start", "win", "words", "items"), "item-candidates")
    discard(windows, grams, found)
    return words, candidates


def moved_texts(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, text) of every document, for the join with its candidates; text is null where there is none.

    Words are counted before the join and texts move as they are, as an array of words takes more than twice the room. A
    text without a candidate has nothing to verify and stays where it is, while the keys of the others may be broadcast.
    """
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", F.size(split_words(F.col("text"), NON_ALNUM)).cast("bigint").alias("n_words"), "text")
    met = hits.select("key").distinct()
    if met.count() > BROADCAST_KEYS:
        return rows
    marked = rows.join(F.broadcast(met.withColumn("met", F.lit(True))), "key", "left")
    return marked.select("key", "doc_id", "n_words", F.when(F.col("met"), F.col("text")).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items (sorted ids), contaminated."""
    _, hits = contaminated_windows(docs, benchmark, window, shingle)
    lists = hits.groupBy("key").agg(F.collect_list(F.struct("start", "words", "items")).alias("hits"))
    joined = moved_texts(docs, hits).join(lists.hint("shuffle_hash"), "key", "left")
    # the words of a text are made once, not for every candidate
    verified = F.transform(F.array(alnum_words(F.col("text"))), lambda words: F.filter("hits", lambda x: F.slice(words, x["start"] + 1, F.size(x["words"])) == x["words"]))
    none = F.array().cast("array<struct<start:int,words:array<string>,items:array<string>>>")
    out = joined.select("doc_id", "n_words", F.when(F.col("hits").isNotNull(), F.get(verified, F.lit(0))).otherwise(none).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + F.size(x["words"]) - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    out = out.select("doc_id", "n_words", F.size(covered).cast("bigint").alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs in which no window occurs."""
    words, hits = contaminated_windows(docs, benchmark, window, shingle)
    lists = hits.groupBy("key").agg(F.collect_list(F.struct("start", "words")).alias("_dc_hits")).withColumnRenamed("key", "_dc_key")
    joined = docs.withColumn("_dc_key", row_key(F.col("doc_id"), F.col("text"))).join(lists.hint("shuffle_hash"), "_dc_key", "left")
    joined = joined.withColumn("_dc_words", F.when(F.col("_dc_hits").isNotNull(), alnum_words(F.col("text"))))
    occurs = F.exists("_dc_hits", lambda x: F.slice(F.col("_dc_words"), x["start"] + 1, F.size(x["words"])) == x["words"])
    return joined.where(~F.coalesce(occurs, F.lit(False))).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH lowered AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, r, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
win AS (SELECT DISTINCT id, len, array_to_string(list_slice(ws, s + 1, s + len), ' ') AS g
  FROM (SELECT id, ws, least(len(ws), 10) AS len, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS s FROM w WHERE kind = 1 AND len(ws) > 0)),
lens AS (SELECT DISTINCT len FROM win),
dg AS (SELECT r, len, s, array_to_string(list_slice(ws, s + 1, s + len), ' ') AS g
  FROM (SELECT r, ws, len, unnest(range(0, len(ws) - len + 1)) AS s FROM w, lens WHERE kind = 0 AND len(ws) >= len)),
hit AS (SELECT dg.r, dg.s, dg.len, win.id FROM dg JOIN win ON dg.len = win.len AND dg.g = win.g),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + len)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, list(DISTINCT id::VARCHAR ORDER BY id::VARCHAR) FILTER (WHERE id IS NOT NULL) AS items FROM hit GROUP BY r)
SELECT id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (r) LEFT JOIN its USING (r) WHERE kind = 0
"""
