"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text (A-Z lower-cased, null as empty) is cut into chunks at places that its own content names: after a line or
sentence end once ``LEAST`` characters are there, and after ``MOST`` at the latest. A passage that many documents share is thus
cut alike wherever it stands, and its chunks are the same rows. Every distinct chunk moves once, after the copies in a task have
been put together, to prove that its 64-bit hash names no other chunk; hashes that name several get ranks. Hash and
rank are the chunk's verified identifier. A document then is its recipe, the ordered list of identifiers, and equal
recipes mean equal texts; no hash stands in for an equality. The text itself never moves again: rows are grouped by recipe
(8 bytes for a chunk), with counts before the shuffle, and hot groups are dealt to many tasks when each row gets its group.

Of equal texts the row with the largest doc_id stays.

Defined results: null and empty texts are equal, with an empty recipe; a null doc_id is smaller than any other, and
keep_id is null where a group has no other; of rows that share id and text exactly one stays; an empty table gives an
empty table; extra columns are ignored by ``copy_groups`` and kept by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyforge.llm.skew import join_groups
from tallyforge.llm.textops import ascii_lower
from tallyforge.plans.registry import table
from tallyforge.session import discard, materialize

#: Characters of a chunk: at least (but at the end of a text), at most.
LEAST, MOST = 512, 8192
#: A null doc_id in the order of ids: below the smallest bigint.
BELOW = -(1 << 63) - 1


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least - 1},{most - 1}}}?[\n.!?。]|.{{1,{most}}}"), F.lit(0))


def clashing(texts: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(h): hashes that name more than one chunk of texts (t); written, as a rule with no row."""
    parts = texts.select(F.explode(chunks(F.col("t"))).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk")
    return materialize(parts.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "chunk-clashes")


def ranked(texts: DataFrame, clashes: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(sha, fixes): for texts with clashing chunks, the places and ranks of those that are not their hash's first."""
    at = texts.select("sha", F.posexplode(chunks(F.col("t"))).alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk"))).join(clashes, "h", "left_semi")
    names = at.select("h", "chunk").distinct().withColumn("rank", F.row_number().over(W.partitionBy("h").orderBy("chunk"))).where("rank > 1")
    return at.join(names, ["h", "chunk"]).groupBy("sha").agg(F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("fixes"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, rid, sha, recipe, fixes) of every row, written; equal texts have equal recipe and fixes, others have not.

    ``row`` names a column that is unique by row; without it rows are numbered as they are read.
    """
    rid = F.monotonically_increasing_id() if row is None else F.col(row)
    lowered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), rid.alias("rid"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    lowered = lowered.withColumn("sha", F.sha2(F.col("t"), 256))
    none = F.array().cast("array<struct<pos:int,rank:int>>")
    clashes = clashing(lowered, hashed)
    listed = lowered.select("doc_id", "rid", "sha", F.transform(chunks(F.col("t")), lambda c: hashed(c)).alias("recipe"))
    if clashes.isEmpty():
        listed = listed.withColumn("fixes", none)
    else:
        listed = listed.join(ranked(lowered, clashes, hashed), "sha", "left").withColumn("fixes", F.coalesce("fixes", none))
    found = materialize(listed.withColumn("h", F.xxhash64("recipe", "fixes")), "recipes")
    discard(clashes)
    return found


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, rid) of every row."""
    rows = recipes(docs, doc_id, text, row, hashed)
    order = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(BELOW)).cast("decimal(20,0)"))
    groups = rows.groupBy("h", "recipe", "fixes").agg(F.count(F.lit(1)).alias("group_size"), F.max_by("rid", order).alias("top"), F.max("doc_id").alias("keep_id"))
    groups = materialize(groups.where("group_size > 1"), "copies")
    found = join_groups(rows, groups, "h", ["recipe", "fixes"], "group_size", F.col("rid"))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("rid") == F.col("top"))).alias("kept"), F.col("sha").alias("text_sha256"), "rid",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs; of equal texts only the row with the largest doc_id."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = copy_groups(numbered, doc_id, text, row).where("kept").select(F.col("rid").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return copy_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
