"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components.

Fingerprints: words are runs without ASCII white space after A-Z is lower-cased; shingles are four words; a bit is
set if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints within ``max_bits`` (4) are linked.

Two fingerprints that differ in 4 bits or fewer agree on at least 3 of 7 blocks, so each distinct fingerprint is
dealt under its 35 triples of blocks and only those that share a triple are compared. Exact copies are one
fingerprint before that. A bucket above ``BUCKET`` fingerprints is dealt again by triples of its remaining bits, which
is exact by the same argument, and then fits a task by construction: what is left varies in under 24 bits.
Inside a bucket a search visits unvisited fingerprints only and returns the edges of a spanning forest, so a dense
group of n makes n - 1 edges, not n squared pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id gets its component's
smallest doc_id (null if it has none); repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.components import connected_components
from tallyforge.llm.textops import append_from_texts, row_key
from tallyforge.plans.registry import table
from tallyforge.session import ensure_checkpoint_dir

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Bits (first, width) of the seven blocks.
BLOCKS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, extra columns, fp) of every row; fp as a signed 64-bit number."""

    def compute(texts: list[str | None]) -> list[list]:
        return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return append_from_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *extra, "text"), compute, "fp bigint")


def _triples(fp: Column, blocks: tuple[tuple[int, int], ...]) -> Column:
    """An array of (which triple, its bits)."""
    part = {b: F.shiftright(fp, b[0]).bitwiseAND(F.lit((1 << b[1]) - 1)) for b in blocks}
    keys = []
    for k, three in enumerate(combinations(blocks, 3)):
        value = F.lit(0).cast("bigint")
        for b in three:
            value = F.shiftleft(value, b[1]).bitwiseOR(part[b])
        keys.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    return F.array(*keys)


def _again(k: int) -> tuple[tuple[int, int], ...]:
    """Seven blocks over the bits that triple k leaves free, as (first, width) runs within the free blocks."""
    used = list(combinations(BLOCKS, 3))[k]
    free = [b for b in BLOCKS if b not in used]
    halves = [x for first, width in free for x in ((first, width // 2), (first + width // 2, width - width // 2))]
    return (halves[0], halves[1], halves[2], halves[3], halves[4], halves[5], (halves[6][0], halves[6][1] + halves[7][1]))


def link_bucket(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that joins fingerprints within max_bits."""
    left, edges = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                edges.extend((int(at), int(x)) for x in found)
                front.extend(found)
    return edges


def near_edges(distinct: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within max_bits, from distinct fingerprints (fp)."""
    if max_bits > 4:
        raise ValueError("seven blocks by three find pairs of at most 4 differing bits")
    # a number of fingerprints is few bytes but 35 times as many rows: a given number of parts is not made smaller at run time
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    dealt = spread.select("fp", F.explode(_triples(F.col("fp"), BLOCKS)).alias("t")).select("fp", F.col("t.k").alias("k"), F.col("t.v").alias("v"))
    hot = dealt.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("k", "v").checkpoint()
    plain = dealt.select("k", F.col("v").alias("v"), F.lit(-1).alias("k2"), F.lit(0).cast("bigint").alias("v2"), "fp")
    if hot.count():
        plain = dealt.join(hot, ["k", "v"], "left_anti").select("k", "v", F.lit(-1).alias("k2"), F.lit(0).cast("bigint").alias("v2"), "fp")
        crowded = dealt.join(hot, ["k", "v"], "left_semi")
        which = F.when(F.col("k") == 0, _triples(F.col("fp"), _again(0)))
        for k in range(1, 35):
            which = which.when(F.col("k") == k, _triples(F.col("fp"), _again(k)))
        plain = plain.unionAll(crowded.select("k", "v", "fp", F.explode(which).alias("t")).select("k", "v", F.col("t.k").alias("k2"), F.col("t.v").alias("v2"), "fp"))
    buckets = plain.groupBy("k", "v", "k2", "v2").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edges = [e for fps in pdf["fps"] for e in link_bucket(np.sort(np.asarray(fps, dtype=np.int64)).view(np.uint64), max_bits)]
            both = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return buckets.mapInPandas(work, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text)."""
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs).checkpoint()
    return fps.join(labelled(fps, max_bits, bucket), "fp").select("doc_id", "fp", "component_id")


def labelled(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of (doc_id, fp); root tells components apart even where ids clash."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = connected_components(near_edges(nodes.select("fp"), max_bits, bucket)).checkpoint()
    linked = nodes.join(roots, nodes["fp"] == roots["node"])
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(lowest, "root").select("fp", "root", "component_id")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return labels.checkpoint()  # both sides of a join by fp are then dealt for it alone, so a hot fingerprint can be split


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one document of each component: the one with the smallest id stays.

    A null id stands for the hash of its text here. Rows are told apart by id and hash of the text, so different texts under
    one id are different documents (the smaller hash goes first); of several equal rows one stays.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = docs.withColumns({"_sh_key": row_key(F.col("doc_id"), F.col("text")), "_sh_text": F.xxhash64("text")})
    fps = fingerprints(keyed.select(F.col("_sh_key").alias("doc_id"), "_sh_text", "text"), "_sh_text").checkpoint()
    least = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "_sh_text")).alias("row"))
    kept = least.join(labelled(fps), "fp").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("_sh_key"), "row._sh_text")
    own = W.partitionBy("_sh_key", "_sh_text").orderBy("_sh_text")
    rows = keyed.join(kept, ["_sh_key", "_sh_text"], "left_semi").withColumn("_sh_rank", F.row_number().over(own))
    return rows.where("_sh_rank = 1").select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the fingerprint in hex and the component's smallest id."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
