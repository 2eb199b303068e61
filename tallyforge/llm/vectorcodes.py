"""Vector code compression: product codes whose codebooks are trained by Lloyd rounds with an Exponion search.

A component x becomes the integer floor(scale * x). Vectors are cut into equal parts, and each part position has its own
codebook, which starts as the parts of the smallest vec_ids. In every round each part finds its nearest entry, then an entry
becomes the floor of the mean of its parts; entries without parts stay.

The search starts at the entry c of the round before. With d the distance from the part to c, any entry that is no farther
than c lies within 2 d of c (triangle inequality), so only the stretch of c's distance-sorted neighbour list with a squared
distance of 4 d^2 or less is scanned, ties on its rim included. Distances are whole numbers: rows whose numbers stay
below 2^53 in every sum are computed in doubles, which hold them exactly, others in 64-bit integers. Ties go to the
lower index.

The table of integers and codes is written once a round, as small integers, and the round before is dropped; a lost executor costs
its tasks of one round. Codebooks are the only thing on the driver: parts * entries * width sums, whatever the input. Nothing is
shuffled but those sums and, at the end, the error by label, whose hot labels are dealt to many tasks.

Defined results: rows whose vector is null or has a null, NaN or infinite component are left out; those of another length than
the smallest vec_id's, or too large for exact 64-bit distances, have a null code and error and train nothing; a vector
whose length is no positive multiple of the parts is of another length. Null vec_ids come after all others, equal ones in the order
of their vectors. With fewer rows than entries the codebooks are smaller. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.skew import join_groups
from tallyforge.plans.registry import table
from tallyforge.session import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one start entry that are searched together, by distance, so that they share a radius.
BLOCK = 512


class Codebook:
    """The entries of one part position with their neighbour lists."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        self.norms = (self.entries**2).sum(1)
        apart = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry and the squared distance of every row of x (int64), searched from the entries ``start``."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        exact = np.float64 if 4 * x.shape[1] * most**2 < 1 << 53 else np.int64
        rows, entries, norms = x.astype(exact), self.entries.astype(exact), self.norms.astype(exact)
        here = ((rows - entries[start]) ** 2).sum(1)
        own = (rows**2).sum(1)
        code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        by = np.lexsort((here, start))
        ends = np.searchsorted(start[by], np.arange(len(self.entries) + 1))
        for c in np.flatnonzero(np.diff(ends)):
            for low in range(ends[c], ends[c + 1], BLOCK):
                at = by[low : min(low + BLOCK, ends[c + 1])]
                reach = np.searchsorted(self.apart[c], 4 * int(here[at[-1]]), side="right")
                near = np.sort(self.order[c][:reach])
                apart = own[at][:, None] - 2 * (rows[at] @ entries[near].T) + norms[near]
                best = apart.argmin(1)
                code[at], error[at] = near[best], apart[np.arange(len(at)), best]
        return code, error


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each row's codes (one byte a part) and error; a null in codes starts at entry 0."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, before = _vectors(batch.column("x"), parts * width), batch.column("codes")
            if before.null_count:
                start = np.zeros((len(x), parts), np.int64)
            else:
                start = np.frombuffer(b"".join(before.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            found = [book.nearest(x[:, p * width : (p + 1) * width], start[:, p]) for p, book in enumerate(searched)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "x", "codes", "error"])

    return work


def _summed(parts: int, entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each part position and entry that a task has seen: count and component sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _vectors(batch.column("x"), parts * width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                by = np.argsort(codes[:, p], kind="stable")
                seen, first, n = np.unique(codes[by, p], return_index=True, return_counts=True)
                counts[p, seen] += n
                if len(first):
                    sums[p, seen] += np.add.reduceat(x[by, p * width : (p + 1) * width], first)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[tuple(at.T)], pa.int64()), pa.array(list(sums[tuple(at.T)]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return work


def _moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks of the next round: floors of the means of the coded parts."""
    parts, entries, width = books.shape
    sums = coded.select("x", "codes").mapInArrow(_summed(parts, entries, width), "part int, entry int, n bigint, total array<bigint>")
    cells = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = books.copy()
    for r in cells.collect():  # parts * entries * width rows at most
        out[r["part"], r["entry"], r["at"]] = int(r["v"]) // r["n"]
    return out


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, x): kept rows with integer components; label as a string that tells null from every value."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)))
    fits = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))
    return kept.select(F.col(vec_id).alias("vec_id"), F.to_json(F.struct(F.col(label).alias("l"))).alias("label"), F.transform(vector, lambda x: F.floor(fits(x))).alias("x"))


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every kept row, and the codebooks by part, entry, position.

    ``label`` is a JSON object. At most 256 entries, so a code is a byte.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = integer_vectors(rows, vec_id, vector, label, scale)
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    usable = kept.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    seeds = usable.orderBy(*order).limit(entries).collect()
    dim = len(seeds[0]["x"]) if seeds else parts
    width = dim // parts
    limit = isqrt(((1 << 63) - 1) // (16 * width))
    fits = (F.size("x") == dim) & F.forall("x", lambda v: F.abs(v) <= limit)
    if any(len(r["x"]) != dim or max(map(abs, r["x"])) > limit for r in seeds):
        seeds = kept.where(fits).orderBy(*order).limit(entries).collect()
    books = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    schema = "vec_id " + kept.schema["vec_id"].dataType.simpleString() + ", label string, x array<int>, codes binary, error bigint"
    others = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if seeds:
        coded = kept.where(fits).select("vec_id", "label", F.col("x").cast("array<int>").alias("x"), F.lit(None).cast("binary").alias("codes"))
        for k in range(rounds):
            before, coded = coded, materialize(coded.mapInArrow(_assigned(books), schema), "vector-codes")
            books = _moved(coded, books)
            if k:
                discard(before)
        final = coded.mapInArrow(_assigned(books), schema).select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
        others = final.unionByName(others)
    done = materialize(others.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("label")}), "vector-errors")
    if seeds and rounds:
        discard(coded)
    labels = materialize(done.groupBy("h", "label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    return join_groups(done, labels, "h", ["label"], "n", F.col("row")).select("vec_id", "label", "code", "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """The hash of all components in order, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every kept vector."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
