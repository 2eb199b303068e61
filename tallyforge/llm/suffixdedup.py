"""Suffix-array dedup of long byte strings across a whole corpus.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else too is removed. One suffix array of a corpus does
not fit a machine, so strings are first dealt to places where all equal ones meet:

1. Each LENGTH-byte window picks the lowest hash among the ``GRAM``-byte strings in it (leftmost on ties). Equal windows
   pick equal grams at equal offsets, whatever is around them. Consecutive windows with the same pick are one record: the
   gram and at most LENGTH - GRAM bytes on either side.
2. Grams that are picked once in the corpus hold no repeated window. The others are marked in a bitmap of bounded size,
   which is built in pieces on the executors; a false mark costs work, never a result.
3. Records of marked grams are counted by content, so copies collapse before they move, and those of a gram meet. A
   gram with one distinct record has nothing to put in order: its windows are repeated if the record was counted twice.
   Otherwise both sides of each record are cut to the longest part that any other record of the gram shares, which drops
   what cannot hold a repeated window and decides nothing else.
4. All parts that are left, the gram itself being one symbol, are sorted as suffixes by Lyndon grouping (lyndon.py). Equal
   windows are neighbours there, and repeated if their parts stand for two records or more.
5. The repeated windows of a record go back to the places it came from, and each document unites them.

Grams are told apart by 64-bit hashes, the bytes around them are compared, and a record is known by its gram and a
64-bit hash of those bytes when its windows go back to their places. Every step is a scan or a shuffle of records;
text moves only where the lists of
spans are too many to broadcast (BROADCAST_DOCS). Results are those of comparing all windows with all.

Defined results: null text is empty and nothing of it is removed; texts shorter than LENGTH lose nothing; repeated rows lose
everything that is LENGTH bytes or longer, as the other row holds it too; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.lyndon import suffix_array
from tallyforge.plans.registry import table
from tallyforge.session import ensure_checkpoint_dir, materialize

LENGTH = 200
GRAM = 120
#: Records that a worker holds at once.
FLUSH = 40_000
#: Documents whose removed spans may be broadcast (a few dozen bytes each).
BROADCAST_DOCS = 400_000
#: Windows of a text that are worked on at once; positions in a piece fit 20 bits.
PIECE = (1 << 20) - 1024
#: Bits of the bitmap: the least power of two that gives 16 for each marked gram, between these bounds (32 MB at most).
BITS = (1 << 20, 1 << 28)
_CHUNK = 1 << 16
_U = np.uint64
_LOW = _U((1 << 20) - 1)


class Picker:
    """Grams and their windows of a text, by rolling hashes in numpy."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        rng = np.random.default_rng(20)
        self.length, self.gram = length, gram
        self.symbol = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        size = PIECE + length + 1
        with np.errstate(over="ignore"):
            self.power = np.concatenate(([_U(1)], np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)))
            self.unpower = np.concatenate(([_U(1)], np.cumprod(np.full(size, inverse, np.uint64), dtype=np.uint64)))

    def records(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece: its offset, and the arrays of grams' hashes, their places, and first and last window."""
        windows = len(raw) - self.length + 1
        for offset in range(0, max(windows, 0), PIECE):
            m = min(PIECE, windows - offset)
            yield (offset, *self._piece(raw[offset : offset + m + self.length - 1], m))

    def _piece(self, raw: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, w = self.gram, self.length - self.gram + 1
        n = m + w - 1
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbol[raw] * self.power[: len(raw)], dtype=np.uint64)))
            h = (sums[k : k + n] - sums[:n]) * self.unpower[:n]
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(29)
        keys = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
        low, wide = keys, 1  # the least key of each run of so many
        while 2 * wide <= w:
            low, wide = np.minimum(low[:-wide], low[wide:]), 2 * wide
        low = np.minimum(low[:m], low[w - wide : w - wide + m])
        pick = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
        last = np.concatenate((first[1:] - 1, [m - 1]))
        place = pick[first]
        return h[place].view(np.int64), place, first, last


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")


def marked_grams(docs: DataFrame, picker: Picker) -> np.ndarray:
    """The bitmap of grams that are picked twice or more, by the top bits of their hash."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r[1] for t in batch.column("text").to_pylist() for r in picker.records(_raw(t))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["gram"])

    twice = materialize(docs.select("text").mapInArrow(grams, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    bits = BITS[0]
    wanted = min(16 * twice.count(), BITS[1])
    while bits < wanted:
        bits *= 2
    shift = 64 - bits.bit_length() + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column("gram").to_numpy().view(np.uint64) >> _U(shift)).astype(np.int64)
            for chunk in np.unique(at // _CHUNK):
                own.setdefault(int(chunk), np.zeros(_CHUNK, bool))[at[at // _CHUNK == chunk] % _CHUNK] = True
        packed = [np.packbits(v).tobytes() for v in own.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "bits"])

    dealt = twice.repartition(F.shiftrightunsigned("gram", shift + 16))
    out = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(pieces, "chunk bigint, bits binary").toLocalIterator():  # bits / 8 bytes in all
        out[row["chunk"] * (_CHUNK // 8) : (row["chunk"] + 1) * (_CHUNK // 8)] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _records(docs: DataFrame, picker: Picker, bitmap: np.ndarray, places: bool) -> DataFrame:
    """The records of marked grams: (key, at, gram, ctx) of every place, or (gram, left, right, n), counted in pieces of FLUSH."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    shift = 64 - (len(bitmap) * 8).bit_length() + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[int], list[bytes], list[bytes]]]:
        """(key, places, grams, left sides, right sides) of each piece of a text."""
        marks = shared.value
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                raw = _raw(text.as_py())
                data, key = raw.tobytes(), key.as_py()
                for offset, gram, place, first, last in picker.records(raw):
                    bit = (gram.view(np.uint64) >> _U(shift)).astype(np.int64)
                    hit = np.flatnonzero(marks[bit >> 3] & (128 >> (bit & 7)))
                    place, at = place[hit] + offset, (first[hit] + offset).tolist()
                    left = [data[a:p] for a, p in zip(at, place.tolist())]
                    right = [data[p:b] for p, b in zip((place + picker.gram).tolist(), (last[hit] + (offset + picker.length)).tolist())]
                    yield key, at, gram[hit].tolist(), left, right

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: tuple[list[int], ...] = ([], [], [], [])

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(np.array(columns[3], np.uint64).view(np.int64))], names=["key", "at", "gram", "ctx"])
            for x in columns:
                x.clear()
            return made

        for key, at, grams, left, right in found(batches):
            for column, new in zip(columns, (repeat(key, len(at)), at, grams, map(_around, left, right))):
                column.extend(new)
            if len(columns[0]) >= FLUSH:
                yield handed()
        yield handed()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*r[2:]) for r in found(batches))
        while counts := Counter(islice(rows, FLUSH)):
            columns = [*zip(*counts), list(counts.values())]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["gram", "left", "right", "n"])

    source = docs.select("key", "text")
    if places:
        return source.mapInArrow(each, "key bigint, at bigint, gram bigint, ctx bigint")
    return source.mapInArrow(counted, "gram bigint, left binary, right binary, n bigint")


def _around(left: bytes, right: bytes) -> int:
    """An unsigned 64-bit hash of the bytes on either side of a gram."""
    return xxhash.xxh64_intdigest(left + b"|" + right, len(left))


def around(left: bytes, right: bytes) -> int:
    """The same hash, signed."""
    value = _around(left, right)
    return value - (1 << 64) if value >> 63 else value


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _cuts(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with any other one of the list."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    near = [_shared(sides[a], sides[b]) for a, b in zip(order, order[1:])]
    out = [0] * len(sides)
    for k, i in enumerate(order):
        out[i] = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
    return out


def repeated_windows(records: list[tuple[bytes, bytes, int]], length: int = LENGTH, gram: int = GRAM, tally: Counter | None = None) -> list[list[tuple[int, int]]]:
    """For each record (left, right, count) of one gram: runs (first, last) of the starts of its repeated windows.

    Starts are counted from the record's first byte. Records are distinct. One distinct record has no other to be put in order with:
    its windows are repeated if it has copies. Of several, the cuts leave what can be shared at all, and every part that
    is left is settled by the suffix array. ``tally`` counts records by the way they took.
    """
    need = length - gram + 1  # symbols of a window, the gram being one
    tally = Counter() if tally is None else tally
    if len(records) < 2:
        tally["alone"] += len(records)
        return [[(0, len(left) + len(right) + 1 - need)] if n > 1 else [] for left, right, n in records]
    backward, forward = _cuts([r[0][::-1] for r in records]), _cuts([r[1] for r in records])
    parts: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (left, right, n) in enumerate(records):
        cut = (left, right) if n > 1 else (left[len(left) - backward[i] :], right[: forward[i]])  # a copy shares all of its sides
        if len(cut[0]) + len(cut[1]) + 1 >= need:
            parts.setdefault(cut, []).append(i)
    weights = [sum(records[i][2] for i in rows) for rows in parts.values()]
    found = _by_suffixes(list(parts), weights, need)
    out: list[list[tuple[int, int]]] = [[] for _ in records]
    for (cut, rows), runs in zip(parts.items(), found):
        for i in rows:
            shift = len(records[i][0]) - len(cut[0])
            out[i] = [(a + shift, b + shift) for a, b in runs]
    tally["sorted"] += sum(map(len, parts.values()))
    tally["cut"] += len(records) - sum(map(len, parts.values()))
    return out


def _by_suffixes(parts: list[tuple[bytes, bytes]], weights: list[int], need: int) -> list[list[tuple[int, int]]]:
    """Runs of repeated starts of each part, from the suffix array of all parts with separators between them.

    Suffixes that begin with the same window are neighbours; the window is repeated if their parts stand for two records or more.
    """
    many = len(parts)
    text: list[int] = []
    owner: list[int] = []
    first: list[int] = []
    for k, (left, right) in enumerate(parts):  # separators are the lowest symbols, the gram is the highest
        first.append(len(text))
        text += [b + many for b in left]
        text.append(256 + many)
        text += [b + many for b in right]
        text.append(many - 1 - k)
        owner += [k] * (len(left) + len(right) + 2)
    ends = [min(f + len(left), f + len(left) + len(right) + 1 - need) for f, (left, right) in zip(first, parts)]
    starts: list[list[int]] = [[] for _ in parts]
    same: list[int] = []
    weight = 0
    window: list[int] = []

    def settle() -> None:
        if weight > 1:
            for at in same:
                starts[owner[at]].append(at - first[owner[at]])

    for at in suffix_array(text):
        k = owner[at]
        if at > ends[k]:
            continue
        if same and text[at : at + need] == window:
            same.append(at)
            weight += weights[k]
        else:
            settle()
            same, weight, window = [at], weights[k], text[at : at + need]
    settle()
    out: list[list[tuple[int, int]]] = []
    for own in starts:
        runs: list[tuple[int, int]] = []
        for s in sorted(own):
            if runs and runs[-1][1] == s - 1:
                runs[-1] = (runs[-1][0], s)
            else:
                runs.append((s, s))
        out.append(runs)
    return out


def may_repeat(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows of a batch, in order of grams, are more than the only record of their gram, counted once.

    The first and the last row may have others of their gram in the batches beside.
    """
    out = n > 1
    same = gram[1:] == gram[:-1]
    out[1:] |= same
    out[:-1] |= same
    out[:1] = out[-1:] = True
    return out


def _united(starts: list[int], length: int) -> list[int]:
    """The maximal spans of bytes (begin, end in turn) that runs of window starts (first, last in turn) cover."""
    out: list[int] = []
    for first, last in sorted(zip(starts[::2], starts[1::2])):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], last + length)
        else:
            out += [first, last + length]
    return out


def removal_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans): the spans of bytes that each keyed document loses, begin and end in turn."""
    picker = Picker(length, gram)
    bitmap = marked_grams(docs, picker)
    # counted by batch before the one shuffle; dealt by gram alone, so the sums and the sort need no other
    dealt = _records(docs, picker, bitmap, places=False).repartition("gram")
    met = dealt.groupBy("gram", "left", "right").agg(F.sum("n").alias("n")).sortWithinPartitions("gram")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            batch = batch.filter(pa.array(may_repeat(batch.column("gram").to_numpy(), batch.column("n").to_numpy())))
            yield from zip(*(batch.column(c).to_pylist() for c in ("gram", "left", "right", "n")))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["gram", "ctx", "runs"])
            for x in out:
                x.clear()
            return made

        for g, group in groupby(rows_of(batches), key=lambda r: r[0]):
            rows = list(group)
            for row, runs in zip(rows, repeated_windows([r[1:] for r in rows], length, gram)):
                if runs:
                    out[0].append(g)
                    out[1].append(around(row[1], row[2]))
                    out[2].append([x for run in runs for x in run])
            if len(out[0]) > 5000:
                yield flush()
        yield flush()

    found = materialize(met.mapInArrow(resolve, "gram bigint, ctx bigint, runs array<int>"), "repeated")
    places = _records(docs, picker, bitmap, places=True).join(found, ["gram", "ctx"])
    runs = places.groupBy("key").agg(F.flatten(F.collect_list(F.transform("runs", lambda x: x + F.col("at")))).alias("starts"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_united(starts, length) for starts in batch.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, pa.list_(pa.int64()))], names=["key", "spans"])

    return runs.mapInArrow(unite, "key bigint, spans array<bigint>")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, kept (bytes), n_bytes, n_removed, n_spans."""
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = _keyed(docs)
    spans = materialize(removal_spans(keyed, length, gram), "spans")
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_DOCS else spans.hint("shuffle_hash")
    joined = keyed.join(spans, "key", "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone, count = [], [], [], []
            for text, lost in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = _raw(text).tobytes()
                edges = [0, *(lost or []), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(rest)
                total.append(len(raw))
                gone.append(len(raw) - len(rest))
                count.append(len(lost or []) // 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, gone, count))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the digest of what is kept."""
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract's columns by a table of all windows; for tests."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        dead = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                dead[i : i + length] = b"\1" * length
        kept = bytes(b for b, d in zip(r, dead) if not d)
        spans = sum(1 for i, d in enumerate(dead) if d and (i == 0 or not dead[i - 1]))
        out.append((len(r), sum(dead), spans, hashlib.sha256(kept).hexdigest()))
    return out
