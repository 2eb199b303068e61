"""Alignment of two tokenizers' tokens by segment deduplication.

With a space in front, a text is cut before every run of white space that starts with a space and follows another character. A
cut is taken only where neither tokenizer can put a token across it, which is verified on the vocabularies: no entry
of either holds a space after a character that is not white space, A splits before white space by its pattern, and B merges
nothing but entries. A segment's tokens are then the same alone and in its text. If an entry does cross, texts are not cut.

1. Segments are counted, task by task and then over all tasks, so each distinct one is a row.
2. Each is tokenised by both and aligned once: groups of tokens between byte offsets where tokens of both end.
3. The ``HEAD`` most frequent short segments (bounded in number and bytes) are shipped to the tasks. The others of a text are
   looked up by a join on the segment, whose hot keys are dealt to many tasks, and come back as one list for the text.
4. Texts are composed from their segments' alignments; the links of a text are kept as distinct id pairs with their numbers.
5. Pairs are counted over the texts, and each text sums up the counts of its links: the ``HEAD_PAIRS`` most frequent pairs are
   shipped, the others joined.

Rows find their lists by 96 bits of two hashes of id and text, so repeated rows share one list and no number given to a row
has to survive a second reading. Tokenizer files are read on the driver and shipped.

Defined results: null and empty texts, and texts that a tokenizer does not give back (they hold U+2581), have no tokens, zeros
and empty groups; special tokens' strings are plain text; repeated rows count as documents of their own and null ids are
kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.skew import hot_keys, join_groups
from tallyforge.plans.registry import table
from tallyforge.session import discard, materialize

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Segments that are shipped, and bytes of each at most.
HEAD, HEAD_BYTES = 1 << 18, 48
#: Id pairs that are shipped, at 17 bytes each.
HEAD_PAIRS = 1 << 20
#: Distinct segments that a task counts before it hands them on, and documents that are composed at once.
FLUSH, SLICE = 400_000, 512
MARK = "▁"
#: A space after a character that is not white space; the space stands first, as literal starts are searched for without matching.
_CUT = re.compile(r" (?<=\S )")
_MASK = (1 << 32) - 1
#: Writes the marks between ids as spaces.
_BLANK = bytes.maketrans(b",|;\n", b"    ")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow 255 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenizerPair:
    """Both tokenizers with their entries' bytes."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        vocabulary = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = {i: bytes(letters[c] for c in entry) for entry, i in vocabulary.items() if all(c in letters for c in entry)}
        self.b_bytes = {i: self._piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_control(i)}
        self.a_len, self.b_len = ({i: len(e) for i, e in x.items()} for x in (self.a_bytes, self.b_bytes))
        self.b_space = self.b.piece_to_id(MARK)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def cuts(self) -> bool:
        """Whether texts may be cut: no entry crosses a cut, A is split by its pattern alone and B marks spaces."""
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        return bool(plain) and self.b_space != self.b.unk_id() and not any(_CUT.search(e.decode("utf-8", "replace")) for x in (self.a_bytes, self.b_bytes) for e in x.values())

    def aligned(self, pieces: list[str]) -> list[str | None]:
        """Each segment's groups, ``a1,a2|b1;a3|b2``; None where a tokenizer does not give the segment back. A piece stands for a space and itself."""
        out: list[str | None] = []
        for piece, encoded, b in zip(pieces, self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False), self.b.encode(pieces, num_threads=1)):
            a, b, whole = encoded.ids, b if piece else [self.b_space], (" " + piece).encode("utf-8", "surrogatepass")
            same = b"".join([self.a_bytes.get(i, b"") for i in a]) == whole == b"".join([self.b_bytes.get(i, b"") for i in b])
            out.append(self.groups(a, b) if same else None)
        return out

    def groups(self, a: list[int], b: list[int]) -> str:
        out, i, j, i0, j0 = [], 0, 0, 0, 0
        at_a, at_b = self.a_len[a[0]], self.b_len[b[0]]
        while True:
            if at_a == at_b:
                i, j = i + 1, j + 1
                out.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
                if i == len(a):
                    return ";".join(out)
                i0, j0 = i, j
                at_a, at_b = at_a + self.a_len[a[i]], at_b + self.b_len[b[j]]
            elif at_a < at_b:
                i += 1
                at_a += self.a_len[a[i]]
            else:
                j += 1
                at_b += self.b_len[b[j]]


class Lengths:
    """The byte lengths of both vocabularies' tokens by id: all that links need."""

    def __init__(self, a_len: dict[int, int], b_len: dict[int, int]) -> None:
        self.a_len, self.b_len = ([x.get(i, 0) for i in range(max(x, default=-1) + 1)] for x in (a_len, b_len))
        self.a_bits, self.b_bits = (max(len(x) - 1, 0).bit_length() for x in (self.a_len, self.b_len))

    def entry(self, groups: str) -> tuple[int, int, int, list[int]]:
        """(n_a, n_b, n_groups, links): a link is an A token and a B token that share bytes, a * 2^b_bits + b."""
        n_a = n_b = 0
        links: list[int] = []
        parts, bits = groups.split(";"), self.b_bits
        for part in parts:
            left, _, right = part.partition("|")
            if "," not in left and "," not in right:
                n_a, n_b = n_a + 1, n_b + 1
                links.append(int(left) << bits | int(right))
                continue
            a, b = [*map(int, left.split(","))], [*map(int, right.split(","))]
            n_a, n_b = n_a + len(a), n_b + len(b)
            i, j, at_a, at_b = 0, 0, self.a_len[a[0]], self.b_len[b[0]]
            links.append(a[0] << bits | b[0])
            while at_a != at_b:
                if at_a < at_b:
                    i += 1
                    at_a += self.a_len[a[i]]
                else:
                    j += 1
                    at_b += self.b_len[b[j]]
                links.append(a[i] << bits | b[j])
        return n_a, n_b, len(parts), links


def _entries(lengths: Lengths, groups: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups of each segment, its number of links, all links in order), as ``Lengths.entry`` gives them.

    Both sides' tokens cover the same bytes, so between two neighbouring ends of tokens of either side lies one link.
    """
    if not groups:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = ("\n".join(groups) + "\n").encode()
    ids = np.fromstring(raw.translate(_BLANK), np.int64, sep=" ")
    marks = np.frombuffer(raw, np.uint8)
    marks = marks[(marks < 48) | (marks > 57)]  # the mark behind each id
    turns = np.cumsum(marks != 44)  # sides take turns at every mark but a comma
    right = np.concatenate([[0], turns[:-1]]) & 1 == 1
    a, b, last = ids[~right], ids[right], np.flatnonzero(marks == 10)
    size_a, size_b = np.array(lengths.a_len, np.int64)[a], np.array(lengths.b_len, np.int64)[b]
    of_a, of_b, of_groups = (np.diff(np.cumsum(x)[last], prepend=0) for x in (~right, right, marks == 124))
    numbers = np.stack([of_a, of_b, of_groups], axis=1)
    if not (size_a.all() and size_b.all()):  # a token of no bytes has no end of its own
        each = [lengths.entry(g)[3] for g in groups]
        return numbers, np.fromiter(map(len, each), np.int64, len(each)), np.array([x for own in each for x in own], np.int64)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    links = a[np.searchsorted(end_a, ends)] << lengths.b_bits | b[np.searchsorted(end_b, ends)]
    return numbers, np.diff(np.searchsorted(ends, end_b[np.cumsum(of_b) - 1], "right"), prepend=0), links


class Entries:
    """Numbers and links of segments by index; a segment that a tokenizer does not give back has none."""

    def __init__(self, lengths: Lengths, groups: list[str | None]) -> None:
        given = np.fromiter((g is not None for g in groups), bool, len(groups))
        found = _entries(lengths, [g for g in groups if g is not None])
        self.numbers, self.sizes = np.zeros((len(groups), 3), np.int64), np.zeros(len(groups), np.int64)
        self.numbers[given], self.sizes[given], self.links = found

    def joined(self, other: "Entries") -> "Entries":
        out = object.__new__(Entries)
        for name in ("numbers", "sizes", "links"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        return out

    def expanded(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the segments ``at``, and for each the position in ``at`` that it belongs to."""
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        before = np.cumsum(sizes) - sizes
        return self.links[np.repeat(starts - before, sizes) + np.arange(sizes.sum())], np.repeat(np.arange(len(at)), sizes)


def summed(keys: np.ndarray, times: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (of so many bits) in order, and the sums of their times."""
    free = 63 - bits
    if len(times) and free > 0 and not int(times.max()) >> free:
        both = np.sort(keys << free | times)  # one sort of plain numbers
        keys, times = both >> free, both & ((1 << free) - 1)
    else:
        by = np.argsort(keys, kind="stable")
        keys, times = keys[by], times[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


@lru_cache(maxsize=1)
def _pair(a_json: str, b_model: bytes) -> TokenizerPair:
    return TokenizerPair(a_json, b_model)


_HEADS: dict[str, tuple] = {}


def _head(shipped) -> tuple[dict[str, int], list[str | None], Entries]:  # noqa: ANN001
    """The shipped segments' indexes, groups and entries, made once in each worker."""
    key = shipped.value["key"]
    if key not in _HEADS:
        _HEADS.clear()
        _pair.cache_clear()  # a worker that composes texts needs no tokenizers
        found = pa.ipc.open_stream(shipped.value["head"]).read_all()
        groups = found["groups"].to_pylist()
        _HEADS[key] = {s: i for i, s in enumerate(found["seg"].to_pylist())}, groups, Entries(shipped.value["lengths"], groups)
    return _HEADS[key]


def segments(text: str, cut: bool) -> list[str]:
    """The segments of a text, each without the space that it starts with."""
    return _CUT.split(text) if cut else [text]


def _counted(cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def handed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["seg", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(segments(text.as_py(), cut))
                if len(seen) > FLUSH:
                    yield handed(seen)
                    seen.clear()
        yield handed(seen)

    return work


def _align(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shipped.value["a"], shipped.value["b"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair.aligned(batch.column("seg").to_pylist()), pa.string())], names=["seg", "n", "groups"])

    return work


def _rare(shipped, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(k1, k2, pos, seg): a text's distinct segments that are not shipped, in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _head(shipped)[0]
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                rare = [[s for s in dict.fromkeys(segments(t.as_py(), cut)) if s not in head] for t in batch.column("text")]
                n = np.fromiter(map(len, rare), np.int64, len(rare))
                keys = [pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in ("k1", "k2")]
                pos = pa.array([p for own in rare for p in range(len(own))], pa.int32())
                yield pa.RecordBatch.from_arrays([*keys, pos, pa.array([s for own in rare for s in own], pa.string())], names=["k1", "k2", "pos", "seg"])

    return work


def _composed(shipped, cut: bool, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """From (doc_id, text, found): a row of ``COMPOSED`` for each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shipped.value["lengths"]
        index, known, entries = _head(shipped)
        bits = lengths.a_bits + lengths.b_bits
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                ids: list[int] = []
                times: list[int] = []
                sizes, groups, rare = [], [], []  # distinct segments and groups of each text, groups of segments that are not shipped
                for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                    sizes.append(0)
                    groups.append("")
                    if not text:
                        continue
                    pieces = segments(text, cut)
                    counts = Counter(pieces)
                    own = [index.get(s, -1) for s in counts]
                    looked = iter(found or ())
                    part_of = {s: known[i] if i >= 0 else next(looked) for s, i in zip(counts, own)}
                    parts = [*map(part_of.__getitem__, pieces)]
                    if found:
                        new = iter(range(len(index) + len(rare), len(index) + len(rare) + len(found)))
                        own = [i if i >= 0 else next(new) for i in own]
                    if None in parts:
                        continue
                    rare += found or ()
                    ids += own
                    times += counts.values()
                    sizes[-1] = len(own)
                    joined = ";".join(parts)
                    groups[-1] = hashlib.sha256(joined.encode()).hexdigest() if digest else joined
                n, at, k = len(sizes), np.array(ids, np.int64), np.array(times, np.int64)
                row, all_entries = np.repeat(np.arange(n), sizes), entries.joined(Entries(lengths, rare))
                total = lambda v: pa.array(np.bincount(row, weights=v * k, minlength=n).astype(np.int64))
                numbers = [total(all_entries.numbers[at, c]) for c in range(3)] + [total(all_entries.sizes[at])]
                links, of = all_entries.expanded(at)
                keys, k = summed(row[of] << bits | links, k[of], bits + SLICE.bit_length())
                offsets = pa.array(np.searchsorted(keys >> bits, np.arange(n + 1)).astype(np.int32))
                lists = [keys >> lengths.b_bits & ((1 << lengths.a_bits) - 1), keys & ((1 << lengths.b_bits) - 1), k]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(groups, pa.string()), *[pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in lists]], names=NAMES)

    return work


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b", "k"]
COMPOSED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, a array<int>, b array<int>, k array<int>"


def _packed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of a batch, their numbers, and the first link of every row and of the end."""
    a, b, k = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "abk")
    sizes = np.asarray(batch.column("a").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return a << 32 | b, k, np.concatenate([[0], np.cumsum(sizes)])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique(_packed(batch)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["link", "n"])


def _scored(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Adds the sums over shipped pairs, and lists the links that are not shipped with their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = (np.frombuffer(shipped.value[x], t) for x, t in (("link", np.int64), ("count", np.int64), ("best", np.bool_)))
        for batch in batches:
            links, k, first = _packed(batch)
            at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
            hit = known[at] == links if len(known) else np.zeros(len(links), bool)
            summed = lambda v: pa.array(np.diff(np.concatenate([[0], np.cumsum(v)])[first]), pa.int64())
            n = [k * hit * best[at], k * hit * counts[at]] if len(known) else [k * 0, k * 0]
            gone = ~hit
            rest = pa.array(np.concatenate([[0], np.cumsum(gone)])[first].astype(np.int32))
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[gone], pa.int64())) for x in (links, k)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", *NAMES[:6])], *map(summed, n), *lists], names=["rid", *NAMES[:6], "n_best", "count_sum", "links", "times"])

    return work


def most_frequent(rows: DataFrame, count: str, most: int) -> tuple[DataFrame, bool]:
    """Rows whose count reaches a bound that at most ``most`` rows reach, and whether those are all.

    The bound comes from a histogram over eighths of powers of two, so nothing is sorted.
    """
    step = F.floor(F.log2(count) * 8)
    left, bound, every = most, None, True
    for r in sorted(rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] > left:
            every = False
            break
        left, bound = left - r["n"], r["step"]
    return rows.where(step >= bound if bound is not None else F.lit(False)), every


def align_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row.

    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3`` by ids in order; with ``digest`` its SHA-256 in hex, so that long
    alignments need not be written between the steps.
    """
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        files = {"a": a.read(), "b": b.read()}
    pair, ship = TokenizerPair(files["a"], files["b"]), spark.sparkContext.broadcast
    cut = pair.cuts()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})
    full = rows.where("text <> ''")

    counts = full.select("text").mapInArrow(_counted(cut), "seg string, n bigint").groupBy("seg").agg(F.sum("n").alias("n"))
    aligned = materialize(counts.mapInArrow(_align(ship(files)), "seg string, n bigint, groups string"), "segments")
    head = most_frequent(aligned.where(F.octet_length("seg") <= HEAD_BYTES), "n", HEAD)[0].select("seg", "groups").toArrow()
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, head.schema) as writer:
        writer.write_table(head)
    shipped = ship({"head": stream.getvalue().to_pybytes(), "key": uuid.uuid4().hex, "lengths": Lengths(pair.a_len, pair.b_len)})

    rare = full.select("k1", "k2", "text").mapInArrow(_rare(shipped, cut), "k1 bigint, k2 int, pos int, seg string").withColumn("h", F.xxhash64("seg"))
    others = aligned.withColumn("h", F.xxhash64("seg"))
    hot = hot_keys(others, "h", "n")
    looked = join_groups(rare, others, "h", ["seg"], "n", F.col("k1"), "inner") if hot else rare.drop("h").join(aligned, "seg")
    looked = looked.select("k1", "k2", F.struct("pos", "groups").alias("one"))
    lists = looked.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("one")).alias("found"))
    lists = materialize(lists.select("k1", "k2", F.col("found.groups").alias("found")), "rare-segments")
    discard(aligned)

    joined = rows.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "found")
    kind = rows.schema["doc_id"].dataType.simpleString()
    composed = joined.mapInArrow(_composed(shipped, cut, digest), f"doc_id {kind}, {COMPOSED}").withColumn("rid", F.monotonically_increasing_id())
    composed = materialize(composed, "composed")
    discard(lists)

    pairs = composed.select("a", "b", "k").mapInArrow(_pair_counts, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("count"))
    pairs = materialize(pairs.withColumn("id", F.shiftright("link", 32)), "pair-counts")
    tops = pairs.groupBy("id").agg(F.max("count").alias("top"))
    pairs = pairs.join(tops, "id").select("link", "count", (F.col("count") == F.col("top")).alias("best"))
    frequent, every = most_frequent(pairs, "count", HEAD_PAIRS)
    known = frequent.toArrow().sort_by("link")
    sent = {c: known[c].to_numpy().astype(t).tobytes() for c, t in (("link", np.int64), ("count", np.int64), ("best", np.bool_))}
    scored = composed.mapInArrow(_scored(ship(sent)), f"rid bigint, doc_id {kind}, {COMPOSED[: COMPOSED.index(', a array')]}, n_best bigint, count_sum bigint, links array<bigint>, times array<bigint>")
    if not every:
        rest = scored.select("rid", F.explode(F.arrays_zip("links", "times")).alias("x")).select("rid", F.col("x.links").alias("link"), F.col("x.times").alias("times"))
        more = rest.join(pairs, "link").groupBy("rid").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
        scored = scored.join(more, "rid", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select(*NAMES[:6], "n_best", "count_sum")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of both vocabularies for every document."""
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).withColumnRenamed("groups", "groups_sha256")
