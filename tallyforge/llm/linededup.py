"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its words (runs without ASCII white space, lower-cased). A line is removed if an earlier line, in the order
of (doc_id, hash of the text, line number), has a Jaccard similarity of 4/5 or more with it; both are judged on the input. Lines without
a word stay.

1. Words are ordered by rarity: the corpus count of the word's slot in a table of 2^18 slots (on a logarithmic scale),
   then the word's hash. A word with more than one in 2^18 of the corpus stands out in its slot; only words rarer than
   that share slots with others of their kind. The table has a fixed size and reaches the tasks as a scalar subquery.
2. Equal lines are one class (128 bits of hash). Classes are numbered in the order of their first places, so a number is
   identity and order at once.
3. Two sets with similarity 4/5 share one of the n - need + 1 rarest words of each: these prefixes are joined. Pairs are
   cut by length, by the prefix that their two sizes ask for, by the position of the shared word, and inside the join by
   bit maps of all their words, which tell how many words at least the one set has that the other lacks.
4. Round one compares each class with the earliest class under each of its prefix words only, which settles groups of
   near copies with a few comparisons each. Round two compares what is still kept with all the others, in passes over
   shares of the prefix words: after the first pass each class is verified with the one whose map is nearest, and what
   that settles does not probe the other passes; after them it is done again, and only what that leaves is verified
   with the rest of its candidates.
5. Candidates are verified on the words themselves, read from their documents by their places.

Everything is built from SQL functions. A hot word is an ordinary skewed key of a shuffled join, which the engine splits; only
classes that round one has not settled probe it. Tables are dropped after their last reader. Small sides are broadcast
within ``BROADCAST_BYTES`` of counted bytes, else the same join shuffles.

Defined results: null text is one line without words; a null doc_id is ordered by the hash of its text; repeated documents
are later copies of the first one, and if they share its id too, one of these rows counts as the first and the others keep
their blank lines only; different texts under one id are different documents;
an empty table gives an empty table; extra columns pass through unless they are named ``_ld_*``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.skew import join_groups
from tallyforge.llm.textops import row_key
from tallyforge.plans.registry import table
from tallyforge.session import discard, ensure_checkpoint_dir, materialize

#: Slots of the rarity table, and how many of them make one row while it is put together.
SLOTS, CHUNK = 1 << 18, 1 << 9
#: The similarity as a fraction: 4/5.
NUM, DEN = 4, 5
#: What separates words: ASCII white space.
WORD_BREAK = r"[ \t\r\x0B\f]+"
BLANKS = " \t\r\x0b\f"
#: The 64-bit parts of the map of a line's words; what they cannot tell apart is left to the words themselves.
MAPS = ("map0", "map1", "map2", "map3")
#: Round two joins the prefix words in passes, each over its share of them in eighths: one pass's shuffles lie on disk at a
#: time, and what the first pass settles is not probed by the others.
PASSES = ((0, 1), (2, 3, 4), (5, 6, 7))
#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Bits of a packed size or position; larger ones are held as the largest, which passes every filter.
FIELD = 12
MOST = (1 << FIELD) - 1


def _plain(text: Column) -> Column:
    """The text in lower case, with one space for each run of blanks between words; only odd texts pay for more than the case."""
    low = F.lower(text)
    odd = F.contains(low, F.lit("  "))
    for blank in BLANKS[1:]:
        odd = odd | F.contains(low, F.lit(blank))
    return F.when(odd, F.regexp_replace(low, WORD_BREAK, " ")).otherwise(low)


def _words(line: Column) -> Column:
    """The words of a plain and trimmed line, repeats included."""
    return F.split(line, " ")


def rarity_table(docs: DataFrame) -> DataFrame:
    """One row, one array: for each slot three times the binary logarithm of how many words of the corpus fall into it."""
    plain = docs.select(_plain(F.col("text")).alias("text"))
    words = plain.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    ones = words.select(F.xxhash64("w").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"), F.lit(1).alias("n"))
    ones = ones.unionAll(docs.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(1).alias("n")))  # so that no slot is missing
    scale = F.least(F.floor(F.log2(F.sum("n")) * 3), F.lit(127)).cast("tinyint")
    slots = ones.groupBy("slot").agg(scale.alias("q"))
    in_order = lambda key: F.transform(F.sort_array(F.collect_list(F.struct(key, "q"))), lambda x: x["q"])
    chunks = slots.groupBy(F.floor(F.col("slot") / CHUNK).alias("chunk")).agg(in_order("slot").alias("q"))
    return materialize(chunks.agg(F.flatten(in_order("chunk")).alias("ranks")), "line-rarity")


def _sortable(number: Column, digits: int = 16) -> Column:
    """A number as bytes that order as it does; of 8 digits only for numbers that are not negative."""
    raised = number.bitwiseXOR(F.lit(-(1 << 63))) if digits == 16 else number.cast("bigint")
    return F.unhex(F.lpad(F.hex(raised), digits, "0"))


def row_place(docs: DataFrame) -> Column:
    """(doc_id, hash of the text) as 16 bytes: texts that share an id are different rows."""
    return F.concat(_sortable(row_key(docs["doc_id"], docs["text"])), _sortable(F.xxhash64(docs["text"])))


def _lines(docs: DataFrame) -> DataFrame:
    """(key, no, line, h1, h2) of every line with a word; line is plain and trimmed, h1 and h2 stand for it."""
    lines = docs.select(row_place(docs).alias("key"), _plain(F.col("text")).alias("text")).select("key", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.select("key", "no", F.trim("line").alias("line")).where("line <> ''")
    return lines.select("key", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _place() -> Column:
    """(key, no) as 20 bytes that order as they do."""
    return F.concat(F.col("key"), _sortable(F.col("no"), 8))


def line_classes(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(c, h1, h2, at, k, n, prefix, MAPS) of each distinct line.

    c numbers them by first place, k counts places, n counts words, prefix holds the hashes of its necessary rarest
    words, rarest first, with the rarity in the top byte, and MAPS are the 64-bit parts of a map with a bit for each of
    its words.
    """
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    lines = _lines(docs).select("h1", "h2", _place().alias("at"), hashes.alias("hs"), ranks.scalar().alias("ranks"))
    slot = lambda h: h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    key = lambda h: F.shiftleft(F.get("ranks", slot(h)).cast("bigint"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))
    sets = lines.select("h1", "h2", "at", F.sort_array(F.transform("hs", key)).alias("keys"))
    n = F.size("keys")
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(t, 20).bitwiseAND(F.lit(63)).cast("int"))
    own = lambda k: F.filter("keys", lambda t: t.bitwiseAND(F.lit(3 << 26)) == k << 26)
    maps = {name: F.aggregate(own(k), F.lit(0).cast("bigint"), lambda a, t: a.bitwiseOR(bit(t))) for k, name in enumerate(MAPS)}
    sets = sets.select("h1", "h2", "at", n.alias("n"), F.slice("keys", F.lit(1), _prefix_size(n)).alias("prefix"), *[m.alias(name) for name, m in maps.items()])
    classes = sets.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in ("n", "prefix", *MAPS)])
    ordered = classes.repartitionByRange("at").sortWithinPartitions("at")
    written = materialize(ordered.withColumn("m", F.monotonically_increasing_id()), "line-classes")
    part, at = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = written.groupBy(part.alias("part")).agg(F.max(at).alias("last")).orderBy("part").collect()  # one row a partition
    before, starts = 0, []
    for row in sizes:
        starts.append((row["part"], before))
        before += row["last"] + 1
    offsets = docs.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    out = written.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("c", F.col("start") + at).drop("part", "start", "m")
    out.scratch_path = written.scratch_path
    return out


def _rows(classes: DataFrame, name: str, *extra: str) -> DataFrame:
    """(tok, name, its extra columns): a row for each prefix word that occurs twice or more; the value packs c, n and the word's position."""
    rows = classes.select("c", "n", *extra, F.posexplode("prefix").alias("i", "tok"))
    n, i = F.least("n", F.lit(MOST)).cast("bigint"), F.least("i", F.lit(MOST)).cast("bigint")
    v = F.shiftleft("c", 2 * FIELD).bitwiseOR(F.shiftleft(n, FIELD)).bitwiseOR(i)
    single = 4  # three times the binary logarithm of a slot's own row, one word and another one
    token = F.col("tok").bitwiseAND(F.lit((1 << 40) - 1))  # enough to find pairs, and shorter on the way
    return rows.where(F.shiftright("tok", 56) >= single).select(token.alias("tok"), v.alias(name), *[F.col(b).alias(f"{name}_{b}") for b in extra])


def _prefix_size(n: Column) -> Column:
    return (n - F.ceil(n * NUM / DEN) + 1).cast("int")


def _need(both: Column) -> Column:
    """The overlap that two sets of this many words in all need."""
    return F.ceil(both * NUM / (NUM + DEN))


def _class_of(v: Column) -> Column:
    return F.shiftright(v, 2 * FIELD)


def _size(v: Column) -> Column:
    return F.shiftright(v, FIELD).bitwiseAND(F.lit(MOST))


def _filters(x: Column, y: Column) -> Column:
    """What the packed rows of a shared word let pass: length, prefix of the two sizes, and position."""
    (nx, ix), (ny, iy) = ((_size(v), v.bitwiseAND(F.lit(MOST))) for v in (x, y))
    need = _need(nx + ny)
    length = (F.least(nx, ny) * DEN) >= (F.greatest(nx, ny) * NUM)
    prefix = (ix <= nx - need) & (iy <= ny - need)
    position = 1 + F.least(nx - ix - 1, ny - iy - 1) + F.least(ix, iy) >= need
    return (length & prefix & position) | (F.greatest(nx, ny) == MOST)


def _apart(x: str, y: str) -> Column:
    """How many words of set x, at least, are not in set y: those whose bit y's map lacks."""
    return sum(F.bit_count(F.col(f"{x}_{b}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{b}")))) for b in MAPS)


def _maps(nx: Column, ny: Column) -> Column:
    """Whether the maps of the sets x and y, of so many words, allow the overlap that they need."""
    need = _need(nx + ny)
    return ((_apart("x", "y") <= nx - need) & (_apart("y", "x") <= ny - need)) | (F.greatest(nx, ny) >= MOST)


def later_matches(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c): classes whose first place has an earlier similar line."""
    x, y = _rows(classes, "x"), _rows(classes, "y")
    leads = x.select("tok", "x").join(y.groupBy("tok").agg(F.min("y").alias("y")), "tok")
    first = leads.where((_class_of(F.col("x")) != _class_of(F.col("y"))) & _filters(F.col("x"), F.col("y")))
    met = materialize(first.select(_class_of(F.col("x")).alias("x"), _class_of(F.col("y")).alias("y")).distinct(), "line-met")
    likely = _likely(classes, met)
    settled = _similar(docs, classes, likely)
    discard(met, likely)
    first = _met(classes, settled, PASSES[0])
    more = _similar(docs, classes, _nearest(first))
    settled_two = materialize(settled.unionAll(more), "line-settled")
    discard(settled, more)
    met = [_without(first, settled_two), *[_met(classes, settled_two, share) for share in PASSES[1:]]]
    discard(first)
    pairs = materialize(reduce(DataFrame.unionAll, met).groupBy("x", "y").agg(F.max("slack").alias("slack")), "line-met")
    discard(*met)
    more = _similar(docs, classes, _nearest(pairs))
    left = _without(pairs, more)
    rest = _similar(docs, classes, left)
    out = materialize(settled_two.unionAll(more).unionAll(rest), "line-later")
    discard(settled_two, pairs, more, left, rest)
    return out


def _met(classes: DataFrame, settled: DataFrame, share: tuple[int, ...]) -> DataFrame:
    """(x, y, slack): classes that are not settled, with the earlier ones that meet them in these eighths of the words and pass all filters.

    slack is nine times the number of words by which the sets might differ more and still be similar, as far as maps tell.
    """
    mine = lambda rows: rows.where((F.col("tok") % 8).isin(*share))
    x, y = mine(_rows(classes.join(_bounded(settled, 8), "c", "left_anti"), "x", *MAPS)), mine(_rows(classes, "y", *MAPS))
    nx, ny = _size(F.col("x")), _size(F.col("y"))
    earlier = F.col("y") < F.shiftleft(_class_of(F.col("x")), 2 * FIELD)
    pairs = x.join(y, "tok").where(earlier & _filters(F.col("x"), F.col("y")) & _maps(nx, ny))
    slack = nx + ny - (_apart("x", "y") + _apart("y", "x")) * (NUM + DEN)
    pairs = pairs.select(_class_of(F.col("x")).alias("x"), _class_of(F.col("y")).alias("y"), slack.alias("slack"))
    return materialize(pairs.groupBy("x", "y").agg(F.max("slack").alias("slack")), "line-pass")


def _nearest(met: DataFrame) -> DataFrame:
    """(x, y): each x with the y that its map is nearest to."""
    nearest = F.max(F.struct("slack", (-F.col("y")).alias("y")))
    return met.groupBy("x").agg((-nearest["y"]).alias("y"))


def _without(met: DataFrame, settled: DataFrame) -> DataFrame:
    """met without the x that are settled."""
    return materialize(met.join(_bounded(settled.select(F.col("c").alias("x")), 8), "x", "left_anti"), "line-left")


def _bounded(df: DataFrame, width: int) -> DataFrame:
    """df, to be broadcast if its rows of so many bytes fit the bound."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _ids(pairs: DataFrame) -> DataFrame:
    """(c): the classes of pairs (x, y)."""
    return pairs.select(F.col("x").alias("c")).unionAll(pairs.select(F.col("y").alias("c"))).distinct()


def _likely(classes: DataFrame, met: DataFrame) -> DataFrame:
    """(x, y): the pairs whose maps allow the overlap they need."""
    known = classes.select("c", "n", *MAPS).join(_bounded(_ids(met), 8), "c", "left_semi")
    side = lambda p: known.select(F.col("c").alias(p), F.col("n").alias(f"n{p}"), *[F.col(b).alias(f"{p}_{b}") for b in MAPS])
    both = met.join(side("x"), "x").join(side("y"), "y")
    return materialize(both.where(_maps(F.col("nx"), F.col("ny"))).select("x", "y"), "line-pairs")


def _word_lines(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c, line): the first line of each class of the pairs, taken from its document by its place."""
    wanted = classes.join(_bounded(_ids(pairs), 8), "c", "left_semi")
    no = F.conv(F.hex(F.substring("at", 17, 4)), 16, 10).cast("int")
    wanted = materialize(wanted.select(F.substring("at", 1, 16).alias("key"), no.alias("no"), "c"), "line-wanted")
    texts = docs.select(row_place(docs).alias("key"), "text").join(_bounded(wanted, 48), "key")
    sets = materialize(texts.select("c", F.trim(_plain(F.get(F.split("text", "\n"), F.col("no")))).alias("line")), "line-sets")
    discard(wanted)
    return sets


def _similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c): the x of each pair (x, y), x later than y, whose sets of words are similar enough."""
    lines = _word_lines(docs, classes, pairs)
    word_set = lambda p: lines.select(F.col("c").alias(p), F.array_distinct(_words(F.col("line"))).alias(f"w{p}"))
    joined = pairs.select("x", "y").join(word_set("x"), "x").join(word_set("y"), "y")
    common = F.size(F.array_intersect("wx", "wy"))
    similar = common * DEN >= (F.size("wx") + F.size("wy") - common) * NUM
    out = materialize(joined.where(similar).select(F.col("x").alias("c")).distinct(), "line-settled")
    discard(lines)
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """(key, gone): the numbers of the lines that each document loses, counted from 0."""
    ensure_checkpoint_dir(docs.sparkSession)
    ranks = rarity_table(docs)
    classes = line_classes(docs, ranks)
    later = later_matches(docs, classes)
    hit = classes.join(_bounded(later, 8).withColumn("hit", F.lit(True)), "c", "left").where((F.col("k") > 1) | F.col("hit"))
    touched = materialize(hit.select("h1", "h2", F.col("at").alias("first"), F.coalesce("hit", F.lit(False)).alias("hit")), "line-touched")
    placed = _lines(docs).select("h1", F.col("h2").alias("own"), "key", "no", _place().alias("at"))
    gone = placed.join(_bounded(touched, 64), "h1").where((F.col("own") == F.col("h2")) & (F.col("hit") | (F.col("at") != F.col("first"))))
    out = materialize(gone.select("key", "no").distinct().groupBy("key").agg(F.sort_array(F.collect_list("no")).alias("gone")), "lines-gone")
    discard(ranks, classes, later, touched)
    return out


def _marked(keyed: DataFrame) -> DataFrame:
    """keyed with _ld_again: whether the row equals an earlier one in id and text. Only such rows are written aside and numbered."""
    repeats = materialize(keyed.groupBy("_ld_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_ld_key"), "line-repeats")
    if repeats.isEmpty():
        return keyed.withColumn("_ld_again", F.lit(False))
    few = _bounded(repeats, 16)
    several = keyed.join(few, "_ld_key", "left_semi").withColumns({"_ld_mid": F.monotonically_increasing_id(), "_ld_h": F.xxhash64("_ld_key")})
    several = materialize(several, "line-repeated")
    first = materialize(several.groupBy("_ld_h", "_ld_key").agg(F.min("_ld_mid").alias("_ld_first"), F.count(F.lit(1)).alias("_ld_n")), "line-firsts")
    told = join_groups(several, first, "_ld_h", ["_ld_key"], "_ld_n", F.col("_ld_mid"), "inner").withColumn("_ld_again", F.col("_ld_mid") != F.col("_ld_first"))
    single = keyed.join(few, "_ld_key", "left_anti").withColumn("_ld_again", F.lit(False))
    return single.unionByName(told.select(*single.columns))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the later lines taken out of text, and _ld_lines and _ld_gone (counts of lines)."""
    gone = removed_lines(docs)
    width = gone.agg(F.coalesce(F.sum(F.size("gone") * 4 + 48), F.lit(0))).first()[0]
    if width <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    keyed = _marked(docs.withColumn("_ld_key", row_place(docs)))
    joined = keyed.join(gone.select(F.col("key").alias("_ld_key"), F.col("gone").alias("_ld_list")), "_ld_key", "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_ld_list", i)), "\n")
    blank = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(_plain(x)) == "")
    marks = F.when(F.col("_ld_again") & F.col("text").isNotNull(), F.array_join(blank, "\n")).when(F.col("_ld_list").isNull(), F.col("text")).otherwise(kept)
    count = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint")
    gone = F.when(F.col("_ld_again"), count - F.size(blank)).otherwise(F.coalesce(F.size("_ld_list"), F.lit(0)))
    out = joined.withColumns({"_ld_lines": count, "_ld_gone": gone.cast("bigint")})
    return out.withColumn("text", marks).select(*docs.columns, "_ld_lines", "_ld_gone")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document loses, and the digest of what it keeps."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
tk AS (SELECT doc_id, no, line, list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\r\x0B\f]+'), lambda x: x <> '')) AS ws FROM ln),
cls AS (SELECT row_number() OVER (ORDER BY doc_id, no) AS c, * FROM (SELECT *, row_number() OVER (PARTITION BY trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) ORDER BY doc_id, no) AS k FROM tk WHERE len(ws) > 0) WHERE k = 1),
tok AS (SELECT c, len(ws) AS n, unnest(ws) AS w FROM cls),
df AS (SELECT w, count(*) AS df FROM tok GROUP BY w),
ord AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS i FROM tok JOIN df USING (w)),
pre AS (SELECT * FROM ord WHERE i <= n - ceil(n * 0.8) + 1),
pairs AS (SELECT DISTINCT a.c AS x, b.c AS y FROM pre a JOIN pre b ON a.w = b.w AND b.c < a.c AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
sim AS (SELECT DISTINCT x FROM (SELECT x, len(list_intersect(a.ws, b.ws)) AS o, len(a.ws) + len(b.ws) AS s FROM pairs JOIN cls a ON a.c = x JOIN cls b ON b.c = y) WHERE 5 * o >= 4 * (s - o)),
gone AS (SELECT tk.doc_id, tk.no FROM tk JOIN cls ON trim(tk.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) = trim(cls.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) WHERE len(tk.ws) > 0 AND (cls.c IN (SELECT x FROM sim) OR tk.doc_id <> cls.doc_id OR tk.no <> cls.no))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(gone.no)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE gone.no IS NULL), '')) AS kept_sha256
FROM ln LEFT JOIN gone USING (doc_id, no) GROUP BY doc_id
"""
