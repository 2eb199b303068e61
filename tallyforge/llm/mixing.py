"""Mixing sources to target weights by Pfair scheduling of blocks.

Every source is cut into blocks of ``block_docs`` documents (in the order of the md5 of their ids) and has a target weight. In
the ideal mix all sources flow at once, each at its weight's share of those that are not at their end yet: after v units of flow a source of
weight a and b blocks has given min(a v, b), and T(v) is the sum over all sources. Block j of a source flows from T(j / a)
to T((j + 1) / a); rounded down and up to slots these are its release time and deadline. Earliest deadline first among released blocks
puts every block into its window, as the ideal mix fills every slot exactly, so at every slot each source is less than one
block away from its target. Nothing is rounded but the window's ends: weights are whole numbers (parts of 2^-30 of a root) and times
exact fractions.

The schedule is cut into stretches of ``STRETCH`` slots. A stretch needs to know which released blocks the one before it has
left over. All stretches are run at once from a guess, the blocks in flow at its start but for those with the earliest deadlines; then each takes what
the one before really left, and those whose guess was wrong are run again until none changes. The first stretch is right from the start and
each pass makes one more right at least, so the end is the schedule of one run through all slots, whatever was guessed.

Documents find their block by a distributed rank: rows are counted per (source, bucket of the md5), the counts
are summed up per source, and rows are numbered inside a bucket, so a source with a third of all rows is spread over
``BUCKETS`` groups. No text moves unless the caller asks for other columns.

Defined results: a null source is a source named "" ; a null doc_id is ordered by the hash of its text; rows with
equal ids are ordered by the text's hash; an empty table gives an empty table; clashing extra columns are kept as
long as they are not named ``mix_*``. A stretch holds at most one waiting block of each source beside its own, so its task's memory and time
follow the number of sources; it is meant for up to some ten thousand of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.textops import shuffle_width
from tallyforge.operators.prefix import running
from tallyforge.plans.registry import table
from tallyforge.session import ensure_checkpoint_dir

BLOCK_DOCS = 8
#: Parts of a root that a weight counts: roots of sizes are taken as whole numbers of them.
PARTS = 1 << 30
#: Slots that are scheduled in one row.
STRETCH = 512
#: md5 prefixes by which a source's rows are dealt: three hex digits.
PREFIX = 3
BUCKETS = 16**PREFIX
#: Rows of the schedule that may be broadcast (40 bytes each).
BROADCAST_SLOTS = 500_000


def shares(counts: DataFrame, weights: dict[str, int] | None = None, temperature: float = 0.5) -> DataFrame:
    """(src, n, a): the target weights, whole numbers of which only the proportions count.

    With ``weights`` they are those, 1 for sources not named. Otherwise a source of n rows has n**temperature, in ``PARTS``.
    """
    if weights is not None:
        if any(w < 1 for w in weights.values()):
            raise ValueError("weights are positive integers")
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,int>")
        return counts.select("src", "n", F.coalesce(F.try_element_at(named, F.col("src")), F.lit(1)).cast("bigint").alias("a"))
    return counts.select("src", "n", F.greatest(F.round(F.pow("n", F.lit(temperature)) * PARTS), F.lit(1)).cast("bigint").alias("a"))


def windows(parts: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """From (src, n, a): (src, block, release, deadline) of every block, in slots."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    blocks = parts.select("src", "a", F.ceil(F.col("n") / block_docs).cast("bigint").alias("b")).withColumn("v", F.col("b") / F.col("a"))
    total = parts.agg(F.sum(whole("a"))).first()[0] or 0
    ends = running(running(blocks.withColumn("wide", whole("a")), ["v", "src"], "b", "given", "sum", inclusive=True), ["v", "src"], "wide", "gone", "sum", inclusive=True)
    phases = ends.select("v", F.struct(F.col("given").alias("given"), (F.lit(total).cast("decimal(38,0)") - F.col("gone")).cast("decimal(38,0)").alias("flow")).alias("phase"))
    marks = blocks.select("src", "a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b"))).alias("m")).withColumn("v", F.col("m") / F.col("a"))
    both = marks.withColumn("phase", F.lit(None).cast(phases.schema["phase"].dataType)).unionByName(phases, allowMissingColumns=True)
    found = running(both, ["v"], "phase", "at", "max", inclusive=True).where("m IS NOT NULL")
    given, flow = F.coalesce("at.given", F.lit(0)), F.coalesce("at.flow", F.lit(total).cast("decimal(38,0)"))
    timed = found.select("src", "b", "m", given.alias("given"), (whole("m") * flow).cast("decimal(38,0)").alias("up"), whole("a").alias("a"))
    timed = timed.select("src", "b", "m", (F.col("given") + F.expr("up div a")).alias("floor"), (F.col("given") + F.expr("(up + a - 1) div a")).alias("ceil"))
    begin = timed.where("m < b").select("src", F.col("m").alias("block"), F.col("floor").alias("release"), F.lit(None).cast("bigint").alias("deadline"))
    end = timed.where("m > 0").select("src", (F.col("m") - 1).alias("block"), F.lit(None).cast("bigint").alias("release"), F.col("ceil").alias("deadline"))
    return begin.unionAll(end).groupBy("src", "block").agg(F.max("release").alias("release"), F.max("deadline").alias("deadline"))


_JOB = "struct<deadline:bigint,src:string,block:bigint,release:bigint>"


def _run(own: Column, carry: Column, start: Column, slots: Column) -> Column:
    """struct(order, left): earliest deadline first over a stretch, from its own jobs by release and the jobs that were left over."""
    none = F.array().cast(f"array<{_JOB}>")

    def step(acc: Column, t: Column) -> Column:
        fresh = F.filter(own, lambda x: x["release"] == start + t)
        ready = F.concat(acc["left"], fresh)
        best = F.array_min(ready)
        return F.struct(F.concat(acc["order"], F.array(best)).alias("order"), F.array_remove(ready, best).alias("left"))

    ts = F.sequence(F.lit(0).cast("bigint"), slots - 1)
    return F.aggregate(ts, F.struct(none.alias("order"), carry.alias("left")), step, lambda x: F.struct(x["order"].alias("order"), F.array_sort(x["left"]).alias("left")))


def schedule(parts: DataFrame, block_docs: int = BLOCK_DOCS, stretch: int | None = None) -> DataFrame:
    """From (src, n, a): (src, block, slot), one row a block."""
    width = stretch or STRETCH
    jobs = windows(parts, block_docs).checkpoint()
    total = jobs.count()
    if not total:
        return jobs.select("src", "block", F.col("release").alias("slot"))
    job = F.struct("deadline", "src", "block", "release")
    at = F.floor(F.col("release") / width)
    own = jobs.groupBy(at.alias("k")).agg(F.array_sort(F.collect_list(job)).alias("own"))
    lasts = F.floor((F.col("deadline") - 1) / width)
    waiting = jobs.where(lasts > at).select(job.alias("job"), F.explode(F.sequence(at + 1, lasts)).alias("k"))
    waiting = waiting.groupBy("k").agg(F.array_sort(F.collect_list("job")).alias("flowing"))
    sizes = jobs.groupBy(at.alias("k")).agg(F.count(F.lit(1)).alias("n"))  # one number a stretch
    released = running(sizes, ["k"], "n", "so_far", "sum")
    ks = parts.sparkSession.range(0, -(-total // width)).select(F.col("id").alias("k"))
    rows = ks.join(own, "k", "left").join(waiting, "k", "left").join(released, "k", "left")
    none = F.array().cast(f"array<{_JOB}>")
    rows = rows.select("k", F.coalesce("own", none).alias("own"), F.coalesce("flowing", none).alias("flowing"), "so_far").withColumn("start", F.col("k") * width)
    rows = rows.withColumn("slots", F.least(F.lit(total) - F.col("start"), F.lit(width)))
    early = F.size("flowing") - (F.coalesce("so_far", F.lit(total)) - F.col("start"))  # of those in flow, so many are done if all before is
    guess = F.slice("flowing", F.greatest(early, F.lit(0)).cast("int") + 1, F.size("flowing"))
    rows = rows.withColumn("carry", guess).repartition(shuffle_width(parts), "k").checkpoint()
    run = lambda df: df.withColumn("out", _run(F.col("own"), F.col("carry"), F.col("start"), F.col("slots"))).checkpoint()
    done = run(rows)
    while True:
        left = done.select((F.col("k") + 1).alias("k"), F.col("out.left").alias("real"))
        joined = done.join(left, "k", "left").withColumn("real", F.coalesce("real", none)).checkpoint()
        if joined.where("carry <> real").isEmpty():
            break
        again = run(joined.where("carry <> real").select("k", "own", "flowing", "so_far", "start", "slots", F.col("real").alias("carry")))
        done = joined.where("carry = real").drop("real").unionByName(again).checkpoint()
    placed = done.select("start", F.posexplode("out.order").alias("i", "job"))
    return placed.select("job.src", "job.block", (F.col("start") + F.col("i")).alias("slot"))


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, temperature: float = 0.5) -> DataFrame:
    """All columns of docs and mix_slot (the block's place in the mix), mix_pos (place in the block), mix_block (the block's number in its source).

    The order of the mix is (mix_slot, mix_pos).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.col("text") if "text" in docs.columns else F.lit("")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    src = F.coalesce(F.col("source"), F.lit(""))
    keyed = docs.withColumns({"mix_src": src, "mix_key": digest}).withColumn("mix_bucket", F.substring("mix_key", 1, PREFIX))
    sizes = keyed.groupBy("mix_src", "mix_bucket").agg(F.count(F.lit(1)).alias("k")).checkpoint()
    before = F.coalesce(F.sum("k").over(W.partitionBy("mix_src").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("mix_src", "mix_bucket", before.alias("mix_before"))
    counts = sizes.groupBy("mix_src").agg(F.sum("k").alias("n")).withColumnRenamed("mix_src", "src")
    slots = schedule(shares(counts, weights, temperature).checkpoint(), block_docs).checkpoint()
    if slots.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    tie = F.xxhash64(text)
    numbered = keyed.join(offsets, ["mix_src", "mix_bucket"])
    rank = F.col("mix_before") + F.row_number().over(W.partitionBy("mix_src", "mix_bucket").orderBy("mix_key", tie)) - 1
    numbered = numbered.withColumn("mix_rank", rank)
    placed = numbered.withColumns({"mix_block": F.floor(F.col("mix_rank") / block_docs), "mix_pos": (F.col("mix_rank") % block_docs).cast("int")})
    names = {"src": "mix_src", "block": "mix_block", "slot": "mix_slot"}
    placed = placed.join(slots.select(*[F.col(a).alias(b) for a, b in names.items()]), ["mix_src", "mix_block"])
    return placed.select(*[F.col(c) for c in docs.columns], "mix_slot", "mix_pos", "mix_block")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document stands in the mix."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").cast("string").alias("text"))  # the hash alone moves
    return mix_sources(rows).select("doc_id", "source", "mix_slot", "mix_pos", "mix_block")
