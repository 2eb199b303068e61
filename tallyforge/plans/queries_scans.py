"""Queries over sources: indexes, lookups, archives and joins by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.base import REGISTRY
from tallyforge.plans.registry import table
from tallyforge.sources import lens, readers


@REGISTRY.query("global_index", "SELECT row_number() OVER () - 1 AS idx, doc_id, lang FROM documents")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3."""
    return readers.indexed_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"])


@REGISTRY.query("modulo_lookup", "WITH i AS (SELECT row_number() OVER () - 1 AS idx, doc_id FROM documents) SELECT event_id AS want, i.idx, i.doc_id FROM events JOIN i ON i.idx = (event_id * 7) % (SELECT count(*) FROM documents)")
def modulo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A4, D7, M1."""
    docs = readers.indexed_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id"])
    n = table(spark, sf_dir, "documents").count()
    wanted = table(spark, sf_dir, "events").select((F.col("event_id") * 7).alias("want"))
    return readers.lookup(docs, wanted, n).select((F.col("want") / 7).cast("bigint").alias("want"), "idx", "doc_id")


@REGISTRY.query("eligible_indices", "SELECT idx FROM (SELECT row_number() OVER () - 1 AS idx, lang FROM documents) WHERE lang IN ('de', 'fr')")
def eligible_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, over all files of the table."""
    return readers.eligible_indices(spark, f"{sf_dir}/documents.parquet", "lang", ["de", "fr"])


@REGISTRY.query("asof_row_group", "WITH s AS (SELECT DISTINCT o_custkey * 37 AS start FROM orders) SELECT event_id AS idx, (SELECT max(start) FROM s WHERE start <= event_id * 5) AS start FROM events")
def asof_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest lower bound by one ordered pass per range."""
    points = table(spark, sf_dir, "events").select((F.col("event_id") * 5).alias("idx"))
    starts = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 37).alias("start")).distinct()
    return readers.start_of_range(points, starts).select((F.col("idx") / 5).cast("bigint").alias("idx"), "start")


@REGISTRY.query("first_routable", f"WITH {lens.META_SQL} SELECT pos, hotkey, uid, axon FROM meta WHERE permit ORDER BY pos LIMIT 1")
def first_routable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first permitted row with an address."""
    return readers.first_routable(lens.metagraph(spark, sf_dir)).select(F.col("pos").cast("bigint").alias("pos"), "hotkey", "uid", "axon")


@REGISTRY.query("metagraph_rows", "SELECT c_nationkey AS network, row_number() OVER (PARTITION BY c_nationkey, o ORDER BY c_custkey)::INT - 1 AS pos, c_custkey % 100 || '' AS hotkey FROM (SELECT *, c_custkey // 64 AS o FROM customer)")
def metagraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network's parallel arrays, 64 keys a row at most, zipped by position."""
    c = table(spark, sf_dir, "customer").withColumn("o", F.floor(F.col("c_custkey") / 64))
    m = c.groupBy("c_nationkey", "o").agg(F.sort_array(F.collect_list(F.struct("c_custkey", (F.col("c_custkey") % 100).cast("string").alias("hotkey"), (F.col("c_acctbal") > 0).alias("permit"), F.col("c_name").alias("axon")))).alias("m"))
    arrays = m.select("c_nationkey", F.col("m.hotkey").alias("hotkeys"), F.col("m.c_custkey").alias("uids"), F.col("m.permit").alias("permits"), F.col("m.axon").alias("axons"))
    return readers.unzip_metagraph(arrays, ["c_nationkey"]).select(F.col("c_nationkey").alias("network"), "pos", "hotkey")


@REGISTRY.query("mirror_first_match", "WITH s AS (SELECT l_partkey AS id, l_orderkey AS o, CASE WHEN l_quantity > 10 THEN l_quantity::INT::VARCHAR ELSE '' END AS cases, l_linenumber AS ln FROM lineitem) SELECT id, o, cases FROM s WHERE id IN (SELECT p_partkey FROM part WHERE p_size < 20) AND cases <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, ln) = 1")
def mirror_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, A14."""
    src = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("o"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int").cast("string")).otherwise("").alias("cases"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    mirror = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("id"))
    return readers.first_match(mirror, src, "id", "at").select("id", "o", "cases")


@REGISTRY.query("key_sets", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'difference', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, F21."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    parts = {"union": a.union(c.select("k")).distinct(), "intersect": a.intersect(c.where("c_acctbal > 0").select("k")), "difference": c.select("k").subtract(a)}
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, d in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])
