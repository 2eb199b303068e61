"""Quality rules: a table of thresholds compiled into one projection, without user functions.

The base counts come from the whole text. Words are runs without ASCII white space. A word repeats when it lies in
a three-word window that the text holds twice or more; windows are compared by their 64-bit hash. Everything is
built from higher-order functions over the document's own row: no shuffle, no Python, and the work of a row grows
as n log n with its words.

Defined results: null or empty text has no words and fails the base rule; extra columns pass through, except that
one named as a count or verdict gives way to it; repeated rows and null ids each give a row; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.textops import SPACES, split_words
from tallyforge.plans.registry import table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it on was with as be by at this are from "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine es auch als "
    "de la le et les des en un du une que est dans pour qui pas au par sur plus "
    "el los y las por con no para su al lo se del como mas"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric that has to lie in [low, high] for a document to be kept."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table. Metrics are SQL over the base counts, with 100 where a share is meant in percent.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeats", "100.0 * n_repeat_words / nullif(n_words, 0)", high=50),
    Rule("word_length", "1.0 * word_chars / nullif(n_words, 0)", low=2, high=14),
    Rule("symbols", "1.0 * n_symbols / nullif(n_words, 0)", high=0.2),
    Rule("duplicate_lines", "1.0 * n_dup_lines / nullif(n_lines, 0)", high=0.5),
    Rule("stop_words", "1.0 * n_stop_words / nullif(n_words, 0)", low=0.02),
)


def _repeated(words: Column, order: Column) -> Column:
    """Positions of the three-word windows whose hash occurs twice or more, given windows sorted by hash."""
    n = F.size(order)
    same = lambda i, x: F.get(order, i)["h"] == x["h"]
    return F.sort_array(
        F.transform(
            F.filter(order, lambda x, i: F.coalesce(same(i - 1, x), F.lit(False)) | (i + 1 < n) & F.coalesce(same(i + 1, x), F.lit(False))),
            lambda x: x["p"],
        )
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words.

    Helper columns are named with a leading ``_q_`` and dropped again.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    stage = docs.withColumns({
        "_q_words": split_words(F.col(text), SPACES),
        "_q_lines": F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("bigint"),
    })
    words = F.col("_q_words")
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    stage = stage.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("bigint"),
        "n_lines": F.size("_q_lines").cast("bigint"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        "_q_order": F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")),
    })
    stage = stage.withColumn("_q_hits", _repeated(words, F.col("_q_order")))
    hits = F.col("_q_hits")
    width = F.transform(hits, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(hits, i + 1) - p, F.lit(3))).cast("bigint"))
    stage = stage.withColumn("n_repeat_words", F.aggregate(width, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return stage.drop("_q_words", "_q_lines", "_q_order", "_q_hits")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The array of the names of failed rules, in table order; a metric without a value (no words) fails none."""
    fails = lambda r: F.coalesce(~F.expr(r.metric).between(r.low, r.high), F.lit(False))
    failed = [F.when(fails(r), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*failed))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of the documents, the base counts, base_failed, failed_rules and kept."""
    counted = base_counts(docs, text).withColumn("failed_rules", verdict(rules))
    counted = counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return counted.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT r, unnest(range(0, len(ws) - 2)) AS p, ws FROM w WHERE len(ws) >= 3),
tt AS (SELECT r, p, ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] AS g FROM tri),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM tt) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT p + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM w JOIN ln USING (r) LEFT JOIN cov USING (r)),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    list_filter([
      CASE WHEN n_words < 50 THEN 'few_words' END,
      CASE WHEN 100.0 * n_repeat_words / nullif(n_words, 0) > 50 THEN 'repeats' END,
      CASE WHEN 1.0 * word_chars / nullif(n_words, 0) NOT BETWEEN 2 AND 14 THEN 'word_length' END,
      CASE WHEN 1.0 * n_symbols / nullif(n_words, 0) > 0.2 THEN 'symbols' END,
      CASE WHEN 1.0 * n_dup_lines / nullif(n_lines, 0) > 0.5 THEN 'duplicate_lines' END,
      CASE WHEN 1.0 * n_stop_words / nullif(n_words, 0) < 0.02 THEN 'stop_words' END], lambda x: x IS NOT NULL) AS failed_rules
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND len(failed_rules) = 0) AS kept, n_lines, n_stop_words, failed_rules
FROM f
"""
