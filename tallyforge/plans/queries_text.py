"""Queries over text functions and graders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import grading, text
from tallyforge.operators import cadence
from tallyforge.plans.base import REGISTRY
from tallyforge.plans.registry import spread, table

SOURCES = ("src1", "src2", "src3")
_D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS q, lower(coalesce(text, '')) AS low, n_chars::VARCHAR AS a, source FROM documents)"
_WORDS = r"len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> ''))"
_COUNT = "len(regexp_extract_all(q, '{0}'))"


@REGISTRY.query("math_features", rf"""{_D} SELECT doc_id, {', '.join(f"(source = '{s}')::INT AS src_{s}" for s in SOURCES)}, length(q)::INT AS n_char, {_WORDS}::INT AS n_word, greatest(1, {_COUNT.format('[.!?]+')})::INT AS n_sentence, {_COUNT.format(chr(92) * 2)}::INT AS latex_backslash,
round(CASE WHEN length(q) > 0 THEN {_COUNT.format(chr(92) * 2)} / length(q) ELSE 0 END, 6)::DOUBLE AS latex_density, {_COUNT.format('[$]')}::INT AS dollar, round(CASE WHEN length(q) > 0 THEN {_COUNT.format('[0-9]')} / length(q) ELSE 0 END, 6)::DOUBLE AS digit_ratio,
regexp_full_match(trim(a), '-?[0-9]+')::INT AS ans_is_int, (contains(a, '/') OR contains(a, '\frac'))::INT AS ans_is_frac, regexp_full_match(trim(a), '-?[0-9]+[.][0-9]+')::INT AS ans_is_decimal, length(a)::INT AS ans_len,
contains(low, 'find')::INT AS kw_find, contains(low, 'prove')::INT AS kw_prove, (contains(low, 'evaluate') OR contains(low, 'compute'))::INT AS kw_evaluate, contains(low, 'how many')::INT AS kw_howmany, regexp_matches(low, '\blet\b')::INT AS kw_let FROM d""")
def math_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H17."""
    d = table(spark, sf_dir, "documents")
    cols = text.math_features(F.col("text"), F.col("n_chars").cast("string"), F.col("source"), SOURCES)
    return d.select("doc_id", *[(F.round(c, 6) if n in ("latex_density", "digit_ratio") else c.cast("int")).alias(n) for n, c in cols.items()])


@REGISTRY.query("code_features", rf"""{_D} SELECT doc_id, length(q)::INT AS n_char, {_WORDS}::INT AS n_word, CASE WHEN length(q) > 0 THEN len(string_split(q, chr(10))) ELSE 0 END::INT AS n_line, round(CASE WHEN length(q) > 0 THEN {_COUNT.format('[0-9]')} / length(q) ELSE 0 END, 6)::DOUBLE AS digit_ratio,
coalesce(nullif(regexp_extract(low, 'takes\s+(\d+)\s+argument', 1), '')::INT, 0)::INT AS n_args, regexp_matches(low, 'example|input:|output:|>>>')::INT AS has_example, contains(low, '```')::INT AS has_fence, contains(low, 'function')::INT AS kw_function, contains(low, 'return')::INT AS kw_return,
regexp_matches(low, 'list|array')::INT AS kw_list, contains(low, 'string')::INT AS kw_string, regexp_matches(low, 'integer|number')::INT AS kw_integer, regexp_matches(low, 'iterate|each|loop')::INT AS kw_loop, contains(low, 'sort')::INT AS kw_sort, regexp_matches(low, 'implement|write a')::INT AS kw_implement FROM d""")
def code_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H18."""
    cols = text.code_features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[(F.round(c, 6) if n == "digit_ratio" else c.cast("int")).alias(n) for n, c in cols.items()])


#: Answers built from part, as the tables hold none: (condition on p_partkey % 6, text in Spark, text in DuckDB).
def _answer() -> F.Column:
    k, n, m = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    return (
        F.when(k == 0, F.concat(F.lit(" +"), n, F.lit(".00 "))).when(k == 1, F.concat(F.lit("\\dfrac{"), n, F.lit("}{"), m, F.lit("}.")))
        .when(k == 2, F.concat(F.lit("$"), n, F.lit("^{\\circ}$"))).when(k == 3, F.concat(F.lit("\\text{"), F.col("p_name"), F.lit("} \\, "), n))
        .when(k == 4, F.concat(n, F.lit("\\%"))).otherwise(F.concat(n, F.lit("/"), m))
    )


_ANSWER = r"""a AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN ' +' || p_size || '.00 ' WHEN 1 THEN '\dfrac{' || p_size || '}{' || p_partkey || '}.' WHEN 2 THEN '$' || p_size || '^{\circ}$' WHEN 3 THEN '\text{' || p_name || '} \, ' || p_size WHEN 4 THEN p_size || '\%' ELSE p_size || '/' || p_partkey END AS t FROM part)"""


def _normal(sql: str) -> str:
    for kind, old, new in text.ANSWER_STEPS:
        new = new.replace("$1", "\\1")
        sql = f"replace({sql}, '{old}', '{new}')" if kind == "literal" else f"regexp_replace({sql}, '{old.replace('(?=.)', '(.)')}', '{new if '(?=.)' not in old else chr(92) + '1'}', 'g')"
    return sql


@REGISTRY.query("normalize_answer", f"WITH {_ANSWER} SELECT p_partkey, {_normal('t')} AS answer FROM a")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2."""
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_answer(_answer()).alias("answer"))


@REGISTRY.query("same_number", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_size % 2 = 0 ELSE (p_size * 2)::DECIMAL(20,0) * p_partkey = p_size::DECIMAL(20,0) * (p_partkey + p_partkey % 2) * 2 END AS same FROM part""")
def same_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: 2s / (k + k % 2) against s / k, doubled, by cross-multiplication; numbers of 7 decimals and of 13 digits."""
    k, s = F.col("p_partkey"), F.col("p_size")
    a = F.concat((s * 2).cast("string"), F.lit("/"), (k + k % 2).cast("string"))
    b = F.when(k % 4 == 0, "x").otherwise(F.concat((s * 2).cast("string"), F.lit(".0/"), k.cast("string")))
    long, other = F.concat(F.lit("1234567890123.0000001/"), k.cast("string")), F.concat(F.lit("12345678901230000001/"), k.cast("string"), F.when(s % 2 == 0, "0000000").otherwise("0000001"))
    a, b = F.when(k % 4 == 1, long).otherwise(a), F.when(k % 4 == 1, other).otherwise(b)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", text.same_number(a, b).alias("same"))


def _boxed() -> F.Column:
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    return F.when(k == 0, F.concat(F.lit("first \\boxed{1} then \\boxed{\\frac{"), n, F.lit("}{7}} end"))).when(k == 1, F.concat(F.lit("\\fbox{"), n, F.lit("}"))).when(k == 2, F.concat(F.lit("\\boxed{{"), n)).otherwise(F.concat(F.lit("no box\n"), n))


_BOXED = r"""CASE p_partkey % 4 WHEN 0 THEN '\boxed{\frac{' || p_size || '}{7}}' WHEN 1 THEN '\fbox{' || p_size || '}' END"""


@REGISTRY.query("last_boxed", rf"SELECT p_partkey, {_BOXED} AS boxed, CASE p_partkey % 4 WHEN 0 THEN '\frac{{' || p_size || '}}{{7}}' WHEN 1 THEN p_size::VARCHAR END AS inside FROM part")
def last_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1."""
    box = text.last_boxed(_boxed())
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("boxed")).withColumn("inside", text.strip_box(F.col("boxed")))


@REGISTRY.query("code_blocks", r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'plain ' || p_name ELSE 'x = ' || p_size || chr(10) END AS code FROM part""")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fence, or everything."""
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("plain "), F.col("p_name"))).otherwise(F.concat(F.lit("see\n```python\ny = 1\n```\nand\n```py\nx = "), F.col("p_size").cast("string"), F.lit("\n```\nok")))
    return table(spark, sf_dir, "part").select("p_partkey", text.last_code_block(t).alias("code"))


@REGISTRY.query("case_contracts", r"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % 3 END::BIGINT AS cases, CASE WHEN p_size % 3 = 1 THEN 'Write a function named `f' || p_partkey || '` that takes 1 argument.' WHEN p_size % 3 = 2 THEN 'Write a function named `f' || p_partkey || '` that takes 2 arguments.' END AS suffix FROM part""")
def case_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON cases, permissively."""
    head = F.concat(F.lit('{"entry":{"kind":"function","name":"f'), F.col("p_partkey").cast("string"), F.lit('"},"args":['))
    one = F.concat(F.lit("["), head, F.lit('"1"]}]'))
    two = F.concat(F.lit("["), head, F.lit('"1","2"]},{"entry":{"kind":"class"},"args":[]}, 7]'))
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "not json").when(F.col("p_size") % 3 == 1, one).otherwise(two).alias("c"))
    return d.select("p_partkey", F.size(text.case_list(F.col("c"))).cast("bigint").alias("cases"), text.contract_suffix(F.regexp_replace("c", r", 7\]$", "]")).alias("suffix"))


@REGISTRY.query("names_and_budgets", r"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'math' ELSE p_type END AS env, CASE WHEN p_size % 4 = 0 THEN 2048 ELSE p_size END::INT AS budget, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS checkpoint, CASE WHEN p_size % 3 = 0 THEN 'path' END AS kind,
CASE WHEN p_size % 3 = 0 THEN '/m/' || p_partkey END AS value, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE p_brand END AS bucket, 'http://h/state?env=' || replace(replace(CASE WHEN p_size % 4 = 0 THEN 'math' ELSE p_type END, '#', '%23'), ' ', '%20') AS url FROM part""")
def names_and_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H23-H25, A15, B10."""
    env = text.env_or_default(F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")))
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("checkpoint "), F.col("p_partkey").cast("string"))).otherwise("other 3")
    src = text.resume_source(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("path:/m/"), F.col("p_partkey").cast("string"))).otherwise("sha:12"))
    bucket = text.bucket_of(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")), F.lit(None))["kind"]
    return table(spark, sf_dir, "part").select("p_partkey", env.alias("env"), text.answer_budget(env, F.col("p_size")).cast("int").alias("budget"), text.checkpoint_number(title).alias("checkpoint"), src["kind"].alias("kind"), src["value"].alias("value"), bucket.alias("bucket"), cadence.state_address(F.lit("http://h"), env).alias("url"))


@REGISTRY.query("math_reward", r"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 5 THEN (p_size % 3 = 0)::INT WHEN p_partkey % 7 = 6 THEN 0 WHEN p_partkey % 7 = 4 THEN (p_size % 2 = 0)::INT
WHEN p_partkey % 4 = 0 THEN (p_size = 14)::INT WHEN p_partkey % 4 = 2 THEN 0 ELSE (p_size = 2)::INT END::DOUBLE AS reward FROM part""")
def math_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4-H9: exact and symbolic equality with the truth 2; words against their anagrams, towers of powers, sums of variables."""
    kind, size = F.col("p_partkey") % 7, F.col("p_size")
    word = F.when(size % 3 == 0, "\\boxed{east}").otherwise("\\boxed{seat}")
    tower = F.lit("\\boxed{" + "(" * 20 + "9" + "^9)" * 20 + "}")
    variables = F.when(size % 2 == 0, "\\boxed{y + 2x}").otherwise("\\boxed{2x - y}")
    given = F.when(kind == 5, word).when(kind == 6, tower).when(kind == 4, variables).otherwise(_boxed())
    truth = F.when(kind == 5, "east").when(kind == 4, "2x+y").otherwise("\\frac{2\\sqrt{4}}{2}")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", grading.math_reward_udf(given, truth).alias("reward"))


@REGISTRY.query("json_equal", r"SELECT p_partkey, p_size % 3 <> 1 AS same FROM part")
def json_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type-strict."""
    s = F.col("p_size") % 3
    a = F.when(s == 0, '{"a": [1, 2.0000000001]}').when(s == 1, "[true]").otherwise('"x"')
    b = F.when(s == 0, '{"a": [1, 2.0]}').when(s == 1, "[1]").otherwise('"x"')
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", grading.json_equal_udf(a, b).alias("same"))


@REGISTRY.query("code_facts", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[{"name": "f", "arity": 1, "returns": true, "root": true}, {"name": "g", "arity": 0, "returns": false, "root": false}]' ELSE '[]' END AS facts FROM part""")
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, never run."""
    src = F.when(F.col("p_size") % 2 == 0, "def f(a):\n    g()\n    return a\ndef g():\n    pass\n").otherwise("def (")
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", grading.code_facts_udf(src).alias("facts"))
