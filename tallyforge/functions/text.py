"""Text and JSON functions as columns: answers, code blocks, prompt features, names and statuses."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def last_boxed(text: Column) -> Column:
    r"""The last ``\boxed{...}`` or ``\fbox{...}`` with balanced braces; null without one or if it stays open.

    A fold over the characters after the last opening keeps the depth; a regular expression cannot count braces.
    """
    find = lambda mark: F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)
    has = lambda mark: F.contains(text, F.lit(mark))
    boxed, fbox = "\\boxed{", "\\fbox{"
    at = F.greatest(F.when(has(boxed), find(boxed)), F.when(has(fbox), find(fbox)))
    tail = F.substr(text, at + 1)
    step = lambda acc, c: F.struct(
        F.when(acc["end"] > 0, acc["depth"]).otherwise(acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
        (acc["i"] + 1).alias("i"),
        F.when((acc["end"] == 0) & (acc["depth"] == 1) & (c == "}"), acc["i"] + 1).otherwise(acc["end"]).alias("end"),
    )
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(tail, ""), zero, step, lambda acc: acc["end"])
    return F.when(at.isNotNull() & (end > 0), F.substr(tail, F.lit(1), end))


def strip_box(text: Column) -> Column:
    """What is inside the box."""
    return F.regexp_replace(text, r"^\\(?:boxed|fbox)\{([\s\S]*)\}$", "$1")


#: Fixed values, in the order in which they apply: what an answer loses or swaps before it is compared.
ANSWER_STEPS = (
    ("literal", "\\!", ""), ("literal", "\\,", ""), ("literal", "\\ ", ""), ("literal", "\\;", ""), ("literal", "\\:", ""),
    ("literal", "\\left", ""), ("literal", "\\right", ""),
    ("literal", "\\dfrac", "\\frac"), ("literal", "\\tfrac", "\\frac"),
    ("pattern", r"\^\s*\{?\s*\\circ\s*\}?", ""),
    ("literal", "\\circ", ""), ("literal", "\\degree", ""), ("literal", "\\%", ""), ("literal", "%", ""),
    ("pattern", r"\\text\{([^}]*)\}", "$1"), ("pattern", r"\\mbox\{([^}]*)\}", "$1"),
    ("literal", "\\$", ""), ("literal", "$", ""),
    ("pattern", r"^\s+|\s+$", ""), ("pattern", r"\.+$", ""), ("pattern", r"\s+", ""),
    ("pattern", r"^\+(?=.)", ""), ("pattern", r"^(-?\d+)\.0+$", "$1"),
)


def normalize_answer(text: Column) -> Column:
    """An answer without decoration; empty for null."""
    s = F.coalesce(text, F.lit(""))
    for kind, old, new in ANSWER_STEPS:
        s = F.replace(s, F.lit(old), F.lit(new)) if kind == "literal" else F.regexp_replace(s, old, new)
    return s


def as_ratio(text: Column) -> Column:
    """struct(num, den) of a plain integer, decimal or fraction that fits decimals; null for anything else or a zero denominator."""
    ok = text.rlike(r"^[+-]?\d{1,12}(\.\d{1,6})?(/\d{1,12})?$")
    top = F.regexp_extract(text, r"^([^/]+)", 1).cast("decimal(18,6)")
    low = F.coalesce(F.nullif(F.regexp_extract(text, r"/(\d+)$", 1), F.lit("")), F.lit("1")).cast("decimal(12,0)")
    return F.when(ok & (low != 0), F.struct(top.alias("num"), low.alias("den")))


@pandas_udf(T.BooleanType())
def _same_exactly(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equality of plain numbers of any length; null unless both are numbers."""
    form = re.compile(r"([+-]?[0-9]+(?:\.[0-9]+)?)(?:/([0-9]+))?")

    def value(x: str | None) -> Fraction | None:
        m = form.fullmatch(x or "")
        return Fraction(m[1]) / int(m[2] or 1) if m and int(m[2] or 1) else None

    def same(x: str | None, y: str | None) -> bool | None:
        p, q = value(x), value(y)
        return None if p is None or q is None else p == q

    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype="object")


def same_number(a: Column, b: Column) -> Column:
    """Equality of two plain numbers by cross-multiplication, null unless both are numbers.

    Numbers of up to 12 digits and 6 decimals stay with the engine's decimals; only rows in which either is a longer
    number, which are rare, are compared as exact fractions of any length.
    """
    x, y = as_ratio(a), as_ratio(b)
    number = lambda c: c.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?(/[0-9]+)?$")
    long = (x.isNull() | y.isNull()) & number(a) & number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x["num"] * y["den"] == y["num"] * x["den"]).when(long, _same_exactly(F.when(long, a), F.when(long, b)))


def last_code_block(text: Column) -> Column:
    """The last fenced block, or the whole text."""
    found = F.regexp_extract_all(text, F.lit(r"```(?:python|py)?[ \t]*\n([\s\S]*?)```"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(text)


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def math_features(q: Column, a: Column, source: Column, sources: tuple[str, ...]) -> dict[str, Column]:
    """Cheap features of a problem text, its answer and its source."""
    q, a = F.coalesce(q, F.lit("")), F.coalesce(a, F.lit(""))
    n, low, t = F.length(q), F.lower(q), F.trim(a)
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    slashes = F.regexp_count(q, F.lit(r"\\"))
    out = {f"src_{s}": _flag(F.coalesce(source == s, F.lit(False))) for s in sources}
    return out | {
        "n_char": n, "n_word": F.size(words(q)), "n_sentence": F.greatest(F.lit(1), F.regexp_count(q, F.lit(r"[.!?]+"))),
        "latex_backslash": slashes, "latex_density": share(slashes), "dollar": F.regexp_count(q, F.lit(r"\$")),
        "digit_ratio": share(F.regexp_count(q, F.lit(r"\d"))),
        "ans_is_int": _flag(t.rlike(r"^-?\d+$")), "ans_is_frac": _flag(F.contains(a, F.lit("/")) | F.contains(a, F.lit("\\frac"))),
        "ans_is_decimal": _flag(t.rlike(r"^-?\d+\.\d+$")), "ans_len": F.length(a),
        "kw_find": _flag(F.contains(low, F.lit("find"))), "kw_prove": _flag(F.contains(low, F.lit("prove"))),
        "kw_evaluate": _flag(low.rlike("evaluate|compute")), "kw_howmany": _flag(F.contains(low, F.lit("how many"))), "kw_let": _flag(low.rlike(r"\blet\b")),
    }


def code_features(q: Column) -> dict[str, Column]:
    """Cheap features of a programming task."""
    q = F.coalesce(q, F.lit(""))
    n, low = F.length(q), F.lower(q)
    has = lambda pattern: _flag(low.rlike(pattern))
    return {
        "n_char": n, "n_word": F.size(words(q)), "n_line": F.when(n > 0, F.regexp_count(q, F.lit("\n")) + 1).otherwise(0),
        "digit_ratio": F.when(n > 0, F.regexp_count(q, F.lit(r"\d")) / n).otherwise(0.0),
        "n_args": F.coalesce(F.nullif(F.regexp_extract(low, r"takes\s+(\d+)\s+argument", 1), F.lit("")).cast("int"), F.lit(0)),
        "has_example": has("example|input:|output:|>>>"), "has_fence": has("```"), "kw_function": has("function"), "kw_return": has("return"),
        "kw_list": has("list|array"), "kw_string": has("string"), "kw_integer": has("integer|number"), "kw_loop": has("iterate|each|loop"),
        "kw_sort": has("sort"), "kw_implement": has("implement|write a"),
    }


def contract_suffix(cases: Column) -> Column:
    """The sentence that a prompt gets from the first function case of a JSON list; null without one."""
    parsed = F.from_json(cases, "array<struct<entry:struct<kind:string,name:string>,args:array<string>>>")
    first = F.get(F.filter(parsed, lambda c: c["entry"]["kind"] == "function"), 0)
    n = F.size(first["args"])
    return F.when(first.isNotNull(), F.concat(F.lit("Write a function named `"), first["entry"]["name"], F.lit("` that takes "), n.cast("string"), F.when(n == 1, " argument.").otherwise(" arguments.")))


def case_list(cases: Column) -> Column:
    """The objects of a JSON list as JSON texts; none for anything else."""
    items = F.coalesce(F.from_json(cases, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: x.rlike(r"^\s*\{"))


def answer_budget(env: Column, configured: int, fixed: int = 2048) -> Column:
    """New tokens of the first phase: fixed for math, configured else."""
    return F.when(env == "math", fixed).otherwise(configured)


def env_or_default(env: Column, default: str = "math") -> Column:
    """The environment's name, or the default."""
    return F.coalesce(F.nullif(env, F.lit("")), F.lit(default))


def resume_source(text: Column) -> Column:
    """struct(kind, value) of ``sha:<40 hex>`` or ``path:<path>``; null otherwise."""
    kind = F.when(text.rlike(r"^sha:[0-9a-f]{40}$"), "sha").when(text.rlike(r"^path:.+$"), "path")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.regexp_extract(text, r"^[a-z]+:([\s\S]+)$", 1).alias("value")))


def checkpoint_number(title: Column) -> Column:
    """n of ``checkpoint n`` or ``ckpt_n``; null otherwise."""
    return F.nullif(F.regexp_extract(title, r"^(?:checkpoint |ckpt_)(\d+)\b", 1), F.lit("")).cast("bigint")


def bucket_of(kind: Column, level: Column) -> Column:
    """struct(kind, level) with "unknown" for missing parts."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.struct(known(kind).alias("kind"), known(level).alias("level"))


def ascii_escaped(text: Column) -> Column:
    """A JSON text with every character beyond ASCII as ``\\uXXXX``, pairs of them beyond the basic plane."""
    code = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(ch: Column) -> Column:
        n = F.ascii(ch)
        above = n - 0x10000
        pair = F.concat(code(F.shiftright(above, 10) + 0xD800), code(above.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(n < 0x80, ch).when(n < 0x10000, code(n)).otherwise(pair)

    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))


def canonical_json(text: Column) -> Column:
    """JSON without blanks, keys sorted at every level, beyond ASCII escaped; null for what is no JSON or repeats a key.

    Fractions lose trailing zeros (2.0 is 2); whole numbers of up to 38 digits, texts, flags and nulls stay as they are. Keys are
    in the order of their UTF-16 units: that of code points, unless keys beyond the basic plane meet keys from U+E000 on.
    """
    plain = F.replace(F.to_json(F.try_parse_json(text)), F.lit("\x7f"), F.lit("\\u007f"))
    lowered = plain
    for code in (f"{n:04X}" for n in range(0x20) if f"{n:04X}" != f"{n:04x}"):  # escapes of control characters, if not part of a text's own backslashes
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return ascii_escaped(F.when(plain.rlike(r"\\u00[01][A-F]"), lowered).otherwise(plain))


def case_id(problem: Column, cases: Column) -> Column:
    """16 hex digits that name a problem's cases: the hash of the problem's id and the cases' canonical JSON."""
    return F.substring(F.sha2(F.concat(problem, canonical_json(cases)), 256), 1, 16)
