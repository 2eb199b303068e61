"""Chat formatting with the loss mask found by incremental black-box rendering.

A template is any function from a list of turns to a string. Nothing is assumed about it: the prefixes of a
conversation are rendered one after the other and consecutive outputs are compared. Where an output does not continue the
one before, the template has rewritten history, and the turns whose characters moved are reported and lose their spans.
Inside the new part a turn's own text is located by rendering the same prefix with two probe texts in its place: what
the probes' outputs share at the two ends is the template's, the rest is the text's.

``BracketTemplate`` marks turns with control strings and escapes control strings inside texts reversibly, by one more
backslash behind the opening bracket; so what is between two control strings is always a text.

Defined results: turns are ordered by turn, then role, then text, nulls first; null texts and roles are empty; a null
conv_id is one conversation of its own; repeated rows are turns like any others; an empty table gives the rows that the caller
adds only. A conversation is one row here, so its size must fit a task; rendering takes time quadratic in its turns.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Two texts that differ in their first and last character, from each other and from any wrapper.
PROBES = ("\ue000\ue001", "\ue002\ue003")


class BracketTemplate:
    """``<s>[INST] user [/INST] assistant</s>``, with [SYS] for system turns and [ROLE] for any other role."""

    _CONTROL = r"/?(?:s>|(?:INST|SYS|ROLE)\])"
    _ESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
    _UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
    _TURN = re.compile(
        r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[SYS\] (?P<system>.*?) \[/SYS\]|<s>\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?)</s>| (?P<assistant>.*?)</s>",
        re.S,
    )

    def escape(self, text: str) -> str:
        """Text in which no control string is left."""
        return self._ESCAPE.sub(r"\1\\\2", text)

    def unescape(self, text: str) -> str:
        """The inverse of escape."""
        return self._UNESCAPE.sub(r"\1\2", text)

    def __call__(self, turns: list[Turn]) -> str:
        out = []
        for role, text in turns:
            own = self.escape(text)
            if role == "user":
                out.append(f"<s>[INST] {own} [/INST]")
            elif role == "system":
                out.append(f"<s>[SYS] {own} [/SYS]")
            elif role == "assistant":
                out.append(f" {own}</s>")
            else:
                out.append(f"<s>[ROLE]{self.escape(role)}[/ROLE] {own}</s>")
        return "".join(out)

    def read_back(self, output: str) -> list[Turn]:
        """The turns of an output."""
        turns, at = [], 0
        while at < len(output):
            m = self._TURN.match(output, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            kind = m.lastgroup
            turns.append((self.unescape(m["role"]) if kind == "other" else kind, self.unescape(m[kind])))
            at = m.end()
        return turns


def _shared_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


@dataclass
class Rendered:
    """An output, each turn's text span in it (None if a later turn rewrote it), and the turns that rewrote history."""

    output: str = ""
    spans: list[tuple[int, int] | None] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)


def render(template: Template, turns: list[Turn]) -> Rendered:
    """Render successive prefixes and locate every turn's text."""
    done = Rendered()
    for k, (role, _) in enumerate(turns):
        output = template(turns[: k + 1])
        if not output.startswith(done.output):
            stable = _shared_prefix(output, done.output)
            done.rewrites.append(k)
            done.spans = [s if s and s[1] <= stable else None for s in done.spans]
        one, two = (template([*turns[:k], (role, probe)]) for probe in PROBES)
        start = _shared_prefix(one, two)
        tail = _shared_prefix(one[start:][::-1], two[start:][::-1])
        sound = output[:start] == one[:start] and (not tail or output.endswith(one[-tail:])) and start + tail <= len(output)
        done.spans.append((start, len(output) - tail) if sound else None)
        done.output = output
    return done


def _lines(parts: list[Turn]) -> str:
    return "".join(f"{role}\n{text}\n" for role, text in parts)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order as structs of role and text."""
    value = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(value)).alias("turns"))


def format_conversations(turns: DataFrame, template: BracketTemplate | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: conv_id, formatted, mask (start and end of every trained text), rewrites, and the digests read back.

    n_lost counts the trained turns whose text was not located, because the template changed it later; they are not under the mask.
    """
    form = template or BracketTemplate()
    names = ["conv_id", "formatted", "mask_starts", "mask_ends", "rewrites", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_lost"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv in batch.column("turns").to_pylist():
                given = [(t["role"], t["text"]) for t in conv]
                got = render(form, given)
                back = form.read_back(got.output)
                wanted = [s for (role, _), s in zip(back, got.spans) if role in trained]
                mask = [s for s in wanted if s]
                loss = "".join(form.unescape(got.output[a:b]) for a, b in mask)
                rows.append((got.output, [a for a, _ in mask], [b for _, b in mask], got.rewrites, len(back), _sha(_lines(back)), len(loss), _sha(loss), len(got.output), len(wanted) - len(mask)))
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)

    schema = "conv_id bigint, formatted string, mask_starts array<bigint>, mask_ends array<bigint>, rewrites array<bigint>, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_lost bigint"
    return conversations_as_rows(turns.withColumn("conv_id", F.col("conv_id").cast("bigint"))).mapInArrow(work, schema)


#: The contract's extra conversation: a text made of control strings, said by both sides.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the extra one."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string")
    return format_conversations(turns.unionAll(extra)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|(?:INST|SYS|ROLE)\])')) AS n,
  CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 16 WHEN 'assistant' THEN 5 ELSE 21 + length(role) END AS around FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + around)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
