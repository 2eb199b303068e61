"""Column builders shared by the text operators: word splitting, ASCII lower case, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: What separates alphanumeric words, case still mixed: every ASCII character but digits and letters.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def split_words(text: Column, separator: str) -> Column:
    """The non-empty pieces of a text between separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def alnum_words(text: Column) -> Column:
    """Words of digits, a-z and non-ASCII characters after A-Z is lower-cased."""
    return F.transform(split_words(text, NON_ALNUM), ascii_lower)


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id, or for a null one a hash of the text, so that null ids do not meet under one key."""
    return F.coalesce(doc_id.cast("bigint"), F.xxhash64(F.lit("row"), text))


def shuffle_width(df: DataFrame) -> int:
    """The number of shuffle partitions that the session sets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def append_from_texts(df: DataFrame, compute: Callable[[list[str | None]], list[list]], fields: str, keep_text: bool = False) -> DataFrame:
    """df with the columns that ``compute`` makes of a batch's texts, in Arrow batches; the column ``text`` goes unless kept.

    ``compute`` returns one list for each of ``fields``. Other columns pass through as they are, nulls included; one with
    the name of a new field, in whatever case, gives way to it.
    """
    new = T.StructType.fromDDL(fields)
    taken = {name.lower() for name in new.names}
    passed = [f.name for f in df.schema if f.name.lower() not in taken and (keep_text or f.name != "text")]
    schema = T.StructType([f for f in df.schema if f.name in passed] + list(new))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column("text").to_pylist())
            arrays = [batch.column(name) for name in passed] + [pa.array(x, KINDS[f.dataType.simpleString()]) for x, f in zip(made, new)]
            yield pa.RecordBatch.from_arrays(arrays, names=passed + new.names)

    return df.mapInArrow(work, schema)


#: Arrow types of the fields that append_from_texts can make.
KINDS = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
