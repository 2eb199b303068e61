"""A polled source as a stream: verdicts since a cursor, with the cursor as the stream's offset.

A batch is the rows with start < ts <= end of every key. Its end is written to the stream's checkpoint before it is read, so
a batch that is run again after a failure polls the same span and gives the same rows, as long as the server still holds them.
Keys are polled by tasks, ``per_task`` of them each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "key string, ts double, merkle_root string, window_n bigint, accepted boolean, reason string, rewarded boolean"
FIELDS = ("ts", "merkle_root", "window_n", "accepted", "reason", "rewarded")


def poll(base: str, key: str, since: float, timeout: float = 10.0) -> list[dict]:
    """The verdicts of a key after a cursor; a reply that is no list holds none."""
    with urlopen(f"{base.rstrip('/')}/verdicts/{quote(key, safe='')}?since={since!r}", timeout=timeout) as reply:  # noqa: S310 - the address is the caller's
        found = json.load(reply)
    return [r for r in found if isinstance(r, dict) and isinstance(r.get("ts"), (int, float))] if isinstance(found, list) else []


@dataclass
class Span(InputPartition):
    """Some keys and the span of time that is polled for them."""

    keys: list[str]
    since: float
    until: float


class PollReader(DataSourceStreamReader):
    """The reader; the driver polls for the end of a batch, tasks for its rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["base"]
        self.keys = json.loads(options["keys"])
        self.per_task = int(options.get("per_task", "16"))
        self.first = self.newest = float(options.get("since", "0"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        """The newest ts that the server holds; a reader polls on from the newest it has seen."""
        self.newest = max([self.newest, *(float(r["ts"]) for k in self.keys for r in poll(self.base, k, self.newest))])
        return {"since": self.newest}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(self.keys[i : i + self.per_task], start["since"], end["since"]) for i in range(0, len(self.keys), self.per_task)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for key in partition.keys:
            rows = [r for r in poll(self.base, key, partition.since) if partition.since < r["ts"] <= partition.until]
            for r in sorted(rows, key=lambda r: (r["ts"], str(r.get("merkle_root")))):
                yield (key, float(r["ts"]), *[r.get(f) for f in FIELDS[1:]])

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


class PollSource(DataSource):
    """``polled``: options base (address), keys (JSON list), since (first cursor) and per_task."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PollReader:  # noqa: ANN001, N802
        return PollReader(dict(self.options))


def polled(spark: SparkSession, base: str, keys: list[str], since: float = 0.0, per_task: int = 16):  # noqa: ANN201
    """A stream of verdicts of some keys after a cursor."""
    spark.dataSource.register(PollSource)
    return spark.readStream.format("polled").options(base=base, keys=json.dumps(keys), since=repr(since), per_task=str(per_task)).load()
