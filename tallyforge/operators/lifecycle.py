"""The life of a window as transitions on events: legal steps move it on, others are refused and change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state that an event leads to from a state; a window begins in "ready".
STEPS = {
    ("ready", "opened"): "open",
    ("open", "sealed"): "training",
    ("training", "trained"): "publishing",
    ("training", "skipped"): "publishing",
    ("publishing", "published"): "ready",
    ("publishing", "kept"): "ready",
}
START = "ready"


def follow(events: DataFrame, key: str, order: list[str], event: str = "event") -> DataFrame:
    """(key, order, event, before, after, accepted) of every event, each key's in order.

    A key's events are folded as one array: they are the few steps of a window or of one loop over windows. Null and
    unknown events are refused.
    """
    table = F.create_map(*[F.lit(x) for (state, name), to in STEPS.items() for x in (f"{state} {name}", to)])
    packed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("event")))).alias("seq"))
    entry = packed.schema["seq"].dataType.elementType
    kind = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in entry)
    empty = F.array().cast(f"array<struct<{kind},before:string,after:string,accepted:boolean>>")

    def step(acc, x):  # noqa: ANN001, ANN202
        to = F.try_element_at(table, F.concat_ws(" ", acc["at"], F.coalesce(x["event"], F.lit(""))))
        done = F.struct(*[x[c].alias(c) for c in entry.names], acc["at"].alias("before"), F.coalesce(to, acc["at"]).alias("after"), to.isNotNull().alias("accepted"))
        return F.struct(F.coalesce(to, acc["at"]).alias("at"), F.concat(acc["out"], F.array(done)).alias("out"))

    folded = F.aggregate("seq", F.struct(F.lit(START).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return packed.select(key, F.inline(folded))


class Follower(StatefulProcessor):
    """The same in a stream of rows (key, ord, event): the state is where the key stands, and is dropped where it began."""

    output = "key string, ord bigint, event string, before string, after string, accepted boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at = self.at.get()[0] if self.at.exists() else START
        out = []
        for number, event in pd.concat(list(rows)).sort_values("ord")[["ord", "event"]].itertuples(index=False):
            to = STEPS.get((at, event))
            out.append((str(key[0]), int(number), event, at, to or at, to is not None))
            at = to or at
        if at == START:
            self.at.clear()  # nothing to remember: an absent state is the first one
        else:
            self.at.update((at,))
        yield pd.DataFrame(out, columns=["key", "ord", "event", "before", "after", "accepted"])

    def close(self) -> None:
        """Nothing is open."""


def following(stream: DataFrame) -> DataFrame:
    """``follow`` over a stream of rows (key, ord, event); it needs the state store of ``streaming.stateful``."""
    return stream.groupBy("key").transformWithStateInPandas(Follower(), Follower.output, "Append", "None")
