"""Environments behind one protocol: a catalogue of problem tables and reward columns, and rows dispatched to them by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.hashing import problem_id


@dataclass(frozen=True)
class Environment:
    """A named source of problems (idx from 0 without gaps, prompt, ground_truth) and the reward, 0 to 1, of a completion against a truth.

    Both are deterministic, and a reward never fails: null is 0.
    """

    name: str
    problems: DataFrame
    reward: Callable[[Column, Column], Column]


@dataclass
class Catalogue:
    """Environments by name."""

    known: dict[str, Environment] = field(default_factory=dict)

    def register(self, environment: Environment) -> Environment:
        if environment.name in self.known:
            raise ValueError(f"environment {environment.name!r} is registered twice")
        self.known[environment.name] = environment
        return environment

    def load(self, name: str) -> Environment:
        """The environment of a name; ValueError for an unknown one."""
        try:
            return self.known[name]
        except KeyError:
            raise ValueError(f"unknown environment: {name}") from None

    def problems_at(self, rows: DataFrame, env: str = "env", index: str = "index") -> DataFrame:
        """rows with prompt, ground_truth and id of the problem at ``index``, which wraps round; unknown environments give none.

        A problem table is counted once, and joined only to the rows of its own environment.
        """
        found = []
        for name, one in self.known.items():
            n = one.problems.count()
            own = rows.where(F.col(env) == name).withColumn("_idx", F.pmod(F.col(index), F.lit(max(n, 1))))
            problems = one.problems.select(F.col("idx").alias("_idx"), "prompt", "ground_truth", problem_id(F.col("prompt")).alias("id"))
            found.append(own.join(problems, "_idx").drop("_idx"))
        return reduce(DataFrame.unionByName, found) if found else rows.where("false").selectExpr("*", "'' AS prompt", "'' AS ground_truth", "'' AS id")

    def reward(self, env: Column, completion: Column, truth: Column) -> Column:
        """The reward of each row by its environment's own column; null for an unknown environment.

        Each builder sees null in rows of other environments, so a costly function works on its own rows alone.
        """
        out = F.lit(None).cast("double")
        for name, one in self.known.items():
            mine = lambda c: F.when(env == name, c)  # noqa: B023, E731
            out = F.when(env == name, F.coalesce(one.reward(mine(completion), mine(truth)).cast("double"), F.lit(0.0))).otherwise(out)
        return out


def end_tokens(configs: list[Column]) -> Column:
    """The sorted set of end tokens in JSON values that are a number, a list or null; anything else holds none."""

    def ids(text: Column) -> Column:
        items = F.when(text.rlike(r"^\s*-?\d+\s*$"), F.array(F.trim(text))).otherwise(F.from_json(text, "array<string>"))
        return F.coalesce(F.array_compact(F.transform(items, lambda x: F.when(x.rlike(r"^-?\d+$"), x.try_cast("bigint")))), F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.concat(*[ids(c) for c in configs])))
