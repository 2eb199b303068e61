"""The registry that the query modules fill."""

from __future__ import annotations

from tallyforge.plans.registry import Registry

REGISTRY = Registry()


def rounded(name: str, digits: int = 6):  # noqa: ANN201
    """A rounded column under its own name, as sums depend on their order."""
    from pyspark.sql import functions as F

    return F.round(F.col(name), digits).alias(name)
