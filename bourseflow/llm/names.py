"""Columns of a caller, whatever their names, beside the columns that an operator adds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def keeping_columns(docs: DataFrame, used: Sequence[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply(docs)`` for an operator that leaves the columns of ``docs`` in place.

    It sees those in ``used`` under their names and all others under names of
    ours, so that none clashes with a column it adds on the way.
    """
    names = docs.columns
    return apply(docs.toDF(*(c if c in used else f"kept_{i}" for i, c in enumerate(names)))).toDF(*names)
