"""Named flows: tables, ordered steps and outputs, as one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tallyloom.operators.columns import Step


class Flow:
    """A set of named tables that grow by steps; nothing runs until an output is written or collected."""

    def __init__(self, **tables: DataFrame):
        self.tables: dict[str, DataFrame] = dict(tables)
        self.used: set[str] = set()

    def step(self, new: str, source: str, *steps: Step) -> Flow:
        """new = source with the steps applied in order; a source may feed several."""
        self.tables[new] = reduce(DataFrame.transform, steps, self.tables[source])
        self.used.add(source)
        return self

    def combine(self, new: str, left: str, right: str, how) -> Flow:
        """new = how(left, right), for joins and unions."""
        self.tables[new] = how(self.tables[left], self.tables[right])
        self.used |= {left, right}
        return self

    def outputs(self, *names: str) -> dict[str, DataFrame]:
        """The named tables, or all that feed no other."""
        return {n: self.tables[n] for n in names or [t for t in self.tables if t not in self.used]}
