"""Column functions as a graph: a step needs columns and gives columns, and asked names run the fewest steps that give them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame


class Step(NamedTuple):
    """``rules``: what the given columns have to meet, as SQL conditions by name."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    tags: frozenset[str] = frozenset()
    rules: dict[str, str] = {}


def family(function: Callable[..., Column | Callable[[DataFrame], Column]], needs: Iterable[str], members: dict[str, tuple], tags: Iterable[str] = ()) -> list[Step]:
    """A step for each member: the column ``function(*arguments)``, or what that gives of the frame, under its name."""
    of = lambda made, frame: made(frame) if callable(made) else made
    one = lambda name, args: lambda frame: frame.withColumn(name, of(function(*args), frame))
    return [Step(name, tuple(needs), (name,), one(name, args), frozenset(tags)) for name, args in members.items()]


class Graph:
    """Steps by the columns that they give. A column has one step; steps that need each other in a ring are refused when asked for."""

    def __init__(self, steps: Iterable[Step]):
        self.steps = list(steps)
        self.giver: dict[str, Step] = {}
        for step in self.steps:
            for column in step.gives:
                if column in self.giver:
                    raise ValueError(f"{column} is given by {self.giver[column].name} and by {step.name}")
                self.giver[column] = step

    def extended(self, *steps: Step) -> Graph:
        return Graph([*self.steps, *steps])

    def tagged(self, tag: str) -> list[str]:
        return [c for s in self.steps if tag in s.tags for c in s.gives]

    def plan(self, names: Iterable[str], have: Iterable[str]) -> list[Step]:
        """The steps that ``names`` need beyond the columns at hand, each after what it needs."""
        there, order, open_ = set(have), [], []

        def visit(column: str) -> None:
            if column in there:
                return
            step = self.giver.get(column)
            if step is None:
                raise ValueError(f"unknown column: {column}" + (f", needed by {open_[-1].name}" if open_ else ""))
            if step in open_:
                raise ValueError("steps need each other: " + ", ".join(s.name for s in [*open_, step]))
            open_.append(step)
            for need in step.needs:
                visit(need)
            open_.pop()
            there.update(step.gives)
            order.append(step)

        for name in names:
            visit(name)
        return order

    def run(self, frame: DataFrame, names: Iterable[str]) -> DataFrame:
        """``frame`` with the columns of all steps that ``names`` need."""
        for step in self.plan(list(names), frame.columns):
            frame = step.run(frame)
        return frame

    def rules(self, names: Iterable[str], have: Iterable[str] = ()) -> dict[str, str]:
        """What the columns of the planned steps have to meet."""
        return {k: v for s in self.plan(list(names), have) for k, v in s.rules.items()}

    def lineage(self, spark: Any) -> DataFrame:
        """(step, column, needs, tags): a row a column."""
        rows = [(s.name, c, list(s.needs), sorted(s.tags)) for s in self.steps for c in s.gives]
        return spark.createDataFrame(rows, "step string, column string, needs array<string>, tags array<string>")
