"""What surrounds a program while a job runs it: the interval or micro-batch, the options of each operator, and what
the planning pass has found out.

A job calls its program twice. The first call plans: operators note themselves, their inputs and their stores, and
nothing is read or written. The second one runs: sums and writes take effect where they stand in the program, and what
several operators read is kept so that it is computed once.
"""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.time import Interval

_current: ContextVar[Run | None] = ContextVar("run", default=None)

#: Operators that hand their input on as it is.
THROUGH = ("name", "write", "also")


@dataclass(frozen=True, eq=False)
class Node:
    """What a graph dump shows: an operator, its label and its inputs."""

    kind: str
    inputs: tuple[Node, ...] = ()
    label: str | None = None


class Plan:
    """The graph that the planning pass found; operators are known by the order in which the program makes them."""

    def __init__(self, nodes: list[Node], options: Mapping[str, Mapping[str, object]]):
        self.options, self.place = options, {id(n): k for k, n in enumerate(nodes)}
        self.nodes = nodes
        self.readers: list[list[int]] = [[] for _ in nodes]
        for k, n in enumerate(nodes):
            for i in n.inputs:
                if id(i) in self.place:
                    self.readers[self.place[id(i)]].append(k)

    def fan_out(self, k: int) -> int:
        """How many operators read the rows of the k-th."""
        total = 0
        for r in self.readers[k]:
            kind = self.nodes[r].kind
            total += kind == "write"
            if kind not in THROUGH:
                total += 1
            elif kind != "also" or self.nodes[r].inputs[-1] is self.nodes[k]:
                total += self.fan_out(r)
        return total

    def names(self, k: int) -> list[str]:
        """Names downstream of the k-th operator, the nearest first."""
        out, seen, now = [], {k}, [k]
        while now:
            out += [self.nodes[n].label for n in now if self.nodes[n].kind == "name"]
            now = [r for n in now for r in self.readers[n] if r not in seen and not seen.add(r)]
        return out

    def option(self, k: int, what: str):
        return next((self.options[n][what] for n in (*self.names(k), "DEFAULT") if what in self.options.get(n, ())), None)


@dataclass
class Run:
    """mode: "plan", "batch" or "stream". In batch, `wanted` is what takes effect and `reach` what is read, which begins
    earlier where a store must catch up. In a stream, `writer` and `epoch` name the micro-batch."""

    mode: str
    wanted: Interval = Interval()
    reach: Interval = Interval()
    writer: str = ""
    epoch: int = 0
    plan: Plan | None = None
    options: dict[str, dict[str, object]] = field(default_factory=dict)
    nodes: list[Node] = field(default_factory=list)
    stores: list = field(default_factory=list)
    clamps: list = field(default_factory=list)
    inputs: dict[int, DataFrame] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def option(self, what: str):
        """An option of the operator that is made next."""
        return self.plan.option(len(self.nodes), what) if self.plan else None

    def note(self, node: Node, df: DataFrame) -> DataFrame:
        """Take an operator in; its rows are kept if several others read them, unless the option `share` is false."""
        k = len(self.nodes)
        if self.plan and node.kind not in THROUGH and self.plan.fan_out(k) > 1 and self.plan.option(k, "share") is not False:
            df = df.persist()
            self.held.append(df)
        self.nodes.append(node)
        return df

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()


def current() -> Run | None:
    return _current.get()


@contextmanager
def within(run: Run):
    token = _current.set(run)
    try:
        yield run
    finally:
        _current.reset(token)
        run.release()


@dataclass(frozen=True)
class Pair:
    """The two forms of a source, sink, service or store: in batch runs, and in streams."""

    offline: object
    online: object


def pick(x):
    """What stands for x in this run."""
    if isinstance(x, Pair):
        run = current()
        return x.online if run and run.mode == "stream" else x.offline
    return x
