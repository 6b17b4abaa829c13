"""Jobs: one program run over a closed interval, as a stream, or both."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.time import Interval, batch_text
from ..operators.flow import Flow
from ..operators.run import Node, Plan, Run, within
from ..operators.store import VersionedStore
from ..sources.files import Source
from .state import CheckpointState

Program = Callable[[Mapping[str, DataFrame]], Flow]


class Behind(ValueError):
    """A store must catch up from before what the sources have."""


@dataclass
class Job:
    """program takes {name: DataFrame of (ts_ms, seq, ...)} and gives a Flow; its sums and writes are the effects. It is
    called to plan and again to run, so it must make the same operators in the same order.

    batch, streams: sources by name. options: by the label of a name(), or "DEFAULT". after: called with (run, None) when a
    run or micro-batch has ended, or with its exception.
    """

    program: Program
    batch: Mapping[str, Source] = field(default_factory=dict)
    streams: Mapping[str, Source] | None = None
    options: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    after: Callable[[Run, BaseException | None], None] | None = None

    def plan(self, frames: Mapping[str, DataFrame], wanted: Interval = Interval()) -> tuple[Run, Plan, Flow]:
        """The program's operators, stores and options, nothing read or written."""
        run = Run("plan", wanted, wanted, options={k: dict(v) for k, v in self.options.items()})
        with within(run):
            flow = self.program(frames)
        return run, Plan(run.nodes, run.options), flow

    def _do(self, run: Run, frames: Mapping[str, DataFrame]) -> None:
        try:
            with within(run):
                self.program(frames)
        except BaseException as e:
            if self.after:
                self.after(run, e)
            raise
        if self.after:
            self.after(run, None)

    def run(self, spark: SparkSession, wanted: Interval) -> Interval:
        """Run the program over what every source and service can give of the interval, and return that. Stores that are behind
        its beginning catch up: more is read, and Behind is raised if there isn't more."""
        could = wanted
        for s in self.batch.values():
            could = could & s.satisfiable(wanted)
        if could.empty:
            raise ValueError(f"nothing is available of {wanted}")
        planned, plan, _ = self.plan({n: s.frame(spark, could) for n, s in self.batch.items()}, could)
        for c in planned.clamps:
            could = c.clamp(could)
            if could.empty:
                raise ValueError(f"a service has nothing of {wanted}")
        reach = self._reach(planned.stores, could)
        for n, s in self.batch.items():
            if not s.covers(reach):
                raise Behind(f"a store needs {n} from {reach.lower} on, and it has {s.available}")
        stores = [s for s in planned.stores if isinstance(s, VersionedStore)]
        try:
            self._do(Run("batch", could, reach, plan=plan), {n: s.frame(spark, reach) for n, s in self.batch.items()})
        finally:
            for s in stores:
                s.release()
        return could

    @staticmethod
    def _reach(stores: list, could: Interval) -> Interval:
        """From where on all stores find what they lack. Reading from earlier on for one store may have another start
        from an older snapshot, so the search goes on until none asks for more."""
        now = could
        while True:
            lower = [s.needed(now).lower for s in stores if isinstance(s, VersionedStore)]
            new = Interval(None if None in lower else min([*lower, *([now.lower] if now.lower is not None else [])], default=None), now.upper)
            if new == now or now.lower is None:
                return now
            now = new

    def run_next(self, spark: SparkSession, state: CheckpointState) -> Interval:
        """One run of the state's next interval; its token is written only after all effects."""
        prepared = state.begin()
        try:
            could = prepared.requested
            for s in self.batch.values():
                could = could & s.satisfiable(prepared.requested)
            whole = state.batcher.covered_by(could)
            run = prepared.will_accept(state.batcher.span(whole) if not whole.empty else Interval(0, 0))
            self.run(spark, run.interval)
        except BaseException:
            prepared.fail()
            raise
        run.succeed()
        return run.interval

    def start(self, spark: SparkSession, checkpoint: str, available_now: bool = False, interval: str = "1 second") -> list:
        """Start a streaming query for each source and return them. Each micro-batch runs the whole program, with that
        source's rows and none of the others'; sums and sinks replace what a repeated micro-batch wrote."""
        from ..streaming.stream import start_query

        sources = self.streams or {}
        frames = {n: s.frame(spark) for n, s in sources.items()}
        nothing = {n: spark.createDataFrame([], f.schema) for n, f in frames.items()}
        _, plan, _ = self.plan(nothing)

        def each(name: str) -> Callable[[DataFrame, int], None]:
            def run(rows: DataFrame, epoch: int) -> None:
                rows.persist()
                try:
                    self._do(Run("stream", writer=name, epoch=epoch, plan=plan), nothing | {name: rows})
                finally:
                    rows.unpersist()

            return run

        return [start_query(f, each(n), f"{checkpoint}/{n}", available_now, interval) for n, f in frames.items()]


def dot(flow: Flow, plan: Plan | None = None) -> str:
    """The program's graph in DOT; a node that several others read is drawn once. With a plan, nodes tell what runs: which rows
    are kept for several readers, and the options that hold."""
    names: dict[int, str] = {}
    lines: list[str] = []

    def label(n: Node) -> str:
        out = n.label or n.kind
        k = plan.place.get(id(n)) if plan else None
        if k is None:
            return out
        held = {w: plan.option(k, w) for w in ("shards", "reducers", "grouping") if plan.option(k, w)}
        return out + " kept" * (plan.fan_out(k) > 1) + "".join(f" {w}={v}" for w, v in held.items())

    def walk(n: Node) -> str:
        if id(n) not in names:
            names[id(n)] = f"n{len(names)}"
            lines.append(f'  {names[id(n)]} [label="{label(n)}"];')
            lines.extend(f"  {walk(i)} -> {names[id(n)]};" for i in n.inputs)
        return names[id(n)]

    walk(flow.node)
    return "digraph flow {\n" + "\n".join(lines) + "\n}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Run a job's next batches, or its streams")
    p.add_argument("--local", action="store_true", help="on this machine alone")
    p.add_argument("--start-time", type=int, help="first millisecond; default: after the last run")
    p.add_argument("--batches", type=int, default=1)
    p.add_argument("--reducers", type=int, help="partitions of sums and other shuffles")
    p.add_argument("--shards", type=int, help="deal rows out into so many partitions before flat maps")
    p.add_argument("--state", help="folder of run tokens, of a batch run")
    p.add_argument("--stream", metavar="CHECKPOINT", help="run the streams, with this checkpoint folder, instead of a batch run")
    p.add_argument("--available-now", action="store_true", help="streams end with what is there")
    return p


def main(job: Job, batcher, argv: list[str] | None = None) -> Interval | None:
    """The command line of a job."""
    args = parser().parse_args(argv)
    builder = SparkSession.builder
    spark = (builder.master("local[*]") if args.local else builder).getOrCreate()
    if args.reducers:
        spark.conf.set("spark.sql.shuffle.partitions", args.reducers)
    given = {k: v for k, v in (("reducers", args.reducers), ("shards", args.shards)) if v}
    job.options = dict(job.options) | {"DEFAULT": dict(job.options.get("DEFAULT", {})) | given}
    if args.stream:
        for q in job.start(spark, args.stream, args.available_now):
            q.awaitTermination()
        return None
    if not args.state:
        raise SystemExit("a batch run needs --state")
    state = CheckpointState(spark, args.state, batcher, args.start_time, args.batches)
    done = job.run_next(spark, state)
    print(f"done to {batch_text(batcher.batch_of(done.upper))}")
    return done
