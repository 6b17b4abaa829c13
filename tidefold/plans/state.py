"""Which interval a batch job runs next: tokens in a folder, one run at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.time import Batcher, Interval
from ..sources.files import Files


class Refused(ValueError):
    pass


class Run:
    """An accepted interval; ends by succeed() or fail()."""

    def __init__(self, state: CheckpointState, interval: Interval):
        self.state, self.interval = state, interval

    def succeed(self) -> None:
        self.state._end(self.interval)

    def fail(self) -> None:
        self.state._end(None)


class Prepared:
    def __init__(self, state: CheckpointState, requested: Interval):
        self.state, self.requested = state, requested

    def will_accept(self, available: Interval) -> Run:
        """A run of the interval that the job can do: it must begin where the request does and end at a batch edge."""
        b = self.state.batcher
        good = not available.empty and available.lower == self.requested.lower and available.upper is not None
        if not good or not b.is_lower_edge(available.upper) or (self.requested.upper is not None and available.upper > self.requested.upper):
            self.fail()
            raise Refused(f"{available} was offered for {self.requested}")
        return Run(self.state, available)

    def fail(self) -> None:
        self.state._end(None)


class CheckpointState:
    """<ms>.version files in `path`, one per run that succeeded, named by its end. A run starts at `start` if given,
    else where the newest token ends, and takes `batches` batches. Files that begin with _ are not tokens. The file _running keeps
    other processes from beginning a run; takeover: it is left from one that died."""

    def __init__(self, spark: SparkSession, path: str, batcher: Batcher, start: int | None = None, batches: int = 1, takeover: bool = False):
        self.files, self.path, self.batcher, self.start, self.batches = Files(spark), path.rstrip("/"), batcher, start, batches
        if takeover:
            self.files.delete(f"{self.path}/_running")

    def tokens(self) -> list[int]:
        return sorted(int(n.removesuffix(".version")) for n in self.files.names(self.path) if n.endswith(".version") and not n.startswith("_"))

    def begin(self) -> Prepared:
        known = self.tokens()
        start = self.start if self.start is not None else (known[-1] if known else None)
        if start is None:
            raise Refused("no start is given and no run has succeeded")
        if not self.batcher.is_lower_edge(start):
            raise Refused(f"{start} is not the start of a batch")
        if self.start is not None and known and start > known[-1]:
            raise Refused(f"starting at {start} would leave a hole after {known[-1]}")
        if not self.files.claim(f"{self.path}/_running"):
            raise Refused("a run is under way")
        return Prepared(self, Interval(start, self.batcher.earliest(self.batcher.batch_of(start) + self.batches)))

    def _end(self, done: Interval | None) -> None:
        if done is not None:
            self.files.write(f"{self.path}/{done.upper}.version")
            self.start = None
        self.files.delete(f"{self.path}/_running")
