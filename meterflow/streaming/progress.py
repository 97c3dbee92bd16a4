"""Counts of a run while its rows flow: observed metrics of the one pass that writes them, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.photos import FAILED

OUTCOMES = ("PLUS", "MINUS", "REPEAT", *FAILED)
NAME = "photos"


def counts(outcome: str = "outcome") -> list:
    """The number of rows and of each outcome, as aggregates."""
    return [F.count(F.lit(1)).alias("done"), *[F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES]]


def observed(rows: DataFrame, observation: Observation | str = NAME, outcome: str = "outcome") -> DataFrame:
    """rows, whose outcomes are counted as they pass; batch jobs give an Observation, streams a name."""
    return rows.observe(observation, *counts(outcome))


def time_left(seconds: float, done: int, total: int) -> int | None:
    """Minutes that the rest takes at the speed so far; none before the first and after the last photo."""
    return round(seconds / done * (total - done) / 60) if 0 < done < total else None


class Progress(StreamingQueryListener):
    """Sums what batches of a stream observe; `parts` has the counts of each batch once, also of one that ran again."""

    def __init__(self, total: int | None = None):
        self.total, self.parts, self.seconds, self.failure, self.ended = total, {}, {}, None, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(NAME)
        if seen is not None:
            self.parts[event.progress.batchId] = seen.asDict()
            self.seconds[event.progress.batchId] = event.progress.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended, self.failure = True, event.exception

    def counts(self) -> dict[str, int]:
        """Rows and outcomes of all batches so far."""
        return {k: sum(p.get(k) or 0 for p in self.parts.values()) for k in ("done", *OUTCOMES)}

    def left(self) -> int | None:
        return None if self.total is None else time_left(sum(self.seconds.values()), self.counts()["done"], self.total)
