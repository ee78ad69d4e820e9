"""Jobs as a stream of state changes: Pending, Running, then Completed or Failed; overdue jobs fail by timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIMEOUT_S = 86_400 + 600
ORDER = ("Nonexistent", "Pending", "Running", "Completed", "Failed", "Archived", "Deleted")
NEXT = {"Nonexistent": {"Pending", "Archived"}, "Pending": {"Running", "Failed", "Deleted"}, "Running": {"Completed", "Failed"}, "Completed": {"Archived", "Deleted"}, "Failed": {"Deleted"}, "Archived": {"Deleted"}, "Deleted": set()}


def _fold(status: str, since: float, changes: list[tuple]) -> tuple[str, float, list[tuple]]:
    out = []
    for at, to in sorted(changes):
        if status in ("Pending", "Running") and at - since > TIMEOUT_S:
            status, since = "Failed", since + TIMEOUT_S
            out.append((since, status, True))
        allowed = to in NEXT[status]
        if allowed:
            status, since = to, at
        out.append((at, status, allowed))
    return status, since, out


def track(events: DataFrame, timeout_ms: int = TIMEOUT_S * 1000) -> DataFrame:
    """(job, at, status, accepted) from streamed changes (job, at double, to): changes that the state doesn't allow are
    reported and don't count. State is a status and a time for each job, with a processing-time timeout."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since = state.get if state.exists else ("Nonexistent", 0.0)
        if state.hasTimedOut:
            state.remove()
            if status in ("Pending", "Running"):
                yield pd.DataFrame([(key[0], since + timeout_ms / 1000, "Failed", True)], columns=["job", "at", "status", "accepted"])
            return
        changes = [(float(a), t) for pdf in pdfs for a, t in zip(pdf["at"], pdf["to"], strict=True)]
        status, since, out = _fold(status, since, changes)
        state.update((status, since))
        if status in ("Pending", "Running"):
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["job", "at", "status", "accepted"])

    return events.groupBy("job").applyInPandasWithState(step, "job string, at double, status string, accepted boolean", "status string, since double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(events: DataFrame) -> DataFrame:
    """The same over a finished log, one job at a time."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, out = _fold("Nonexistent", 0.0, [(float(a), t) for a, t in zip(pdf["at"], pdf["to"], strict=True)])
        return pd.DataFrame([(pdf["job"].iloc[0], *x) for x in out], columns=["job", "at", "status", "accepted"])

    return events.groupBy("job").applyInPandas(step, "job string, at double, status string, accepted boolean")


def resolve(places: list[tuple[str, Column]]) -> Column:
    """The status of the first place, in order, that has the job."""
    return F.coalesce(*[F.when(there, F.lit(name)) for name, there in places], F.lit("Nonexistent"))


def collect_outcomes(stream: DataFrame, succeeded: str, failed: str, checkpoint: str):
    """Appends each micro-batch of outcomes (ok boolean, ...) to one of two tables."""

    def put(batch: DataFrame, _: int) -> None:
        batch.filter("ok").write.mode("append").parquet(succeeded)
        batch.filter("not coalesce(ok, false)").write.mode("append").parquet(failed)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
