"""Throughput windows over a training log, from a table or live from a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.operators.ordered import running_total

_WINDOW = "run string, step long, tokens long, seconds double, tokens_per_second double"
_STATE = "since long, tokens long, seconds double, last long, seen long"


def _ends(step, validate_every: int, checkpoint_every: int | None):
    """Whether a step ends a window whatever its length; of numbers, arrays or columns."""
    found = step % validate_every == 0
    return found | (step % checkpoint_every == 0) if checkpoint_every else found


def closed(steps: np.ndarray, seen: np.ndarray, seconds: np.ndarray, ends: np.ndarray, interval: int, since: int = 0, tokens: int = 0, spent: float = 0.0):
    """Windows that close at these steps, (step, tokens, seconds) each, and the open one: the step and tokens it is since, and its seconds so far.

    A window goes to the first step `interval` or more after the last, or to one that ends it; the next is looked up, so work
    grows with the windows.
    """
    total, stops = np.cumsum(seconds), np.flatnonzero(ends)
    out, at, base = [], 0, -spent
    while True:
        stop = np.searchsorted(stops, at)
        end = min(max(at, int(np.searchsorted(steps, since + interval))), int(stops[stop]) if stop < len(stops) else len(steps))
        if end >= len(steps):
            break
        out.append((int(steps[end]), int(seen[end]) - tokens, float(total[end] - base)))
        since, tokens, base, at = int(steps[end]), int(seen[end]), float(total[end]), end + 1
    return out, (since, tokens, float(total[-1] - base) if len(total) else spent)


def _frame(run, windows: list[tuple[int, int, float]]) -> pd.DataFrame:
    rows = [(run, step, tokens, seconds, tokens / seconds if seconds else None) for step, tokens, seconds in windows]
    return pd.DataFrame(rows, columns=["run", "step", "tokens", "seconds", "tokens_per_second"]).astype({"step": "int64", "tokens": "int64", "seconds": "float64", "tokens_per_second": "float64"})


def throughput_windows(log: DataFrame, interval: int, validate_every: int, checkpoint_every: int | None = None, runs: int | None = None, stretches: int = 1024) -> DataFrame:
    """run, step, tokens, seconds, tokens_per_second: a window closes after `interval` steps, or at a validation, a checkpoint or the end.

    log: run, step, tokens_seen, seconds (of that step's work, pauses left out). Steps that end a window whatever its length
    cut a run into stretches; a group is `stretches` of them and knows those before by their last step alone, so a run of any
    length is many tasks.
    """
    last = log.groupBy("run").agg(F.max("step").alias("last_step"))
    ends: Column = _ends(F.col("step"), validate_every, checkpoint_every) | (F.col("step") == F.col("last_step"))
    rows = log.join(last, "run").select("run", F.col("step").cast("long").alias("step"), "tokens_seen", F.col("seconds").cast("double").alias("seconds"), ends.cast("long").alias("ends"))
    rows = running_total(rows, ["run", "step"], "ends", "stretch", runs)
    chunk = lambda stretch: F.floor(stretch / stretches)
    next_ = F.col("stretch") + 1
    before = rows.filter((F.col("ends") == 1) & (next_ % stretches == 0)).select("run", chunk(next_).alias("chunk"), F.col("step").alias("since"), F.col("tokens_seen").alias("tokens"))

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        since, tokens = (0 if pd.isna(x) else int(x) for x in rows[["since", "tokens"]].iloc[0])
        found, _ = closed(*(rows[c].to_numpy() for c in ("step", "tokens_seen", "seconds", "ends")), interval, since, tokens)
        return _frame(key[0], found)

    return rows.withColumn("chunk", chunk(F.col("stretch"))).join(before, ["run", "chunk"], "left").groupBy("run", "chunk").applyInPandas(fold, _WINDOW)


class OpenWindow(StatefulProcessor):
    """A run's open window as its state; a timer closes the last one once the run has been still for `idle` milliseconds."""

    def __init__(self, interval: int, validate_every: int, checkpoint_every: int | None, idle: int):
        self.interval, self.validate_every, self.checkpoint_every, self.idle = interval, validate_every, checkpoint_every, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, tokens, seconds, last, seen = self.open.get() if self.open.exists() else (0, 0, 0.0, -1, 0)
        new = pd.concat(rows).sort_values("step").drop_duplicates("step")
        new = new[new["step"] > last]  # steps that were told before
        if len(new):
            steps = new["step"].to_numpy()
            ends = np.asarray(_ends(steps, self.validate_every, self.checkpoint_every))
            found, (since, tokens, seconds) = closed(steps, new["tokens_seen"].to_numpy(), new["seconds"].to_numpy(float), ends, self.interval, since, tokens, seconds)
            self.open.update((since, tokens, seconds, int(steps[-1]), int(new["tokens_seen"].iloc[-1])))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
            if found:
                yield _frame(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, tokens, seconds, last, seen = self.open.get()
        if last > since:
            self.open.update((last, seen, 0.0, last, seen))
            yield _frame(key[0], [(last, seen - tokens, seconds)])

    def close(self) -> None:
        pass


def live_throughput_windows(log: DataFrame, interval: int, validate_every: int, checkpoint_every: int | None = None, idle: float = 600.0) -> DataFrame:
    """throughput_windows of a streaming log whose steps come in order within a run; steps told again are left out.

    A run ends when nothing came for `idle` seconds; should it go on after that, a window begins there. State lives in the
    query's checkpoint, by run, so a query that is started again goes on with the open windows. Needs the RocksDB state store.
    """
    slim = log.select(F.col("run").cast("string").alias("run"), F.col("step").cast("long").alias("step"), F.col("tokens_seen").cast("long").alias("tokens_seen"), F.col("seconds").cast("double").alias("seconds"))
    own = OpenWindow(interval, validate_every, checkpoint_every, int(idle * 1000))
    return slim.groupBy("run").transformWithStateInPandas(own, outputStructType=_WINDOW, outputMode="Append", timeMode="ProcessingTime")
