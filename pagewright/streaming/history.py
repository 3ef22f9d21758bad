"""Undo and redo of recorded states, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 50
SCHEMA = "run long, event_id long, command string, state string, undo long, redo long"


class Fold:
    """The undo and redo lists of one run and its current state."""

    def __init__(self, undo: list[str] | None = None, redo: list[str] | None = None, current: str | None = None):
        self.undo, self.redo, self.current = undo or [], redo or [], current

    def apply(self, command: str, state: str | None) -> None:
        """record: remember the current state, unless it is the last one remembered, and clear redo; undo and redo: step between the lists."""
        if command == "undo":
            if self.undo:
                if self.current is not None:
                    self.redo = [*self.redo, self.current][-LIMIT:]
                self.current = self.undo.pop()
        elif command == "redo":
            if self.redo:
                if self.current is not None:
                    self.undo = [*self.undo, self.current][-LIMIT:]
                self.current = self.redo.pop()
        elif state != self.current:
            if self.current is not None and (not self.undo or self.undo[-1] != self.current):
                self.undo = [*self.undo, self.current][-LIMIT:]
            self.redo = []
            self.current = state


def _folded(fold: Fold, pdf: pd.DataFrame) -> list[tuple]:
    rows = []
    for e in pdf.sort_values(["ts", "event_id"]).itertuples():
        fold.apply(e.command, e.state)
        rows.append((int(e.run), int(e.event_id), e.command, fold.current, len(fold.undo), len(fold.redo)))
    return rows


_COLUMNS = ["run", "event_id", "command", "state", "undo", "redo"]


def replay(log: DataFrame) -> DataFrame:
    """The state after every command of a log (run, ts, event_id, command, state)."""
    return log.groupBy("run").applyInPandas(lambda pdf: pd.DataFrame(_folded(Fold(), pdf), columns=_COLUMNS), SCHEMA)


def stream(log: DataFrame) -> DataFrame:
    """``replay`` of a streaming log; the lists are kept between micro-batches, commands being in order across them."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(*json.loads(held.get[0])) if held.exists else Fold()
        rows = _folded(fold, pd.concat(list(batches)))
        held.update((json.dumps([fold.undo, fold.redo, fold.current]),))
        yield pd.DataFrame(rows, columns=_COLUMNS)

    return log.groupBy("run").applyInPandasWithState(step, SCHEMA, "lists string", "append", GroupStateTimeout.NoTimeout)


def command_log(events: DataFrame) -> DataFrame:
    """Events as a command log: a click undoes, an error redoes, all else records its type and value."""
    kind = F.col("event_type")
    command = F.when(kind == "click", "undo").when(kind == "error", "redo").otherwise("record")
    return events.select(F.col("user_id").alias("run"), "ts", "event_id", command.alias("command"), F.concat_ws(":", kind, F.col("value").cast("string")).alias("state"))


def windowed(trace: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts of stages in tumbling windows of a streaming trace (ts, stage); later events than ``late`` are left out."""
    return trace.withWatermark("ts", late).groupBy(F.window("ts", size), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def sessions(trace: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of runs in a streaming trace (run, ts)."""
    return trace.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "run").agg(F.count("*").alias("n")).select("run", F.col("session_window.start").alias("start"), "n")
