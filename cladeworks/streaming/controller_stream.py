"""The curriculum controller as a Structured Streaming job with keyed state and event-time timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cladeworks.operators.control import REPLAY, ControllerConfig, ControllerState, _epochs, restored, saved

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [c.split()[0] for c in REPLAY.split(", ")]
HELD = "ts timestamp, train_loss double, val_loss double, mrr double"
LOSSES = ("train_loss", "val_loss", "mrr")
LATENESS = "10 seconds"


class RunController(StatefulProcessor):
    """One run: epochs wait, under their number, until the watermark has passed them; then they are applied in order.

    So epochs may arrive in any order as long as none is later than the watermark, and one that is sent twice counts once. A run
    without epochs for as long as idle seconds (of event time) gives its state up.
    """

    def __init__(self, cfg: ControllerConfig, idle: int | None = None):
        self.cfg, self.idle = cfg, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("controller", "state string, last bigint")
        self.held = handle.getMapState("held", "epoch bigint", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if pd.isna(key[0]):  # a row that only moves the watermark; left out earlier it would not
            return iter(())
        last = self.state.get()[1] if self.state.exists() else None
        for frame in rows:
            for r in frame.itertuples():
                if not pd.isna(r.epoch) and (last is None or r.epoch > last) and not self.held.containsKey((int(r.epoch),)):
                    self.held.updateValue((int(r.epoch),), (r.ts, *[None if pd.isna(x) else float(x) for x in (r.train_loss, r.val_loss, r.mrr)]))
                    self.handle.registerTimer(int(r.ts.timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], v) for k, v in self.held.iterator() if v[0].timestamp() * 1000 <= now)
        if not due:
            if self.idle and self.state.exists() and not any(True for _ in self.held.keys()):
                self.state.clear()
            return
        text, last = self.state.get() if self.state.exists() else (json.dumps(saved(ControllerState())), -1)
        controller = restored(json.loads(text))
        rows = pd.DataFrame([(key[0], epoch, *v[1:]) for epoch, v in due if epoch > last], columns=["run", "epoch", *LOSSES]).astype(dict.fromkeys(LOSSES, "float64"))
        out = list(_epochs(rows, controller, self.cfg))
        for epoch, _ in due:
            self.held.removeKey((epoch,))
        self.state.update((json.dumps(saved(controller)), max(last, due[-1][0])))
        if self.idle:
            self.handle.registerTimer(int(now + self.idle * 1000))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def timed_epochs(history: DataFrame) -> DataFrame:
    """Epochs, from 0, with their event time: one second each, behind the time that a stream's watermark starts from."""
    return history.withColumn("ts", F.timestamp_seconds(F.col("epoch") + 1))


def ended(history: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The epochs and a row of no run, so far behind the last one that its watermark lets all of them go."""
    end = F.max("ts") + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 second")
    return history.unionByName(history.agg(end.alias("ts")), allowMissingColumns=True)


def stream_controller(history: DataFrame, cfg: ControllerConfig = ControllerConfig(), lateness: str = LATENESS, idle: int | None = None) -> DataFrame:
    """The controller over a stream of epochs (run, epoch, train_loss, val_loss, mrr, ts): one state per run, in the order of epochs.

    ts must grow with the epoch; epochs may arrive as late as lateness behind the latest one of all runs, in any order, and more than once. A row without a run
    only moves the watermark. The session must keep its state in RocksDB (STORE).
    """
    return (
        history.select("run", "epoch", "train_loss", "val_loss", "mrr", "ts")
        .withWatermark("ts", lateness)
        .groupBy("run")
        .transformWithStateInPandas(RunController(cfg, idle), REPLAY, "Append", "EventTime")
    )
