"""Curriculum control: schedules as column functions, run history as windows, the controller as a fold per run."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The phases in order, and the settings that each one brings.
PHASES = ("PHASE_1_ANCHORING", "PHASE_2_EXPANSION", "PHASE_3_DISCRIMINATION", "PHASE_4_STABILIZATION", "FINISHED")
SAMPLERS = ("hub_uniform", "difficulty_weighted", "hard_negative", "blended", None)


# --- schedules by epoch

def phase_of(epoch: Column, epochs: int, first: float = 0.3, second: float = 0.7, two_phase: bool = False) -> Column:
    """1, 2 or 3 by the share of epochs; two_phase merges the last two."""
    late = F.lit(2) if two_phase else F.when(epoch <= int(epochs * second), 2).otherwise(3)
    return F.when(epoch <= int(epochs * first), 1).otherwise(late)


def phase_flags(phase: Column, two_phase: bool = False) -> dict[str, Column]:
    """What each phase switches on."""
    return {
        "use_tree_distance": phase == 1,
        "mask_siblings": phase == 1,
        "enable_hard_negative_mining": phase >= 2,
        "enable_router_guided_sampling": phase >= 2,
        "enable_clustering": phase >= (2 if two_phase else 3),
    }


def updates_clusters(epoch: Column, epochs: int, every: int, first: float = 0.3, second: float = 0.7, two_phase: bool = False) -> Column:
    """Whether clusters are renewed in an epoch: every so many since the clustering phase began."""
    start = int(epochs * (first if two_phase else second))
    return (phase_of(epoch, epochs, first, second, two_phase) >= (2 if two_phase else 3)) & ((epoch - start) % every == 0)


def anneal(epoch: Column, epochs: int, metric: Column | None = None, threshold: float | None = None, below: bool = False) -> Column:
    """Progress from 0 to 1 by epoch; 1 at once where the metric has reached its threshold."""
    progress = F.least(F.greatest(epoch, F.lit(0)) / float(max(1, epochs)), F.lit(1.0))
    if metric is None or threshold is None:
        return progress
    return F.when(metric <= threshold if below else metric >= threshold, 1.0).otherwise(progress)


def between(start: float, end: float, progress: Column) -> Column:
    return start * (1 - progress) + end * progress


def graph_state(epoch: Column, epochs: int, warmup: int, hard_start: int, warm: float, cold: float, warmup_scale: float) -> dict[str, Column]:
    """Name, temperature, margin scale and hard-negative switch of the graph trainer's schedule."""
    progress = F.least(epoch, F.lit(epochs - 1)) / float(epochs - 1) if epochs > 1 else F.lit(1.0)
    temperature = between(warm, cold, progress)
    name = F.when(epoch < warmup, "warmup").when(epoch < hard_start, "expansion").otherwise("discrimination")
    return {
        "state": name,
        "temperature": F.when(name == "discrimination", F.greatest(F.lit(cold * 0.9), temperature * 0.9)).otherwise(temperature),
        "margin_scale": F.when(name == "warmup", warmup_scale).otherwise(1.0),
        "use_hard_negatives": name == "discrimination",
    }


# --- history of runs: rows (run, epoch, …)

def _per_run() -> object:
    return Window.partitionBy("run").orderBy("epoch")


def loss_derivatives(history: DataFrame, loss: str = "val_loss") -> DataFrame:
    """Add velocity (0 for the first two epochs) and acceleration, which looks at the three epochs before."""
    w = _per_run()
    nth = F.row_number().over(w)
    back = [F.lag(loss, i).over(w) for i in range(4)]
    return history.withColumns(
        {
            "velocity": F.when(nth > 2, F.col(loss) - back[1]).otherwise(0.0),
            "acceleration": F.when(nth > 3, (back[1] - back[2]) - (back[2] - back[3])).otherwise(0.0),
        }
    )


def plateaus(history: DataFrame, patience: int, threshold: float, loss: str = "val_loss") -> DataFrame:
    """Add plateau: the last patience losses, all there, differ by less than the threshold."""
    w = _per_run().rowsBetween(1 - patience, 0)
    spread = F.max(loss).over(w) - F.min(loss).over(w)
    return history.withColumn("plateau", (F.count(loss).over(w) >= patience) & (spread < threshold))


def phase_transitions(history: DataFrame) -> DataFrame:
    """Rows whose phase differs from the one before; the first row of a run counts."""
    before = F.lag("phase").over(_per_run())
    return history.withColumn("from_phase", before).where(~F.col("phase").eqNullSafe(F.col("from_phase"))).select(
        "run", "epoch", "from_phase", F.col("phase").alias("to_phase"), "val_loss", "mrr"
    )


def phase_summary(history: DataFrame) -> DataFrame:
    """Per run and phase: span, first, last and best loss, improvement, gaps, last rank metric, plateaus, rollbacks."""
    first, last = F.min_by("val_loss", "epoch"), F.max_by("val_loss", "epoch")
    return history.groupBy("run", "phase").agg(
        F.min("epoch").alias("start_epoch"), F.max("epoch").alias("end_epoch"), F.count("*").alias("duration"),
        first.alias("initial_loss"), last.alias("final_loss"), F.min("val_loss").alias("best_loss"),
        F.when(first > 0, (first - last) / first).otherwise(0.0).alias("improvement"),
        F.avg(F.col("val_loss") - F.col("train_loss")).alias("avg_gap"), F.max(F.col("val_loss") - F.col("train_loss")).alias("max_gap"),
        F.max_by("mrr", "epoch").alias("final_mrr"), F.count_if("plateau").alias("n_plateaus"), F.count_if(F.col("action") == "ROLLBACK").alias("n_rollbacks"),
    )


# --- the controller

@dataclass(frozen=True)
class ControllerConfig:
    plateau_patience: int = 5
    plateau_threshold: float = 1e-4
    gap_tolerance: float = 0.5
    min_epochs: tuple[int, ...] = (2, 3, 2, 1)
    mrr_improvement: float = 0.05
    max_rollbacks: int = 3
    cooldown: int = 2
    memory: int = 10  # losses that plateaus are looked for in


@dataclass
class ControllerState:
    """What a run carries from epoch to epoch."""

    phase: int = 0
    epochs: list[int] = field(default_factory=lambda: [0, 0, 0, 0, 0])
    losses: list[float] = field(default_factory=list)
    start_loss: list[float | None] = field(default_factory=lambda: [None] * 5)
    start_mrr: list[float | None] = field(default_factory=lambda: [None] * 5)
    patience: int = 0
    rollbacks: int = 0
    cooldown: int = 0


def controller_step(state: ControllerState, train: float, val: float, mrr: float, cfg: ControllerConfig) -> str:
    """Move a run's state on by one epoch; returns STAY, ADVANCE or ROLLBACK."""
    if state.phase == 4:
        return "STAY"
    p = state.phase
    state.losses = [*state.losses, val][-cfg.memory :]
    if state.start_loss[p] is None:
        state.start_loss[p], state.start_mrr[p] = val, mrr
    state.epochs[p] += 1
    state.cooldown = max(0, state.cooldown - 1)
    if state.epochs[p] < cfg.min_epochs[p]:
        return "STAY"
    if p > 0 and not state.cooldown and state.rollbacks < cfg.max_rollbacks and val - train > cfg.gap_tolerance:
        state.phase -= 1
        state.rollbacks += 1
        state.cooldown, state.patience = cfg.cooldown, 0
        return "ROLLBACK"
    recent = state.losses[-cfg.plateau_patience :]
    flat = len(recent) == cfg.plateau_patience and max(recent) - min(recent) < cfg.plateau_threshold
    state.patience = state.patience + 1 if flat else 0
    if p == 0:
        ready = val < 0.8 * state.start_loss[0]
    elif p == 1 and mrr > 0 and state.start_mrr[1] > 0:
        ready = (mrr - state.start_mrr[1]) / state.start_mrr[1] >= cfg.mrr_improvement
    elif p == 1:
        ready = val < 0.9 * state.start_loss[1]
    else:
        ready = flat  # the least number of epochs is behind already
    if ready:
        state.phase += 1
        state.patience = 0
        return "ADVANCE"
    return "STAY"


REPLAY = "run bigint, epoch bigint, train_loss double, val_loss double, mrr double, phase string, action string, patience int, rollbacks int"


def _epochs(rows: pd.DataFrame, state: ControllerState, cfg: ControllerConfig) -> Iterator[tuple]:
    for r in rows.sort_values("epoch").itertuples():
        before = PHASES[state.phase]
        action = controller_step(state, r.train_loss, r.val_loss, r.mrr, cfg)
        yield r.run, r.epoch, r.train_loss, r.val_loss, r.mrr, before, action, state.patience, state.rollbacks


def controller_replay(history: DataFrame, cfg: ControllerConfig = ControllerConfig()) -> DataFrame:
    """The controller over whole runs (run, epoch, train_loss, val_loss, mrr): phase before and action of every epoch.

    A run's epochs are one group: their number is that of a training run, not of its samples.
    """

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_epochs(rows, ControllerState(), cfg)), columns=[c.split()[0] for c in REPLAY.split(", ")])

    return history.select("run", "epoch", "train_loss", "val_loss", "mrr").groupBy("run").applyInPandas(replay, REPLAY)


def saved(state: ControllerState) -> dict:
    return asdict(state)


def restored(values: dict) -> ControllerState:
    return ControllerState(**values)


def phase_settings(spark) -> DataFrame:
    """Per phase: its sampler and the limits of its filter."""
    rows = [(p, SAMPLERS[i], *x) for i, (p, x) in enumerate(zip(PHASES, [(1, 2.0, False), (4, None, False), (10, None, True), (99, None, True), (99, None, False)]))]
    return spark.createDataFrame(rows, "phase string, sampler string, max_relation int, curvature double, adversarial boolean")
