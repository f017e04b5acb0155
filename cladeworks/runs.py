"""Around a run: what it needs before it starts, which state it goes on from, and the summary that it leaves."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks import config as settings
from cladeworks.jobs import CHANNELS, REQUIRED
from cladeworks.sources import artifacts
from cladeworks.sources.leases import Store

NEEDED = ("taxonomy", "relations", "distances", "training_pairs")
LAST = "last.ckpt"


def token_faults(spark: SparkSession, data: str, channels: dict[str, int] = CHANNELS) -> artifacts.Checked:
    """Whether the token table fits: a missing one is a warning (it will be made), one that is empty, broken or of other lengths is an error."""
    path = f"{data}/tokens"
    if not Store(spark, path).exists(path):
        return artifacts.Checked(warnings=[f"tokens: {path} is not there and will be made"])
    found = artifacts.check_tables(spark, data, {"tokens": [f"{c}_{part}" for c in channels for part in ("ids", "mask")]})
    if not found.valid:
        return found
    rows = spark.read.parquet(path)
    wrong = [F.count_if((F.size(f"{c}_ids") != n) | (F.size(f"{c}_mask") != n)).alias(c) for c, n in channels.items()]
    told = rows.agg(F.count("*").alias("_n"), *wrong).first()
    errors = [] if told["_n"] else ["tokens: no rows"]
    return found.merged(artifacts.Checked(errors + [f"tokens: {told[c]} rows of {c} are not {n} long" for c, n in channels.items() if told[c]]))


def preflight(spark: SparkSession, data: str, changes: tuple[str, ...] = (), settings_path: str | None = None) -> artifacts.Checked:
    """All that would stop a run: settings, tables and their columns, tokens. Every fault is listed, none is raised."""
    out = artifacts.Checked()
    try:
        settings.overridden(settings.load(settings_path), *changes)
    except (OSError, ValueError, TypeError, RuntimeError) as error:
        out = out.merged(artifacts.Checked([f"settings: {error}"]))
    return out.merged(artifacts.check_tables(spark, data, {n: REQUIRED[n] for n in NEEDED})).merged(token_faults(spark, data))


def require(found: artifacts.Checked) -> None:
    """Raise all faults together."""
    if not found.valid:
        raise ValueError("; ".join(found.errors))


@dataclass(frozen=True)
class Checkpoint:
    """The state that a run goes on from: its path, if it is there, and whether it is the same experiment's own."""

    path: str | None = None
    same_experiment: bool = False

    @property
    def exists(self) -> bool:
        return self.path is not None


def resolved(spark: SparkSession, given: str | None, root: str, experiment: str) -> Checkpoint:
    """`last` is the experiment's own last state, anything else a path; none, or one that isn't there, starts afresh."""
    if not given:
        return Checkpoint()
    own = f"{root.rstrip('/')}/{experiment}"
    path = f"{own}/{LAST}" if given.lower() in ("last", LAST) else given
    if not Store(spark, path).exists(path):
        return Checkpoint()
    plain = lambda p: p.removeprefix("file:").replace("//", "/").rstrip("/")
    return Checkpoint(path, plain(path).rpartition("/")[0] == plain(own))


def split_changes(changes: list[str] | None) -> tuple[list[str], list[str]]:
    """Changes of settings like a=b, and those that are none."""
    return [c for c in changes or () if "=" in c], [c for c in changes or () if "=" not in c]


def results(history: DataFrame, epochs: int) -> DataFrame:
    """Per run of a history (run, epoch, train_loss, val_loss, mrr): its best loss and epoch, its last epoch, and whether it stopped early."""
    kept = history.where("val_loss is not null and not isnan(val_loss)")
    return kept.groupBy("run").agg(
        F.min("val_loss").alias("best_loss"), F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.max("epoch").alias("stopped_epoch"),
        (F.max("epoch") + 1 < epochs).alias("early_stopped"), F.max_by("mrr", "epoch").alias("last_mrr"),
    )


def save_summary(spark: SparkSession, folder: str, experiment: str, result: dict, config: settings.Config, metrics: dict | None = None, kinds: tuple[str, ...] = ("json",)) -> dict[str, str]:
    """Write what a run came to, with its settings, as JSON, YAML or both; returns the paths. A summary that is there is replaced."""
    content = {
        "training_run": {"experiment": experiment, "timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"), "completed": True, **{k: result.get(k) for k in ("early_stopped", "stopped_epoch")}},
        "results": {k: v for k, v in result.items() if k not in ("early_stopped", "stopped_epoch")}, "metrics": metrics or {}, "config_snapshot": dataclasses.asdict(config),
    }
    out = {}
    for kind in kinds:
        if kind not in ("json", "yaml"):
            raise ValueError(f"unknown format {kind!r}")
        path = f"{folder.rstrip('/')}/training_summary.{kind}"
        Store(spark, path).written(path, json.dumps(content, indent=2) if kind == "json" else settings._yaml().safe_dump(content, sort_keys=False))
        out[kind] = path
    return out
