"""Curvature by phase, and points kept on the hyperboloid of that curvature, counted in the pass that keeps them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V

TOLERANCE = 1e-4  # how far <x, x> may be from -1/c


@dataclass(frozen=True)
class Curvature:
    """The curvature of a run: a fixed one in phase 1, the learned one held within limits after that."""

    learned: float = 1.0
    phase: int = 1
    first: float = 2.0
    least: float = 0.1
    most: float = 10.0

    @property
    def c(self) -> float:
        return self.first if self.phase <= 1 else min(max(self.learned, self.least), self.most)

    @property
    def learns(self) -> bool:
        return self.phase > 1

    def at(self, phase: int) -> Curvature:
        return replace(self, phase=phase)

    def moved(self, by: float) -> Curvature:
        """After a step of learning, which the first phase doesn't take; what is learned may leave the limits, c doesn't."""
        return replace(self, learned=self.learned + by) if self.learns else self

    def saved(self) -> dict:
        return asdict(self)

    @classmethod
    def restored(cls, values: dict) -> Curvature:
        return cls(**values)


class Manifold:
    """Operations at one curvature; points that it makes or is given can be checked and brought back."""

    def __init__(self, curvature: Curvature, project: bool = True, tolerance: float = TOLERANCE):
        self.curvature, self.project, self.tolerance = curvature, project, tolerance

    @property
    def c(self) -> float:
        return self.curvature.c

    def to_points(self, tangent: Column) -> Column:
        return V.exp_zero(tangent, self.c)

    def to_tangent(self, points: Column) -> Column:
        return V.log_zero(points, self.c)

    def distance(self, x: Column, y: Column) -> Column:
        return V.lorentz_distance(x, y, self.c)

    def off(self, x: Column) -> Column:
        return V.off_manifold(x, self.c)

    def kept(self, df: DataFrame, column: str, name: str = "manifold") -> tuple[DataFrame, Observation]:
        """The rows with their points on the hyperboloid (or as they are, if they aren't to be projected), and what the first action over them counts.

        The observation has points, violations (points off by more than the tolerance), projected and worst (the greatest distance off); null points are none.
        It costs no pass of its own. If rows are read several times, the counts are those of the first.
        """
        seen = Observation(name)
        off = self.off(F.col(column))
        wrong = F.coalesce(off > self.tolerance, F.lit(False)) | F.isnan(off)
        counted = df.observe(
            seen, F.count(column).alias("points"), F.count_if(wrong).alias("violations"), (F.count_if(wrong) if self.project else F.lit(0).cast("bigint")).alias("projected"), F.max(off).alias("worst")
        )
        if not self.project:
            return counted, seen
        return counted.withColumn(column, F.when(wrong, V.lift(V.space(F.col(column)), self.c)).otherwise(F.col(column))), seen

    def diagnostics(self, seen: Observation) -> dict:
        """What was counted, with the curvature and its phase; waits for the first action."""
        return {"curvature": self.c, "phase": self.curvature.phase, "learns": self.curvature.learns, **seen.get}
