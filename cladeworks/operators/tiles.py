"""Rows of two sides compared tile by tile.

Both sides are cut into strips; a tile is a strip of the left against a strip of the right and one task. With g strips a side a row
travels 2 * g times, twice the root of the number of tiles, and not once for each block of rows. A task keeps the strip of the left and streams that of the
right past it, so it holds one strip, whatever it gives back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Any, Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP_BYTES = 32 << 20  # a strip of the left at most, as doubles
TILE_PAIRS = 1 << 26  # pairs that make a tile of their own worth while
LEFT, RIGHT = 0, 1


def strips(n_left: int, n_right: int, width: int, tasks: int, pairs: int | None = None) -> tuple[int, int]:
    """How many strips each side gets: as many tiles as there are tasks if there is work for them (pairs a tile), strips that fit, rows shipped least."""
    n_left, n_right = max(1, n_left), max(1, n_right)
    tiles = max(1, min(tasks, math.ceil(n_left * n_right / min(pairs or TILE_PAIRS, TILE_PAIRS))))
    most = max(1, STRIP_BYTES // (8 * max(1, width)))
    left = max(math.ceil(n_left / most), min(n_left, round(math.sqrt(tiles * n_left / n_right)) or 1))
    return left, max(math.ceil(n_right / most), min(n_right, math.ceil(tiles / left)))


def strip_of(key: Column | str, n: int) -> Column:
    """The strip of a row, by a hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def dealt(left: DataFrame, right: DataFrame, n_tiles: int, order: str = "id") -> DataFrame:
    """Rows (tile: int below n_tiles, the same other columns in both) as a partition for each tile: the left's first, each side by order."""
    both = left.withColumn("side", F.lit(LEFT)).unionByName(right.withColumn("side", F.lit(RIGHT)))
    return both.repartitionById(n_tiles, "tile").sortWithinPartitions("tile", "side", order)


def by_tile(batches: Iterable[pa.RecordBatch], opened: Callable[[pa.Table], Any], most_rows: Callable[[Any], int]) -> Iterator[tuple[Any, pa.RecordBatch | None]]:
    """(opened(left strip), some rows of the right) for each tile, most_rows at a time, then (opened, None) once. Tiles without a left or a right are left out."""
    tile, held, strip, met = None, [], None, False
    for batch in batches:
        tiles, sides = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
        at = 0
        while at < batch.num_rows:
            end = at + 1
            if tiles[at] == tiles[-1] and sides[at] == sides[-1]:  # sorted, so all that is left is one run
                end = batch.num_rows
            else:
                while end < batch.num_rows and tiles[end] == tiles[at] and sides[end] == sides[at]:
                    end += 1
            if tiles[at] != tile:
                if met:
                    yield strip, None
                tile, held, strip, met = tiles[at], [], None, False
            run = batch.slice(at, end - at)
            if sides[at] == LEFT:
                held.append(run)
            elif held or strip is not None:
                if strip is None:
                    strip, held = opened(pa.Table.from_batches(held)), []
                met = True
                step = max(1, most_rows(strip))
                for begin in range(0, run.num_rows, step):
                    yield strip, run.slice(begin, step)
            at = end
    if met:
        yield strip, None
