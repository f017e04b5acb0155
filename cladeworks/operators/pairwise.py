"""All pairs and nearest neighbours of vectors.

Every metric here is a function of one inner product: rows of both sides are encoded so that a greater product means
nearer, and a tile (see tiles.py) is matrix products. Nearest neighbours look at products in single precision
first; only pairs that may be among the k best, by a bound on its error, are computed in double precision, and each row keeps k.

Where the metric obeys the triangle inequality, strips are cells around pivots with stored radii. Rows first search the strip of their nearest
pivot; the k-th distance found there rules out strips that lie farther away than that, and all that is not better in the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators import tiles
from cladeworks.sources.stages import staged

METRICS = ("euclidean", "cosine", "lorentz", "dot", "cosine_similarity", "divergence")
TRIANGLE = ("euclidean", "lorentz")  # metrics whose bounds leave strips out
FLOOR = 1e-8  # added to every probability before a divergence
PIECE = 1 << 22  # products that are computed together
ROW_PAIRS = 1 << 18  # pairs of a tile that gives them back as rows: few, as later steps are as parallel as this one
OUT_ROWS = 1 << 17  # rows of a batch that leaves a task
BLOCK = 1 << 12  # rows of a strip whose nearest are merged, or whose squares are summed, together
EXACT_ROWS = 1 << 13  # pairs whose vectors are laid side by side for their exact values
PIVOTS = 256  # cells at most
SAMPLED = 16  # rows that are looked at for each pivot
OFF = 1e-6  # how far off the hyperboloid, for its size, a vector may be for the triangle inequality to be relied on


def _lists(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The vectors of rows as doubles, whichever way they travel (see travelling)."""
    if "tail" not in rows.schema.names:
        return _lists(rows.column("v"), rows.num_rows)
    return np.hstack([rows.column("head").to_numpy()[:, None], _lists(rows.column("tail"), rows.num_rows)]).astype(float, copy=False)


class Encoded:
    """Rows of one side: ids, groups, vectors, and what their metric needs."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, metric: str, left: bool):
        self.ids = rows.column("id").to_numpy()
        self.v = matrix(rows)
        self.product, self.half = encoded(self.v, metric, left)
        if metric == "euclidean":  # the vectors are a part of what is multiplied, and held once
            self.v = self.product[:, : self.v.shape[1]]
        group = rows.column("apart")
        self.grouped = group.is_valid().to_numpy(zero_copy_only=False) if isinstance(group, pa.Array) else group.is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        self.group = group.fill_null(0).to_numpy()

    def label(self) -> np.ndarray:
        """The groups as numbers, null as NaN."""
        return np.where(self.grouped, self.group.astype(float), np.nan)


def by_rows(of: Callable[[np.ndarray], np.ndarray], v: np.ndarray) -> np.ndarray:
    """A number for each row, some rows at a time, so that no copy of all of them is made."""
    return np.concatenate([of(v[i : i + BLOCK]) for i in range(0, max(1, len(v)), BLOCK)])


def encoded(v: np.ndarray, metric: str, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose inner products are greater the nearer they are, and per row what a distance is made of besides."""
    none = np.zeros(len(v))
    if metric == "lorentz":
        return (np.hstack([-v[:, :1], v[:, 1:]]) if left else v), none
    if metric == "dot":
        return v, none
    if metric == "euclidean":
        half = by_rows(lambda x: (x * x).sum(1), v) / 2
        return (np.hstack([v, np.ones((len(v), 1))]) if left else np.hstack([v, -half[:, None]])), half
    if metric == "divergence":
        p = (v + FLOOR) / (v + FLOOR).sum(1, keepdims=True)
        return (p, (p * np.log(p)).sum(1)) if left else (np.log(p), none)
    if metric in ("cosine", "cosine_similarity"):
        return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None], none
    raise ValueError(f"unknown metric {metric!r}, not one of {METRICS}")


def _values(a: Encoded, b: Encoded, i: np.ndarray | slice, j: np.ndarray | slice, product: np.ndarray, metric: str, least: float, c: float) -> np.ndarray:
    """Distances or similarities of pairs with their products; lorentz holds the negative product at least as large as given and scales by the root of c."""
    if metric == "lorentz":
        return np.arccosh(np.maximum(-product, least)) * math.sqrt(c)
    if metric == "euclidean":
        gap = a.v[i] - b.v[j]
        return np.sqrt((gap * gap).sum(-1))
    if metric == "divergence":
        return a.half[i] - product
    return 1 - product if metric == "cosine" else product


def distances(a: np.ndarray, b: np.ndarray, metric: str, least: float = 1 + 1e-5, c: float = 1.0) -> np.ndarray:
    """Matrix of distances or similarities of two sets of vectors."""
    (pa_, ha), (pb, hb) = encoded(a, metric, True), encoded(b, metric, False)
    product = pa_ @ pb.T
    if metric == "lorentz":
        return np.arccosh(np.maximum(-product, least)) * math.sqrt(c)
    if metric == "euclidean":
        return np.sqrt(np.maximum(2 * (ha[:, None] - product), 0))
    if metric == "divergence":
        return ha[:, None] - product
    return 1 - product if metric == "cosine" else product


def _rows(df: DataFrame, vector: str, apart: str | None = None) -> DataFrame:
    group = F.lit(None) if apart is None else F.col(apart)
    return df.select("id", F.col(vector).alias("v"), group.cast("bigint").alias("apart"))


def _halves(rows: DataFrame) -> bool:
    """Whether all entries but the first are single-precision numbers, as those of stored embeddings and of points lifted from them are."""
    exact = (F.size("v") > 0) & (_tail().cast("array<double>") == F.slice("v", F.lit(2), F.size("v") - 1))
    return rows.where(~F.coalesce(exact, F.lit(False))).isEmpty()


def _tail() -> Column:
    return F.slice("v", F.lit(2), F.size("v") - 1).cast("array<float>")


def travelling(rows: DataFrame, halves: bool) -> tuple[DataFrame, list[str], str]:
    """Rows with their vectors as they are shuffled, the columns of these and their types: single precision in half the bytes, where nothing is lost."""
    if not halves:
        return rows, ["v"], "v array<double>"
    return rows.select("id", F.when(F.size("v") > 0, F.col("v")[0]).alias("head"), F.when(F.size("v") > 0, _tail()).alias("tail"), "apart"), ["head", "tail"], "head double, tail array<float>"


def _size(rows: DataFrame) -> tuple[int, int]:
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return n, width or 1


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pair_tiles(df: DataFrame, vector: str, both_ways: bool, apart: str | None = None, pairs: int = ROW_PAIRS) -> DataFrame:
    """The tiles of a table against itself, each pair once or both ways; tile // n_strips is the left strip, tile % n_strips the right one."""
    rows = staged(_rows(df, vector, apart), "pair-rows")
    n, width = _size(rows)
    g = max(tiles.strips(n, n, width, 4 * _tasks(df), pairs))
    moved, vec, _ = travelling(rows, _halves(rows))
    placed = moved.withColumn("strip", tiles.strip_of("id", g))
    others = lambda low, high: F.explode(F.sequence(low, high))
    first, last = (F.lit(0), F.lit(g - 1))
    left = placed.withColumn("other", others(first if both_ways else F.col("strip"), last)).select((F.col("strip") * g + F.col("other")).alias("tile"), "id", *vec, "apart")
    right = placed.withColumn("other", others(first, last if both_ways else F.col("strip"))).select((F.col("other") * g + F.col("strip")).alias("tile"), "id", *vec, "apart")
    return tiles.dealt(left, right, g * g).withColumn("same", (F.floor(F.col("tile") / g) == F.col("tile") % g))


def each_block(batches: Iterable[pa.RecordBatch], metric: str, both_ways: bool, least: float, c: float) -> Iterator[tuple[Encoded, Encoded, np.ndarray, np.ndarray] | None]:
    """(left rows, some right rows, values, which pairs count) of tiles in turn; None at the end of each tile."""
    for strip, some in tiles.by_tile(batches, lambda t: Encoded(t, metric, True), lambda s: PIECE // max(1, len(s.ids))):
        if some is None:
            yield None
            continue
        b = Encoded(some, metric, False)
        product = strip.product @ b.product.T
        if metric == "euclidean":
            value = np.sqrt(np.maximum(2 * (strip.half[:, None] - product), 0))
        else:
            value = _values(strip, b, np.arange(len(strip.ids))[:, None], slice(None), product, metric, least, c)
        counts = strip.ids[:, None] != b.ids[None, :] if both_ways or not some.column("same")[0].as_py() else strip.ids[:, None] < b.ids[None, :]
        yield strip, b, value, counts


def all_pairs(
    df: DataFrame, metric: str, vector: str = "v", both_ways: bool = False, least: float = 1 + 1e-5, c: float = 1.0,
    label: str | None = None, tree: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(id_i, id_j, value) for id_i < id_j, or for all id_i <> id_j; with tree also t, a function of the two integer labels (null as NaN)."""
    names = ["id_i", "id_j", "value", *(["t"] if tree else [])]

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches, metric, both_ways, least, c):
            if block is None:
                continue
            a, b, value, counts = block
            la, lb = a.label(), b.label()
            i, j = np.nonzero(counts)
            for begin in range(0, len(i), OUT_ROWS):
                x, y = i[begin : begin + OUT_ROWS], j[begin : begin + OUT_ROWS]
                left, right = a.ids[x], b.ids[y]
                t = [pa.array(np.asarray(tree(la[x], lb[y]), dtype=float))] if tree else []
                if not both_ways:
                    left, right = np.minimum(left, right), np.maximum(left, right)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(value[x, y]), *t], names)

    return pair_tiles(df, vector, both_ways, label).mapInArrow(compute, "id_i bigint, id_j bigint, value double" + ", t double" * bool(tree))


class _Best:
    """The k best of each row of a strip so far: rows, ids, values and what goes with them, and the k-th value.

    What is new waits until it is as much as what is kept, and is merged some rows at a time, so that little is held besides these two.
    """

    def __init__(self, a: Encoded, reached: np.ndarray, k: int, largest: bool, inside: bool | None):
        self.a, self.k, self.largest, self.reached, self.inside = a, k, largest, reached, inside
        self.kept, self.new, self.n_new = None, [], 0

    def add(self, row: np.ndarray, *columns: np.ndarray) -> None:
        if not len(row):
            return
        self.new.append((row.astype(np.int32), *columns))
        self.n_new += len(row)
        if self.n_new > max(1 << 16, len(self.kept[0]) if self.kept else 0):
            self.merge()

    def merge(self) -> None:
        """Both kept and new are in the order of their rows then, and a block of rows is merged for itself."""
        if not self.new:
            return
        new = [np.concatenate(x) for x in zip(*self.new)]
        order = np.argsort(new[0], kind="stable")
        new = [x[order] for x in new]
        old, self.kept, self.new, self.n_new = self.kept or [x[:0] for x in new], None, [], 0
        bounds = np.append(np.arange(0, len(self.a.ids), BLOCK), len(self.a.ids)).astype(np.int32)
        at_old, at_new = np.searchsorted(old[0], bounds), np.searchsorted(new[0], bounds)
        merged = [self._merged([np.concatenate((x[at_old[i] : at_old[i + 1]], y[at_new[i] : at_new[i + 1]])) for x, y in zip(old, new)]) for i in range(len(bounds) - 1)]
        self.kept = [np.concatenate(x) for x in zip(*merged)]

    def _merged(self, both: list[np.ndarray]) -> list[np.ndarray]:
        row, ids, value = both[:3]
        order = np.lexsort((ids, -value if self.largest else value, row))
        row, value = row[order], value[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        full = nth == self.k - 1
        better = np.maximum if self.largest else np.minimum
        self.reached[row[full]] = better(self.reached[row[full]], value[full])
        return [x[order[nth < self.k]] for x in both]


def _threshold(a: Encoded, reached: np.ndarray, metric: str, least: float, c: float) -> np.ndarray:
    """The product from which on a pair can be as near as reached, per row; minus infinity where nothing is reached."""
    with np.errstate(over="ignore", invalid="ignore"):
        if metric == "lorentz":
            out = -np.maximum(np.cosh(reached / math.sqrt(c)), least)
        elif metric == "euclidean":
            out = a.half - reached * reached / 2
        elif metric == "divergence":
            out = a.half - reached
        else:
            out = 1 - reached if metric == "cosine" else reached
    return np.where(np.isfinite(reached), out, -np.inf)


def _search(
    batches: Iterable[pa.RecordBatch], wants: list[tuple[int, bool | None]], metric: str, largest: bool, least: float, c: float,
    beside: Callable[[np.ndarray, np.ndarray], np.ndarray] | None,
) -> Iterator[pa.RecordBatch]:
    none = -np.inf if largest else np.inf
    names = ["id_i", "id_j", "value", *(["beside"] if beside else [])]

    def opened(rows: pa.Table) -> tuple:
        a = Encoded(rows, metric, True)
        reached = _lists(rows.column("reached"), rows.num_rows).astype(float)
        reached = np.where(np.isnan(reached), none, reached)
        best = [_Best(a, reached[:, i].copy(), k, largest, inside) for i, (k, inside) in enumerate(wants)]
        return a, best, a.product.astype(np.float32), by_rows(lambda x: np.linalg.norm(x, axis=1), a.product)

    for (a, bests, single, norms), some in tiles.by_tile(batches, opened, lambda s: PIECE // max(1, len(s[0].ids))):
        if some is None:
            for want, best in enumerate(bests):
                best.merge()
                row, *kept = best.kept or (np.empty(0, dtype=np.int32),)
                best.kept = None
                for begin in range(0, len(row), OUT_ROWS):
                    end = begin + OUT_ROWS
                    columns = [pa.array(a.ids[row[begin:end]]), *[pa.array(x[begin:end]) for x in kept]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), want, dtype=np.int32))], [*names, "want"])
            continue
        b = Encoded(some, metric, False)
        with np.errstate(over="ignore", invalid="ignore"):
            near = single @ b.product.astype(np.float32).T
        # what single precision, and the rounding of distances, may be off by
        slack = (1e-6 * (b.product.shape[1] + 16)) * (norms * np.linalg.norm(b.product, axis=1).max(initial=0) + np.abs(a.half)) + 1e-12
        for best in bests:
            k, inside = best.k, best.inside
            good = near >= (_threshold(a, best.reached, metric, least, c) - slack)[:, None]
            many = np.count_nonzero(good)
            if inside is not None and many > good.size >> 5:  # where few are left, their groups are looked at one by one
                together = (a.group[:, None] == b.group[None, :]) & a.grouped[:, None] & b.grouped[None, :]
                good &= together if inside else ~together
                many, inside = np.count_nonzero(good), None
            if len(b.ids) > k + 1 and many > 2 * (k + 1) * len(a.ids):  # early on, when little is ruled out: the best of this piece
                if inside is not None:
                    together = (a.group[:, None] == b.group[None, :]) & a.grouped[:, None] & b.grouped[None, :]
                    good &= together if inside else ~together
                    inside = None
                held = np.where(good, near, -np.inf)
                good &= held >= (np.partition(held, len(b.ids) - k - 1, axis=1)[:, len(b.ids) - k - 1] - 2 * slack)[:, None]
                if metric == "lorentz":  # products that are held at the least are equally near
                    good |= (near >= -least - slack[:, None]) & (held > -np.inf)
            i, j = np.nonzero(good)
            other = a.ids[i] != b.ids[j]
            if inside is not None:
                together = (a.group[i] == b.group[j]) & a.grouped[i] & b.grouped[j]
                other &= together if inside else ~together
            i, j = i[other], j[other]
            for begin in range(0, len(i), EXACT_ROWS):
                x, y = i[begin : begin + EXACT_ROWS], j[begin : begin + EXACT_ROWS]
                value = _values(a, b, x, y, np.einsum("nd,nd->n", a.product[x], b.product[y]), metric, least, c)
                kept = np.isfinite(value) & (value >= best.reached[x] if largest else value <= best.reached[x])
                x, y = x[kept], y[kept]
                best.add(x, b.ids[y], value[kept], *([beside(a.v[x], b.v[y])] if beside else []))


def nearest(
    df: DataFrame, k: int, metric: str, others: DataFrame | None = None, vector: str = "v", largest: bool = False, least: float = 1 + 1e-5,
    apart: str | None = None, inside: bool = False, c: float = 1.0, beside: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(id_i, id_j, value, nth) of the k nearest other ids of each id, ties by id; largest for similarities.

    With apart, an integer column, only ids of another group count: those of the same one are left out before the k are taken.
    With inside as well, only ids of the same group count; a null group holds nothing.
    With beside there is a column of that name: its number for each pair, from the rows of both sides' vectors, so that these need no join.
    """
    return _nearest(df, [(k, inside if apart is not None else None)], metric, others, vector, largest, least, apart, c, beside).drop("want")


def nearest_in_and_out(df: DataFrame, k_in: int, k_out: int, metric: str, apart: str, vector: str = "v", least: float = 1 + 1e-5) -> DataFrame:
    """(id_i, id_j, value, inside, nth): of each id the k_in nearest others of its group and the k_out nearest of other groups, as nearest() has them, by one search.

    The rows of an id lie in one partition.
    """
    return _nearest(df, [(k_in, True), (k_out, False)], metric, None, vector, False, least, apart, 1.0, None).select("id_i", "id_j", "value", (F.col("want") == 0).alias("inside"), "nth")


def _nearest(
    df: DataFrame, wants: list[tuple[int, bool | None]], metric: str, others: DataFrame | None, vector: str, largest: bool, least: float, apart: str | None, c: float,
    beside: Callable[[np.ndarray, np.ndarray], np.ndarray] | None,
) -> DataFrame:
    spark = df.sparkSession
    a = _rows(df, vector, apart)
    b = a if others is None else _rows(others, vector, apart)
    a = staged(a, "near-left")
    b = a if others is None else staged(b, "near-right")
    (n_a, width), (n_b, _) = _size(a), _size(b)
    g_a, g_b = tiles.strips(n_a, n_b, width, _tasks(df))
    if others is None:
        g_a = g_b = max(g_a, g_b)
    halves = _halves(a) and (others is None or _halves(b))
    moved_b, vec, vec_type = travelling(b, halves)
    moved_a = moved_b if others is None else travelling(a, halves)[0]
    found = "id_i bigint, id_j bigint, value double" + ", beside double" * bool(beside) + ", want int"

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, wants, metric, largest, least, c, beside)

    def tiled(left: DataFrame, right: DataFrame) -> DataFrame:
        """left has (strip, other) and reached, right (other, strip): a row for each tile that it is in."""
        columns = ["id", *vec, "apart", "reached"]
        tile = (F.col("strip") * width_b + F.col("other")).cast("int").alias("tile")
        return tiles.dealt(left.select(tile, *columns), right.withColumn("reached", F.lit(None).cast("array<double>")).select(tile, *columns), n_strips * width_b).mapInArrow(search, found)

    order = F.desc("value") if largest else F.asc("value")
    of_want = F.element_at(F.array(*[F.lit(k) for k, _ in wants]), F.col("want") + 1)

    def ranked(rows: DataFrame) -> DataFrame:
        placed = rows.repartition("id_i") if len(wants) > 1 else rows
        by = ["id_i"] if len(wants) == 1 else ["id_i", "want"]
        return placed.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(order, "id_j"))).where(F.col("nth") <= of_want)

    bare = F.array(*[F.lit(None).cast("double") for _ in wants]).alias("reached")
    if g_a * g_b == 1:
        n_strips, width_b = 1, 1
        one = {"strip": F.lit(0), "other": F.lit(0)}
        return ranked(tiled(moved_a.withColumns(one).withColumn("reached", bare), moved_b.withColumns(one)))
    bounded = metric in TRIANGLE and (metric != "lorentz" or (_on_manifold(a) and (others is None or _on_manifold(b))))
    cells = _Cells(b, metric, g_b, n_b, c) if bounded else None
    if bounded:
        own_b = cells.placed(moved_b, vec, vec_type)
        own_a = own_b if others is None else cells.placed(moved_a, vec, vec_type)
        n_right = cells.n_strips
    else:
        own_b = moved_b.withColumns({"strip": tiles.strip_of("id", g_b), "cell": F.lit(0), "far": F.lit(0.0)})
        own_a = own_b if others is None else moved_a.withColumns({"strip": tiles.strip_of("id", g_b), "cell": F.lit(0), "far": F.lit(0.0)})
        n_right = g_b
    own_b = staged(own_b, "near-right-placed")
    own_a = own_b if others is None else staged(own_a, "near-left-placed")
    # the left's rows lie in blocks that fit; those that look at the same strip first lie together
    blocks = 1
    if others is not None:
        fullest = own_a.groupBy("strip").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        blocks = max(1, math.ceil(fullest * width * 8 / tiles.STRIP_BYTES))
    n_strips, width_b = n_right * blocks, n_right
    block = (F.col("strip") * blocks + F.pmod(F.xxhash64("id"), F.lit(blocks))).cast("int")
    left = own_a.withColumns({"lead": F.col("strip"), "strip": block})
    # of each strip of the right, the blocks that look at it first; in the second pass all of them
    shared = lambda which: own_b.withColumn("other", F.col("strip")).withColumn("strip", F.explode(which)).select("strip", "other", "id", *vec, "apart")
    every = F.sequence(F.lit(0), F.lit(n_strips - 1))
    leads = lambda s: F.floor(s / blocks).cast("int")
    first = staged(ranked(tiled(left.select("strip", F.col("lead").alias("other"), "id", *vec, "apart", bare), shared(F.filter(every, lambda s: leads(s) == F.col("strip"))))), "near-first")
    kth = first.where(F.col("nth") == of_want).groupBy(F.col("id_i").alias("id")).agg(F.array(*[F.max(F.when(F.col("want") == i, F.col("value"))) for i in range(len(wants))]).alias("reached"))
    known = left.join(kth, "id", "left").select("strip", "lead", "id", *vec, "apart", F.coalesce("reached", bare).alias("reached"), "cell", "far")
    if bounded:  # a row with the strips that it looks into is written, and not one for each of them
        rest = staged(cells.visits(known, vec, vec_type), "near-visits").withColumn("other", F.explode("others"))
        # tiles that no row looks into are not shipped
        asked = rest.groupBy("other").agg(F.array_sort(F.collect_set("strip")).alias("asked"))
        right = own_b.withColumnRenamed("strip", "other").join(asked, "other").select(F.explode("asked").alias("strip"), "other", "id", *vec, "apart")
    else:
        rest = known.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_right - 1)), lambda s: s != F.col("lead"))))
        right = shared(F.filter(every, lambda s: leads(s) != F.col("strip")))
    return ranked(first.drop("nth").unionByName(tiled(rest, right)))


def _on_manifold(rows: DataFrame) -> bool:
    """Whether all vectors lie on the hyperboloid, so that their distances obey the triangle inequality."""
    x = F.col("v")
    norm = F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)
    off = F.abs(2 * x[0] * x[0] - norm - 1) / F.greatest(norm, F.lit(1.0))
    return (rows.agg(F.max(F.coalesce(off, F.lit(1.0)))).first()[0] or 0.0) < OFF


class _Cells:
    """Cells around pivots: rows go to the nearest pivot's cell, cells are packed into strips, a very large one is cut into several.

    Per cell there are the greatest distance to its pivot and its strips: PIVOTS rows at most, which tasks get as arrays.
    """

    def __init__(self, b: DataFrame, metric: str, g: int, n: int, c: float):
        self.metric, self.c = metric, c
        wanted = min(PIVOTS, max(2, 4 * g))
        rows = b.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(SAMPLED * wanted).select("v").collect()  # SAMPLED * PIVOTS at most
        sample = np.array([list(r.v) for r in rows])
        # each next pivot is the row of the sample farthest from those so far, so cells are small
        chosen, gap = [0], distances(sample, sample[:1], metric, 1.0, c)[:, 0]
        while len(chosen) < min(wanted, len(sample)):
            chosen.append(int(np.nan_to_num(gap, nan=-1.0).argmax()))
            gap = np.minimum(gap, distances(sample, sample[chosen[-1:]], metric, 1.0, c)[:, 0])
        pivots = sample[chosen]
        between = distances(pivots, pivots, metric, 1.0, c)
        chain, left = [0], set(range(1, len(pivots)))
        while left:  # neighbours in the chain are near each other, so they share strips
            step = min(left, key=lambda p: (between[chain[-1], p], p))
            chain.append(step)
            left.remove(step)
        self.pivots = pivots[chain]
        assigned = self._assigned(b, ["v"], "v array<double>")
        stats = {r.cell: (r.n, r.far) for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a cell
        most = math.ceil(n / g)
        self.first, self.copies, self.far = [], [], []
        strip, filled = 0, 0
        for cell in range(len(self.pivots)):
            count, far = stats.get(cell, (0, -1.0))
            own = max(1, math.ceil(count / most))
            if own > 1 or filled + count > most:
                strip, filled = strip + (filled > 0), 0
            self.first.append(strip)
            self.copies.append(own)
            self.far.append(far)
            strip, filled = (strip + own, 0) if own > 1 else (strip, filled + count)
        self.n_strips = strip + (filled > 0) or 1

    def _assigned(self, rows: DataFrame, vec: list[str], vec_type: str) -> DataFrame:
        pivots, metric, c = self.pivots, self.metric, self.c
        names = ["id", *vec, "apart"]

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = np.nan_to_num(distances(matrix(batch), pivots, metric, 1.0, c), nan=np.inf)
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*names, "cell", "far"])

        return rows.select(*names).mapInArrow(assign, f"id bigint, {vec_type}, apart bigint, cell int, far double")

    def placed(self, rows: DataFrame, vec: list[str], vec_type: str) -> DataFrame:
        """Rows with the strip of their cell."""
        of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
        return self._assigned(rows, vec, vec_type).withColumn("strip", (of(self.first) + F.pmod(F.xxhash64("id"), of(self.copies))).cast("int"))

    def visits(self, known: DataFrame, vec: list[str], vec_type: str) -> DataFrame:
        """Rows with others, the strips besides the lead that may hold something as near as reached: pivot's distance less the cell's radius."""
        pivots, metric, n_strips, c = self.pivots, self.metric, self.n_strips, self.c
        first, copies, far = np.array(self.first), np.array(self.copies), np.array(self.far)
        strip_cell = np.repeat(np.arange(len(first)), copies)
        strip = np.repeat(first, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        names = ["strip", "lead", "id", *vec, "apart", "reached"]

        def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = distances(matrix(batch), pivots, metric, 1.0, c)
                reached = _lists(batch.column("reached"), batch.num_rows).astype(float)
                reached = np.where(np.isnan(reached), np.inf, reached).max(1)  # of all that is wanted
                slack = 1e-4 + 1e-6 * np.abs(d)
                may = ~(d - far[None, :] - slack > reached[:, None]) & (far >= 0)[None, :]
                to = np.zeros((len(d), n_strips), dtype=bool)
                for cell, s in zip(strip_cell, strip):
                    to[:, s] |= may[:, cell]
                to[np.arange(len(d)), batch.column("lead").to_numpy()] = False
                others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(to.sum(1))), pa.int32()), pa.array(np.nonzero(to)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], others], [*names, "others"])

        return known.select(*names).mapInArrow(visit, f"strip int, lead int, id bigint, {vec_type}, apart bigint, reached array<double>, others array<int>")
