"""Operator 13: vector codes by product quantization.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook. In every
round a kd-tree of each codebook goes to the tasks (its size is that of the codebook, whatever the rows), each part looks for its nearest
entry by branch and bound, and tasks give back one sum a used entry, which are whole numbers, so their order doesn't matter. A branch is left
out only where its box is farther than the best entry so far: boxes at the same distance are visited, as they may hold an
equally near entry with a lower index. All points of a batch walk a tree together, each group its nearer child first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 16  # entries of a leaf at most
MOST = 1 << 30  # components must be below this in magnitude after scaling


@dataclass
class Node:
    """A box around entries; a leaf has their indexes, ascending, and the entries themselves."""

    low: np.ndarray
    high: np.ndarray
    near: Node | None = None
    far: Node | None = None
    index: np.ndarray | None = None
    points: np.ndarray | None = None


def kd_tree(points: np.ndarray, index: np.ndarray | None = None) -> Node:
    """The tree of rows of whole numbers, split at the median of the widest dimension."""
    index = np.arange(len(points)) if index is None else index
    own = points[index]
    node = Node(own.min(0), own.max(0))
    wide = int(np.argmax(node.high - node.low))
    if len(index) <= LEAF or node.low[wide] == node.high[wide]:
        node.index = np.sort(index)
        node.points = points[node.index]
        return node
    order = index[np.argsort(own[:, wide], kind="stable")]
    half = len(order) // 2
    node.near, node.far = kd_tree(points, order[:half]), kd_tree(points, order[half:])
    return node


def _to_box(x: np.ndarray, node: Node) -> np.ndarray:
    gap = np.maximum(node.low - x, 0) + np.maximum(x - node.high, 0)
    return (gap * gap).sum(1)


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row of whole numbers; ties go to the lower index."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.index is not None:
            gap = x[rows, None, :] - node.points[None, :, :]
            d = (gap * gap).sum(2)
            at = d.argmin(1)  # the first of equal ones, and indexes ascend
            d, at = d[np.arange(len(rows)), at], node.index[at]
            better = (d < best[rows]) | ((d == best[rows]) & (at < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], at[better]
            return
        to_near, to_far = _to_box(x[rows], node.near), _to_box(x[rows], node.far)
        first = to_near <= to_far
        a, b, bound_a, bound_b = rows[first], rows[~first], to_far[first], to_near[~first]
        visit(node.near, a)
        visit(node.far, b)
        visit(node.far, a[bound_a <= best[a]])
        visit(node.near, b[bound_b <= best[b]])

    visit(tree, np.arange(len(x)))
    return found, best


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as integers; null where the vector takes no part: null, or with a component that is null or not finite."""
    x = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(x, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    big = F.exists(x, lambda x: F.abs(x) >= MOST / scale)
    told = F.raise_error(F.lit(f"components of vectors must be below {MOST} / {scale} in magnitude"))
    return F.when(vector.isNull() | odd, None).when(big, told.cast("array<int>")).otherwise(F.transform(x, lambda x: F.floor(x * scale).cast("int")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as whole numbers, shorter ones filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _checked(q: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    most = max(int(np.abs(q).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in books))
    if q.shape[1] * 4 * most * most >= 1 << 62:
        raise OverflowError("squared distances of these vectors are beyond 64 bits")
    return q


def _update(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: entries become the floored means of their parts, unused ones stay."""
    spark, n = kept.sparkSession, len(books)
    own = width // n
    trees = spark.sparkContext.broadcast([kd_tree(b) for b in books])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(b) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            q = _checked(matrix(batch.column("q"), width), books)
            for p in range(n):
                part = q[:, p * own : (p + 1) * own]
                at, _ = nearest(trees.value[p], part)
                np.add.at(total[p], at, part)
                count[p] += np.bincount(at, minlength=len(count[p]))
        used = [(p, int(e)) for p in range(n) for e in np.nonzero(count[p])[0]]
        columns = [[p for p, _ in used], [e for _, e in used], [int(count[p][e]) for p, e in used], [total[p][e].tolist() for p, e in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

    partial = kept.select("q").mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>")
    # an entry has one row a task, so its list is as long as there are tasks
    zero = F.array_repeat(F.lit(0).cast("bigint"), own)
    added = F.aggregate(F.collect_list("sums"), zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("sums"))
    out = [b.copy() for b in books]
    for row in merged.collect():  # a row an entry at most
        out[row.part][row.entry] = np.array(row.sums, dtype=np.int64) // row.n
    trees.unpersist()
    return out


def compress(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Coded vectors (the id, the label, code, error, label_error) and the codebooks, one array (entry, component) a part.

    Vectors that are null or have a component that is null, NaN or infinite are dropped; the others become floor(scale * x). Codebooks start
    as the parts of the first rows by id (nulls last; then by vector and label), fewer where there are fewer rows, and are refined in rounds. code has two
    hexadecimal digits a part, error is the summed squared distance, label_error its sum over all rows of the same label, nulls together.
    Vectors shorter than the longest one, and a length that the parts don't divide, are filled up with zeros. Repeated rows stay repeated, other columns are left out,
    an empty table stays empty (its codebooks have no entries). Components of 2^30 / scale or more in magnitude are an error.
    """
    q = df.select(F.col(id).alias("id"), F.col(label).alias("label"), whole_numbers(F.col(vector), scale).alias("q")).where("q is not null")
    kept = cut(q, "codes-kept")
    longest = kept.agg(F.max(F.size("q"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    own = width // parts
    rows = kept.orderBy(F.asc_nulls_last("id"), "q", F.asc_nulls_last("label")).limit(entries).select("q").collect()  # the first codebooks
    start = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        start[i, : len(r.q)] = r.q
    books = [start[:, p * own : (p + 1) * own].copy() for p in range(parts)]
    if rows:
        for _ in range(rounds):
            books = _update(kept, books, width)
    trees = df.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books] if rows else [])

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _checked(matrix(batch.column("q"), width), books)
            found = [nearest(trees.value[p], q[:, p * own : (p + 1) * own]) for p in range(parts)]
            text = ["".join(f"{e:02x}" for e in row) for row in zip(*(at.tolist() for at, _ in found))]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = cut(kept.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"), "codes")
    # summed by the tasks before it is shuffled: a row a label and task; labels may be as many as rows, so Spark chooses the join
    per = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(per, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out.withColumnsRenamed({"id": id, "label": label}), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decoded(code: Column, books: list[np.ndarray]) -> Column:
    """The vector that a code stands for, in whole numbers."""
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*[F.element_at(t, at(p) + 1) for p, t in enumerate(tables)])
