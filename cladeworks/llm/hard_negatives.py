"""Operator 12: hard-negative mining over k-means inverted lists.

Vectors become whole numbers. Centroids are fitted on a bounded sample; every row goes into the list of its nearest centroid, and each list
is cut into rings by the distance to it. A ring stores its least and greatest distance, so by Cauchy-Schwarz a query's
product with any row of it lies within |query| times that radius of its product with the centroid. A search visits rings by the upper bound, leaves out
those whose bounds miss the window of scores that is asked for, and ends where the bound is strictly below the k-th score so far (an equal
bound may hold an equal score with a smaller id).

Lists are packed into strips of bounded size, a very large ring into several, and queries into blocks. A task searches one strip for one block, so
it holds a strip, a block and the best rows so far; it gives back k rows a query and window at most. The first pass visits the strips of a query's most
promising ring, the second those that the scores of the first don't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.llm.common import cut
from cladeworks.llm.vector_codes import matrix, whole_numbers

SCALE = 256
SAMPLE = 20_000  # rows that centroids are fitted on, at most about that many
MOST_LISTS, LIST_ROWS = 512, 2_000  # lists at most, and rows of one aimed at
RINGS = 4
STRIP_ROWS = 32_768  # rows of a strip, about
BLOCK_QUERIES = 2_048  # queries of a block, about
LLOYD_ROUNDS = 8
FAR = np.int64(1) << 62


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: by floating point where every sum is exact, else by integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 62:
        raise OverflowError("inner products of these vectors are beyond 64 bits")
    return a @ b.T


def fitted_centroids(sample: np.ndarray, k: int, seed: int = 12) -> np.ndarray:
    """Centroids of a sample by k-means; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float64)
    centres = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
    for _ in range(LLOYD_ROUNDS):
        at = _nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class Index:
    """Lists in strips: a table (strip, ring, id, label, q), and per ring its centroid, radii, first strip and number of strips (bounded arrays)."""

    def __init__(self, rows: DataFrame, width: int, centres: np.ndarray, rings: dict[str, np.ndarray]):
        self.rows, self.width, self.centres, self.rings = rows, width, centres, rings


def prepared(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, q) of the rows that take part: label and vector not null, all components finite, an id; q is floor(256 * x).

    An id counts once: of rows that share one, that with the least label, then the least q.
    """
    q = df.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole_numbers(F.col(vector), SCALE).alias("q"))
    return q.where("id is not null and label is not null and q is not null").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def build(rows: DataFrame, sample: int = SAMPLE, strip_rows: int = STRIP_ROWS) -> Index | None:
    """The index over rows (id, label, q), all of them; None without rows. Centroids are fitted on about sample rows, chosen by a hash of the id."""
    rows = cut(rows, "mining-rows")
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    if not n:
        return None
    width = max(1, width)
    share = F.lit(min(1.0, sample / n))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(1 << 30)) < share * (1 << 30)).select("q").toArrow()  # bounded by sample
    if not drawn.num_rows:
        drawn = rows.select("q").limit(1).toArrow()
    x = matrix(drawn.column("q").combine_chunks(), width)
    centres = fitted_centroids(x, max(1, min(MOST_LISTS, n // LIST_ROWS)))
    at = _nearest(x.astype(np.float64), centres)
    far = np.sqrt(((x - centres[at]) ** 2).sum(1))
    # where the rings of a list begin: quantiles of the sample's distances
    edges = np.array([np.quantile(far[at == c], np.arange(1, RINGS) / RINGS) if (at == c).any() else np.zeros(RINGS - 1) for c in range(len(centres))])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("q"), width).astype(np.float64)
            at = _nearest(q, centres)
            d = np.sqrt(((q - centres[at]) ** 2).sum(1))
            ring = at * RINGS + (d[:, None] > edges[at]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ring, pa.int32()), pa.array(d, pa.float64()), *batch.columns], ["ring", "d", "id", "label", "q"])

    listed = cut(rows.select("id", "label", "q").mapInArrow(assign, "ring int, d double, id bigint, label bigint, q array<int>"), "mining-lists")
    stats = listed.groupBy("ring").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).orderBy("ring").toPandas()  # a row a ring
    first, copies, strip, filled = [], [], 0, 0
    for count in stats["n"]:
        own = max(1, math.ceil(count / strip_rows))
        if own > 1 or filled + count > strip_rows:
            strip, filled = strip + bool(filled), 0
        first.append(strip)
        copies.append(own)
        strip, filled = (strip + own, 0) if own > 1 else (strip, filled + count)
    rings = {k: stats[k].to_numpy() for k in ("ring", "n", "least", "most")} | {"first": np.array(first), "copies": np.array(copies)}
    place = rows.sparkSession.createDataFrame([(int(r), int(f), int(c)) for r, f, c in zip(rings["ring"], first, copies)], "ring int, first int, copies int")
    # a row a ring, MOST_LISTS * RINGS of them at most
    placed = listed.join(F.broadcast(place), "ring").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("copies"))).cast("int").alias("strip"), "ring", "id", "label", "q")
    return Index(placed, width, centres, rings)


def _bounds(q: np.ndarray, index_centres: np.ndarray, rings: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a row of each ring can have with each query, a little wider than computed."""
    q = q.astype(np.float64)
    centre = (q @ index_centres.T)[:, rings["ring"] // RINGS]
    reach = np.linalg.norm(q, axis=1)[:, None] * rings["most"][None, :]
    slack = 1e-9 * (np.abs(centre) + reach) + 1e-6
    return centre - reach - slack, centre + reach + slack


def _windows(column: pa.Array, names: tuple[str, str]) -> tuple[np.ndarray, ...]:
    """Of an array-of-structs column: for each window its row, place in the row, and the two fields."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, place, *[flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]


def _search_strip(own: pa.Table, asked: pa.Table, k: int, same: bool, width: int, centres: np.ndarray, rings: dict[str, np.ndarray]) -> pa.Table:
    """The best k rows of one strip for each window of each query: (query, window, id, score)."""
    ids, labels = own.column("id").to_numpy(), own.column("label").to_numpy()
    q, ring = matrix(own.column("q").combine_chunks(), width), own.column("ring").to_numpy()
    queries, query_labels = asked.column("query").to_numpy(), asked.column("label").to_numpy()
    x = matrix(asked.column("q").combine_chunks(), width)
    w_row, w_place, w_low, w_high = _windows(asked.column("windows").combine_chunks(), ("low", "high"))
    kth = _windows(asked.column("windows").combine_chunks(), ("kth", "high"))[2]
    there = np.unique(ring)
    at = np.searchsorted(rings["ring"], there)
    low, high = _bounds(x, centres, {n: rings[n][at] for n in ("ring", "most")})
    best_w, best_id, best_s = [np.empty(0, dtype=np.int64) for _ in range(3)]
    for j in np.argsort(-high.max(0), kind="stable") if len(x) and len(ids) else ():
        # windows that this ring can still matter to: not missed by its bounds, and not strictly below the k-th score
        upper = np.minimum(high[w_row, j], w_high)
        live = np.nonzero((upper >= w_low) & (low[w_row, j] <= w_high) & (upper >= kth))[0]
        if not len(live):
            continue
        mine = np.nonzero(ring == there[j])[0]
        asking, back = np.unique(w_row[live], return_inverse=True)
        s = scores(x[asking], q[mine])
        alike = query_labels[asking][:, None] == labels[mine][None, :]
        allowed = (alike if same else ~alike) & (queries[asking][:, None] != ids[mine][None, :])
        parts = []
        for begin in range(0, len(live), 256):  # a few windows at a time
            w = live[begin : begin + 256]
            to = back[begin : begin + 256]
            sw = s[to]
            good = allowed[to] & (sw >= np.maximum(w_low, kth)[w][:, None]) & (sw <= w_high[w][:, None])
            if len(mine) > k:
                held = np.where(good, sw, -FAR)
                good &= sw >= np.partition(held, len(mine) - k, axis=1)[:, len(mine) - k][:, None]
            a, b = np.nonzero(good)
            parts.append((w[a], ids[mine[b]], sw[a, b]))
        best_w, best_id, best_s = _merged([best_w, *(p[0] for p in parts)], [best_id, *(p[1] for p in parts)], [best_s, *(p[2] for p in parts)], k)
        ends = np.append(np.nonzero(np.diff(best_w))[0], len(best_w) - 1) if len(best_w) else np.empty(0, dtype=np.int64)
        counts = np.diff(np.append(-1, ends))
        full = ends[counts == k]
        kth[best_w[full]] = np.maximum(kth[best_w[full]], best_s[full])
    return pa.table({"query": queries[w_row[best_w]], "window": pa.array(w_place[best_w], pa.int32()), "id": best_id, "score": best_s})


def _merged(w: list[np.ndarray], ids: list[np.ndarray], s: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """The first k rows of each window by score, then id."""
    w, ids, s = np.concatenate(w), np.concatenate(ids), np.concatenate(s)
    order = np.lexsort((ids, -s, w))
    w, ids, s = w[order], ids[order], s[order]
    begin = np.searchsorted(w, w)
    kept = np.arange(len(w)) - begin < k
    return w[kept], ids[kept], s[kept]


FOUND = "query bigint, window int, id bigint, score bigint"


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, window, id, score, rank): the best k rows of each window of each query, by score, then id.

    queries are rows (query, label, q, windows: array of (low, high), both ends inside). same: only rows of the query's own label count, else only
    those of others; the query's own id never does. Exact: nothing that a bound doesn't rule out is left unvisited.
    """
    width, centres, rings = index.width, index.centres, index.rings
    schema = "strip int, query bigint, label bigint, q array<int>, windows array<struct<low:bigint,high:bigint,kth:bigint>>"
    asked = cut(
        queries.select("query", "label", "q", F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.lit(int(-FAR)).alias("kth"))).alias("windows")).where(F.size("windows") > 0),
        "mining-queries",
    )

    def strips_of(first_pass: bool):
        def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("q"), width)
                low, high = _bounds(x, centres, rings)
                w_row, _, w_low, w_high = _windows(batch.column("windows"), ("low", "high"))
                kth = _windows(batch.column("windows"), ("kth", "high"))[2]
                # rings that a window needs, for any window of a query
                upper = np.minimum(high[w_row], w_high[:, None])
                need = (upper >= w_low[:, None]) & (low[w_row] <= w_high[:, None]) & (upper >= kth[:, None])
                per = np.zeros(high.shape, dtype=bool)
                np.logical_or.at(per, w_row, need)
                if first_pass:  # the most promising ring alone
                    lead = np.where(per, high, -np.inf).argmax(1)
                    only = np.zeros_like(per)
                    only[np.arange(len(x)), lead] = True
                    per &= only
                row, ring = np.nonzero(per)
                copies = rings["copies"][ring]
                strip = np.repeat(rings["first"][ring], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                visits = np.unique(np.repeat(row, copies) * (1 << 32) + strip)
                row, strip = visits >> 32, visits & ((1 << 32) - 1)
                for begin in range(0, len(row), 20_000):
                    some = pa.array(row[begin : begin + 20_000])
                    columns = [batch.column(c).take(some) for c in ("query", "label", "q", "windows")]
                    yield pa.RecordBatch.from_arrays([pa.array(strip[begin : begin + 20_000], pa.int32()), *columns], ["strip", "query", "label", "q", "windows"])

        return choose

    def visited(asked: DataFrame, first_pass: bool, label: str) -> DataFrame:
        visits = cut(asked.mapInArrow(strips_of(first_pass), schema), f"{label}-visits")
        # blocks of queries of a strip, as many as it is asked by; the strip goes to each of them
        blocks = visits.groupBy("strip").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
        dealt = visits.join(blocks, "strip").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
        lists = index.rows.join(blocks, "strip").select("strip", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ring", "id", "label", "q")

        def best(own: pa.Table, asked: pa.Table) -> pa.Table:
            return _search_strip(own, asked, k, same, width, centres, rings)

        return cut(lists.groupBy("strip", "block").cogroup(dealt.groupBy("strip", "block")).applyInArrow(best, FOUND), f"{label}-found")

    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    rank = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    one = visited(asked, True, "mining-first")
    kth = rank(one.distinct()).where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    # the k-th score so far narrows what the second pass visits; it visits the strips of the first again only where they are needed
    raised = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("reached", i.cast("int")), F.lit(int(-FAR))).alias("kth")))
    two = visited(asked.join(kth, "query", "left").select("query", "label", "q", raised.alias("windows")), False, "mining-rest")
    return rank(one.unionByName(two).distinct())


def mine(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 10,
    window: tuple[int, int] = (30, 90), anchors_every: int = 100, relabel_every: int | None = None, strip_rows: int = STRIP_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by anchors_every.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part; an id counts once (prepared()). Where
    the id is divisible by relabel_every the label becomes (label + 1) % 10. Scores are inner products of floor(256 * x), by which rows are ordered,
    then by id. An anchor's positives are its best n_positives other rows of its label, all if there are fewer. A positive's negatives are the
    best n_negatives rows of other labels with window[0] * positive <= 100 * negative <= window[1] * positive; without any it has no row. Shorter vectors
    are filled up with zeros. Centroids are fitted on a bounded sample (SAMPLE), but every row is in the index and results are exact.
    """
    low, high = window
    rows = prepared(df, id, vector, label)
    if relabel_every:
        rows = rows.withColumn("label", F.when(F.col("id") % relabel_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    index = build(rows, strip_rows=strip_rows)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if index is None:
        return df.sparkSession.createDataFrame([], schema)
    anchors = index.rows.where(F.col("id") % anchors_every == 0).select(F.col("id").alias("query"), "label", "q")
    every = F.array(F.struct(F.lit(int(-FAR)).alias("low"), F.lit(int(FAR)).alias("high")))
    positives = cut(search(index, anchors.withColumn("windows", every), n_positives, True), "mining-positives")
    # 100 * negative within the window: the least and the greatest whole number that fit
    scaled = positives.withColumns({"low": F.lit(low) * F.col("score"), "high": F.lit(high) * F.col("score")})
    bounds = F.struct("rank", F.expr("(low + pmod(-low, 100)) div 100").alias("low"), F.expr("(high - pmod(high, 100)) div 100").alias("high"))
    told = scaled.groupBy("query").agg(F.array_sort(F.collect_list(bounds)).alias("windows"))  # n_positives of them at most
    found = search(index, anchors.join(told, "query"), n_negatives, False)
    named = found.join(positives.select("query", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["query", "window"])
    return named.select(F.col("query").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
