"""Operator 2: n-gram Jaccard join with a MinHash LSH forest.

Documents are sets of hashed word shingles; equal sets are one class from the start, with a count of
its copies. Every class has a path of DEEPEST MinHash values in each of TREES trees: sorted by path, classes lie
as the leaves of a prefix trie. Pairs first meet where whole paths agree; how alike those pairs are tells how
many links of each similarity there are, for a path is shared with a known chance, and from that how many of them
are met at any shorter prefix. The prefix is shortened, value by value, until that measured recall reaches the target, and no
further than the depth at which even pairs at the threshold itself meet often enough.

Inside the nodes of that depth the trie is walked from whole paths up to the shortened prefix. Pairs that meet are
screened by the share of equal MinHash bytes; pairs whose ends are linked already are passed over, and only a spanning
forest of what passes leaves a task. The components of those links are small groups of likely
near-duplicates; in each, all pairs are compared exactly by their whole shingle sets, and only counts
and a spanning forest of the exact links leave the task, so pairs are never rows.
Large nodes and large components are cut into blocks that are compared two by two, so a task
holds two blocks at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import cut, runs, shuffle_width, text_or_empty
from cladeworks.llm.components import connected_components
from cladeworks.llm.decontaminate import WORD_BYTES
from cladeworks.llm.fingerprints import powers

SHINGLE = 5  # words
THRESHOLD = 0.8
TREES = 16
DEEPEST = 8  # MinHash values along a path of a tree
RECALL = 0.9999  # of the links, as measured; at most a tenth of what is left is lost by the screen
MEASURED = 4  # trees whose whole paths tell how alike the linked pairs are
SCREEN = 0.55  # share of equal MinHash bytes below which a pair that met is not compared exactly
SKETCH = 4  # MinHash values of each tree whose lowest byte is in the sketch
BLOCK = 500  # classes of a forest node compared with one another in a task, or with those of a second block
TEXTS, MOST_TEXTS = 128, 500  # the same for whole texts, and where paths are measured, in small and in very large groups
SEED = 20

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)


def met_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair has a common prefix of that depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depth(found: Mapping[float, float] | None = None, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """Shorten the prefix until the target recall is met: of the links that were found by similarity, or of pairs at the threshold.

    found has the number of pairs of each similarity, as estimated at whole paths; without it all count as being at the threshold.
    """
    links = {max(s, threshold): 0.0 for s in found or {}} or {threshold: 1.0}
    for s, n in (found or {}).items():
        links[max(s, threshold)] += n
    least = deepest
    while least > 1 and met_share(threshold, least, trees) < recall:
        least -= 1
    depth = deepest
    while depth > least and sum(n * met_share(s, depth, trees) for s, n in links.items()) < recall * sum(links.values()):
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of SHINGLE words; of all words if there are fewer, but some."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[: len(data)], out=sums[1:])
    words = _mixed((sums[stops] - sums[starts]) * down[starts])
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total = total * STEP + words[k : k + n]
    return np.unique(_mixed(total))


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of a set: the least values of n permutations of 32-bit numbers."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, n, np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        low = np.minimum(low, (a[:, None] * short[None, at : at + 512] + b[:, None]).min(axis=1))
    return low


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def forest_paths(values: np.ndarray) -> tuple[bytes, bytes]:
    """All trees' paths, two bytes a value, and the sketch: the lowest bytes of the first SKETCH values of each tree.

    The least of many values has few high bits left, so the low ones are kept.
    """
    return values.astype(">u2").tobytes(), values.reshape(TREES, DEEPEST)[:, :SKETCH].astype(np.uint8).tobytes()


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) -> (doc_id, digest, node, paths, sig): the set's digest, its paths and its sketch; null without words."""
    for batch in batches:
        nodes, paths, sigs = [], [], []
        for text in batch.column(2).to_pylist():
            shingles = shingle_set(text)
            path, sig = forest_paths(minhashes(shingles, TREES * DEEPEST)) if len(shingles) else (None, None)
            nodes.append(digest(shingles) if len(shingles) else None)
            paths.append(path)
            sigs.append(sig)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(x, pa.binary()) for x in (nodes, paths, sigs)]], ["doc_id", "digest", "node", "paths", "sig"]
        )


def _path(tree: Column, depth: int = DEEPEST) -> Column:
    """The first values of a tree's path."""
    return F.substring("paths", tree * (2 * DEEPEST) + 1, F.lit(2 * depth))


def forest(classes: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """A row for each class and tree, with the node at that depth (its tree and prefix) and the whole path; lone nodes are left out."""
    rows = classes.select("node", "sig", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    keyed = rows.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), _path(F.col("tree"), depth)).alias("key"), _path(F.col("tree")).alias("path"), "node", "sig")
    # counted by the tasks that have the rows; the counts are read from a table, so Spark can split a node of very many classes
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    return keyed.join(sizes.hint("merge"), "key")  # the same plan at every size


def in_blocks(df: DataFrame, size: str, block: Column) -> DataFrame:
    """Rows of groups with column size members: column own (their block), and one row for each pair (g1, g2) it is in."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    return (
        df.withColumn("own", F.when(blocks > 1, F.pmod(F.xxhash64(F.lit(3), "node"), blocks)).otherwise(0).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"g1": F.least("own", "other"), "g2": F.greatest("own", "other")})
        .drop("other")
    )


def growing_block(size: str) -> Column:
    """Blocks that grow with the root of a group's size, so copies of a row stay fewer than that."""
    return F.least(F.greatest(F.lit(TEXTS), (4 * F.sqrt(size)).cast("int")), F.lit(max(TEXTS, MOST_TEXTS)))


def dealt(df: DataFrame, group: str) -> DataFrame:
    """Rows of block pairs brought together: a group's pairs go to tasks in turn, so no task gets many of one group."""
    width = F.lit(shuffle_width(df.sparkSession))
    nth = F.floor(F.col("g2") * (F.col("g2") + 1) / 2) + F.col("g1")
    return df.repartitionById(shuffle_width(df.sparkSession), F.pmod(F.pmod(F.xxhash64(group), width) + nth, width).cast("int"))


def _spanning(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index linked with each one, by links so far (each one's least index) and the given ones."""
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(starts: np.ndarray, sizes: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers inside each run, in arrays of about most pairs."""
    for m in np.unique(sizes):
        if m < 2:
            continue
        first = starts[sizes == m]
        if m * (m - 1) // 2 <= most:
            i, j = np.triu_indices(m, 1)
            step = max(1, most // len(i))
            for at in range(0, len(first), step):
                base = first[at : at + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            step = max(1, most // m)
            for base in first:
                for at in range(0, m, step):
                    i, j = np.nonzero(np.arange(at, min(m, at + step))[:, None] < np.arange(m)[None, :])
                    yield base + at + i, base + j


class _Nodes(NamedTuple):
    """Rows of some forest nodes, sorted by node, block pair and path, as arrays."""

    group: np.ndarray  # number of a row's node and block pair
    own: np.ndarray
    across: np.ndarray  # whether rows of its two blocks are compared, and not those of one
    path: np.ndarray  # rows x values
    sig: np.ndarray

    def runs(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the runs with a common group and prefix."""
        new = np.ones(len(self.group), bool)
        new[1:] = self.group[1:] != self.group[:-1]
        new[1:] |= (self.path[1:, :depth] != self.path[:-1, :depth]).any(axis=1)
        starts = np.flatnonzero(new)
        return starts, np.diff(np.append(starts, len(new)))

    def compared(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that this block pair compares."""
        ok = ~self.across[i] | (self.own[i] != self.own[j])
        return i[ok], j[ok]


def _nodes(got: pa.Table) -> _Nodes:
    n = got.num_rows
    keys, g1, g2 = got.column("key").to_pylist(), got.column("g1").to_numpy(), got.column("g2").to_numpy()
    new = np.zeros(n, bool)
    new[1:] = [a != b for a, b in zip(keys[1:], keys[:-1])]
    new[1:] |= (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
    path = np.frombuffer(b"".join(got.column("path").to_pylist()), ">u2").reshape(n, DEEPEST)
    sig = np.frombuffer(b"".join(got.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    return _Nodes(np.cumsum(new), got.column("own").to_numpy(), g1 != g2, path, sig)


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of classes sorted by whole paths: how many pairs share one, by the share of equal bytes (in hundredths) outside of that path."""
    counts = np.zeros(101, np.int64)
    for got in runs(batches, ["key", "g1", "g2"]):
        nodes = _nodes(got)
        for i, j in _pairs(*nodes.runs(DEEPEST)):
            i, j = nodes.compared(i, j)
            equal = (nodes.sig[i] == nodes.sig[j]).sum(axis=1) - SKETCH
            counts += np.bincount(np.maximum(0, equal * 100 // (nodes.sig.shape[1] - SKETCH)), minlength=101)
    kept = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(counts[kept])], ["share", "n"])


def _met(depth: int):
    """Of classes sorted by tree node and path: a spanning forest (a, b) of the pairs that pass the screen."""

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in runs(batches, ["key", "g1", "g2"]):
            nodes = _nodes(got)
            label = np.arange(got.num_rows)
            for level in range(DEEPEST, depth - 1, -1):
                left, right = [], []
                for i, j in _pairs(*nodes.runs(level)):
                    apart = label[i] != label[j]
                    if level < DEEPEST:  # those with a longer prefix in common have been compared
                        apart &= nodes.path[i, level] != nodes.path[j, level]
                    i, j = nodes.compared(i[apart], j[apart])
                    good = (nodes.sig[i] == nodes.sig[j]).mean(axis=1) >= SCREEN
                    left.append(i[good])
                    right.append(j[good])
                if left:
                    label = _spanning(label, np.concatenate(left), np.concatenate(right))
            linked = np.flatnonzero(label != np.arange(len(label)))
            names = got.column("node")
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.take(linked).to_pylist(), pa.binary()), pa.array(names.take(label[linked]).to_pylist(), pa.binary())], ["a", "b"]
            )

    return met


def common_counts(sets: list[np.ndarray], most: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (sorted); about most of their values are in hand at a time."""
    m = len(sets)
    out = np.zeros((m, m), np.float64)
    parts = max(1, -(-sum(map(len, sets)) // most))
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for p in range(parts):
        _add_common(out, [s[c[p] : c[p + 1]] for s, c in zip(sets, cuts)])
    return out


def _add_common(out: np.ndarray, sets: list[np.ndarray]) -> None:
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1  # only these can be in an intersection
    number = np.cumsum(shared) - 1
    kept = shared[place]
    owner, column = owner[kept], number[place[kept]]
    width = max(1, 8_000_000 // max(1, m))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, [at, at + width])
        part = np.zeros((m, min(width, int(shared.sum()) - at)), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        out += part @ part.T


def _verify(threshold: float):
    """Groups of classes with whole texts -> (node, links, root): exact links, counted with copies, and local roots."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in runs(batches, ["comp", "g1", "g2"], 256):
            rows = got.select(["comp", "g1", "g2", "own", "node", "copies", "text"]).to_pylist()
            nodes, links, roots = [], [], []
            at = 0
            while at < len(rows):
                head = rows[at]
                group: dict[bytes, tuple] = {}
                while at < len(rows) and all(rows[at][k] == head[k] for k in ("comp", "g1", "g2")):
                    row = rows[at]
                    at += 1
                    if row["node"] not in group:
                        shingles = shingle_set(row["text"])
                        if digest(shingles) == row["node"]:  # else a repeated id brought another text
                            group[row["node"]] = (shingles, row["own"], row["copies"])
                if len(group) < 2:
                    continue
                names = list(group)
                sizes = np.array([len(v[0]) for v in group.values()], np.float64)
                common = common_counts([v[0] for v in group.values()])
                near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
                np.fill_diagonal(near, False)
                if head["g1"] != head["g2"]:
                    own = np.array([v[1] for v in group.values()])
                    near &= own[:, None] != own[None, :]
                left, right = np.nonzero(near)
                label = _spanning(np.arange(len(names)), left, right)
                nodes += names
                links += (near @ np.array([v[2] for v in group.values()], np.float64)).astype(np.int64).tolist()
                roots += [names[i] for i in label]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["node", "links", "root"]
            )

    return verify


def measured_depth(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The depth that forest_depth() finds for the pairs that share whole paths in some trees: at most 101 counts come to the driver."""
    counts = (
        dealt(in_blocks(forest(classes, DEEPEST, MEASURED), "n", growing_block("n")).select("key", "g1", "g2", "own", "path", "sig"), "key")
        .sortWithinPartitions("key", "g1", "g2")
        .mapInArrow(_alike, "share int, n bigint").groupBy("share").agg(F.sum("n").alias("n"))
    )
    seen = {r["share"] / 100: r["n"] for r in counts.collect()}
    # a pair of similarity s shares a whole path with chance s ** DEEPEST in each tree
    return forest_depth({s: n / (MEASURED * max(s, threshold) ** DEEPEST) for s, n in seen.items() if s >= threshold - 0.1}, threshold, recall=recall)


def _classed(df: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows of df as (doc_id, digest, node) and, of each node, (node, root, class_id, links with other rows)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("digest", F.md5("text"))
    sketches = cut(
        docs.select("doc_id", "digest", "text").mapInArrow(_sketch, "doc_id bigint, digest string, node binary, paths binary, sig binary"), "sketches"
    )
    # one row stands for the class where its text is read again: told by id and digest, so null and repeated ids do no harm
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = cut(
        sketches.where("node is not null").groupBy("node")
        .agg(one.alias("one"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("sig").alias("sig")),
        "classes",
    )
    depth = measured_depth(classes, threshold, recall)
    links = (
        dealt(in_blocks(forest(classes, depth), "n", F.lit(BLOCK)).select("key", "g1", "g2", "own", "path", "node", "sig"), "key")
        .sortWithinPartitions("key", "g1", "g2", "path")
        .mapInArrow(_met(depth), "a binary, b binary")
    )
    groups = cut(connected_components(links), "groups")

    # exact verification inside the components; sizes are read from a table, so Spark can split a join on a large root
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    members = classes.select("node", "one", "copies").join(groups, "node").join(sizes, "root").withColumnRenamed("root", "comp")
    same = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("digest") == F.col("one.digest"))
    read = docs.join(members, same)
    # of rows alike in id and text one is enough, and only a class with copies can have them
    texts = read.where("copies = 1").unionByName(read.where("copies > 1").dropDuplicates(["node"]))
    verified = cut(
        dealt(in_blocks(texts, "n", growing_block("n")).select("comp", "g1", "g2", "own", "node", "copies", "text"), "comp").sortWithinPartitions("comp", "g1", "g2")
        .mapInArrow(_verify(threshold), "node binary, links bigint, root binary"),
        "verified",
    )
    exact = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = cut(
        classes.select("node", "one", "copies").join(exact, "node", "left").join(counts, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), "one", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "rooted",
    )
    least = cut(rooted.groupBy("root").agg(F.min("one").alias("first")), "least")
    # read from tables, both sides of joins are plain exchanges, so Spark can split a class of very many copies
    return sketches.select("doc_id", "digest", "node"), cut(rooted.select("node", "root", "n_links").join(least, "root"), "found")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their shingle sets is the threshold at
    least. n_links counts the other rows linked to a row, copies included; class_id is the least
    doc_id of its connected component (null only if all its ids are null). Null, empty and wordless texts have no
    shingles: no links, and their own id as class. Repeated rows are copies of each other; an id may repeat with other texts. Other columns
    are ignored. An empty table gives none.
    """
    rows, found = _classed(df, threshold, recall)
    return rows.join(found, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of df, all columns, but of each class only one: the least by doc_id (nulls last), then by digest of the text.

    Rows are told apart by id and text, so an id that repeats with other texts, or a null one, is judged like any other.
    Of rows alike in both one stays. Wordless texts are in no class and stay.
    """
    rows, found = _classed(df, threshold, recall)
    first = found.select(F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest")).distinct()
    kept = first.unionByName(rows.where("node is null").select("doc_id", "digest").distinct())
    times = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("_times"))
    both = [kept[c].eqNullSafe(times[c]) for c in ("doc_id", "digest")]
    wanted = kept.join(times, both).select(kept["doc_id"].alias("_id"), kept["digest"].alias("_digest"), "_times")
    marked = df.withColumns({"_row_id": F.col("doc_id").cast("long"), "_row_digest": F.md5(text_or_empty())})
    here = marked.join(wanted, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_digest") == F.col("_digest")))
    repeated = here.where("_times > 1").dropDuplicates(["_row_id", "_row_digest"])
    return here.where("_times = 1").unionByName(repeated).select(*[F.col(c) for c in df.columns])
