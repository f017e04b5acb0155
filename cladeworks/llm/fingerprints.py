"""Operator 1: document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever its low bits are all ones; each chunk
gives one character, so an edit changes only the characters near it. The block size, the mean
length of a chunk, follows the length of the text; the fingerprint holds the signatures at that
size and at twice it. Two fingerprints are compared by edit distance (insertions and deletions)
between signatures of the same block size.

Neighbours by doc_id are needed too: documents are range-partitioned and sorted by id, and every
partition is streamed with one row of lookahead. Only the last document of a partition waits for the first of the
next one; those two rows per partition are joined in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.llm.common import cut, shuffle_width, text_or_empty

WINDOW = 7
LEAST_BLOCK = 4
LENGTH = 64  # characters of a signature at most; its last one covers all that is left
COMMON = 7  # a shared run of so many characters is needed for any likeness
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0..n and their inverses modulo 2**64; kept, and grown on demand."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, 1 << 17), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(32))) * MIX) >> np.uint64(40)


def fingerprint(text: str) -> str:
    """`block:signature:signature at twice the block` of a whole text; empty signatures for ''."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    # hash of bytes s..e: sums[e] - sums[s], moved back to position 0
    if n >= WINDOW:
        rolling = _mixed((sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1])
        least = np.uint64(LEAST_BLOCK - 1)
        ends = np.flatnonzero((rolling & least) == least)
        values = rolling[ends]
        ends = ends + WINDOW
    else:
        ends, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def signature(block: int) -> str:
        mask = np.uint64(block - 1)
        stops = ends[(values & mask) == mask][: LENGTH - 1]
        if not len(stops) or stops[-1] < n:
            stops = np.append(stops, n)
        starts = np.concatenate([[0], stops[:-1]])
        chunks = _mixed((sums[stops] - sums[starts]) * down[starts]) & np.uint64(63)
        return "".join(map(ALPHABET.__getitem__, chunks.tolist()))

    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    first = signature(block)
    while len(first) < LENGTH // 2 and block > LEAST_BLOCK:
        block //= 2
        first = signature(block)
    return f"{block}:{first}:{signature(2 * block)}"


def _short_runs(signature: str) -> str:
    """Runs of one character shortened to three: they say little about likeness."""
    return "".join(c for i, c in enumerate(signature) if not c == signature[i - 1 : i] == signature[i - 2 : i - 1] == signature[i - 3 : i - 2])


def _comparable(one: str, other: str) -> list[tuple[str, str]]:
    """Pairs of signatures at the same block size that share a run long enough."""
    b1, x1, y1 = one.split(":")
    b2, x2, y2 = other.split(":")
    b1, b2 = int(b1), int(b2)
    pairs = [(x1, x2), (y1, y2)] if b1 == b2 else [(x1, y2)] if b1 == 2 * b2 else [(y1, x2)] if b2 == 2 * b1 else []
    out = []
    for p, q in pairs:
        p, q = _short_runs(p), _short_runs(q)
        k = min(COMMON, (min(len(p), len(q)) + 1) // 2)
        if k and not {p[i : i + k] for i in range(len(p) - k + 1)}.isdisjoint(q[i : i + k] for i in range(len(q) - k + 1)):
            out.append((p, q))
    return out


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Longest common subsequence of each pair, bit-parallel, for all pairs at once."""
    if not pairs:
        return np.zeros(0, np.int64)
    code = {c: i for i, c in enumerate(ALPHABET)}
    m = len(pairs)
    rows = np.arange(m)
    masks = np.zeros((m, len(ALPHABET) + 1), np.uint64)
    second = np.full((m, LENGTH), len(ALPHABET))
    for r, (p, q) in enumerate(pairs):
        for i, c in enumerate(p):
            masks[r, code[c]] |= np.uint64(1 << i)
        second[r, : len(q)] = [code[c] for c in q]
    v = np.full(m, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(LENGTH):
        u = v & masks[rows, second[:, j]]
        v = (v + u) | (v - u)
    lengths = np.array([len(p) for p, _ in pairs])
    inside = np.where(lengths >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (lengths % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """Likeness of each pair of fingerprints, 0 to 1: one less the edit distance over both lengths."""
    todo: list[tuple[str, str]] = []
    owner: list[int] = []
    out = [1.0 if a == b else 0.0 for a, b in pairs]
    for i, (a, b) in enumerate(pairs):
        if a != b:
            got = _comparable(a, b)
            todo += got
            owner += [i] * len(got)
    for i, (p, q), n in zip(owner, todo, common_lengths(todo).tolist()):
        out[i] = max(out[i], 2 * n / (len(p) + len(q)))
    return out


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _finished(rows: list[tuple]) -> list[tuple]:
    """Result rows of (doc_id, text, fingerprint, next text, next fingerprint)."""
    half = []
    for doc_id, text, own, following, other in rows:
        moved = len(text) // 4
        edited = text[: len(text) - moved] + following[:moved]
        half.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(edited), other))
    near_edited = likeness([(r[3], r[4]) for r in half])
    near_next = likeness([(r[3], r[5]) for r in half])
    return [(*r[:5], a, b) for r, a, b in zip(half, near_edited, near_next)]


KIND = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
KIND_DDL = f"kind string, block bigint, text string, {RESULT}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(KIND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KIND)], schema=KIND)


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish all documents of a sorted partition but the last; hand out its first and last."""
    block = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        waiting: list[tuple] = []
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = fingerprint(text)
            if held is None:
                out.append(("first", block, text, doc_id, None, None, own, None, None, None))
            else:
                waiting.append((*held, text, own))
            held = (doc_id, text, own)
        yield _batch(out + [("done", None, None, *r) for r in _finished(waiting)])
    if held is not None:
        yield _batch([("last", block, held[1], held[0], None, None, held[2], None, None, None)])


def _join_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _finished(list(zip(*(c.to_pylist() for c in batch.columns))))
        columns = list(zip(*rows)) if rows else [()] * len(COLUMNS)
        fields = [KIND.field(c) for c in COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def fingerprint_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses: the columns of RESULT.

    The edited text ends with the beginning of the next document by id (the first, after the
    last; null ids come first, equal ids go by text). Null texts are empty; an empty text has
    empty signatures and is like empty texts only. Repeated rows are documents of their own.
    Other columns are not carried, so their names can't clash. An empty table gives none.
    """
    spark = df.sparkSession
    ordered = (
        df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
        .repartitionByRange(shuffle_width(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    streamed = cut(ordered.mapInArrow(_stream, KIND_DDL), "fingerprints")
    done = streamed.where("kind = 'done'").select(*COLUMNS)
    # two rows per partition from here on
    firsts = streamed.where("kind = 'first'").select("block", "text", "fingerprint")
    order = Window.orderBy("block")
    follows = firsts.select("block", F.lead("block").over(order).alias("next"), F.min("block").over(Window.partitionBy(F.lit(1))).alias("lowest"))
    ends = (
        streamed.where("kind = 'last'").select("block", "doc_id", "text", "fingerprint")
        .join(follows.select("block", F.coalesce("next", "lowest").alias("next")), "block")
        .join(firsts.toDF("next", "next_text", "next_fingerprint"), "next")
        .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    )
    return done.unionByName(ends.mapInArrow(_join_ends, RESULT))
