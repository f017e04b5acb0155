"""Operator 4: benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of item-sized word runs; a window is a set of shingles (pairs of neighbouring words).
Shingles are ordered by rarity, counted over all documents. A document can only contain a
window whole if it has the window's necessary prefix, which for full containment is its rarest
shingle. Documents are joined with the windows by those shingles; of the windows found so, those that start
before the document or end behind it (positional and length bounds) are left out, and the rest are
verified word for word.

A benchmark of at most BLOCK_WORDS words and BLOCK_BYTES bytes goes to the tasks as a broadcast index, and documents are judged where they
lie. A larger one is joined by shuffles: documents send the hashes of their distinct shingles, those that are some window's
rarest come back to their document, and only what stands around these is compared with the windows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from cladeworks.llm.common import cut, shuffle_width

WINDOW = 10  # words
BLOCK_WORDS = 1_000_000  # of items in a broadcast index: about 500 MB at most; more items are joined by shuffles
BLOCK_BYTES = 1 << 26  # and bytes: a word may have any length

# Word bytes: digits, letters, everything beyond ASCII; A-Z are lowered, all others separate words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Window(NamedTuple):
    item: str
    words: tuple[bytes, ...]


Pairs = dict[bytes, dict[bytes, int]]  # first word -> second word -> documents
Index = dict[bytes, dict[bytes, list[tuple[int, Window]]]]  # the rarest shingle -> (its place in the window, window)


def windows_of(item: str, text: str | None) -> Iterator[Window]:
    """All windows of an item's text; an item of fewer words than a window, but not none, is one."""
    words = words_of(text)
    if words:
        for i in range(max(1, len(words) - WINDOW + 1)):
            yield Window(item, tuple(words[i : i + WINDOW]))


def shingles(words: tuple[bytes, ...]) -> list[tuple[bytes, bytes]]:
    """Neighbouring pairs; a lone word is paired with nothing."""
    return list(zip(words, words[1:])) or [(words[0], b"")]


def index_of(windows: Iterable[Window], rarity: Counter) -> Index:
    """Each window under its rarest shingle, with the shingle's first place in it."""
    index: Index = {}
    for window in windows:
        pairs = shingles(window.words)
        at = min(range(len(pairs)), key=lambda i: (rarity[pairs[i]], pairs[i]))
        index.setdefault(pairs[at][0], {}).setdefault(pairs[at][1], []).append((at, window))
    return index


def hits_of(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """Places (start, stop) of windows found in a document, in order of their shingles, and their items."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    n = len(words)
    get = index.get
    for i, word in enumerate(words):
        seconds = get(word)
        if seconds is None:
            continue
        for second in (words[i + 1] if i + 1 < n else None, b""):
            for at, (item, run) in seconds.get(second, ()):
                start, stop = i - at, i - at + len(run)
                if start >= 0 and stop <= n and tuple(words[start:stop]) == run:
                    found.append((start, stop))
                    items.add(item)
    return found, items


def merged(places: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching places joined."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()


def _small(items: DataFrame) -> list[tuple[str, str]] | None:
    """The items, if they have BLOCK_BYTES bytes and BLOCK_WORDS words at most: both are counted before anything comes to the driver."""
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if size > BLOCK_BYTES:
        return None

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(words_of(t.as_py())) for t in batch.column(0))], pa.int64())], ["n"])

    n = items.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    return [(r.item, r.text) for r in items.collect()] if n <= BLOCK_WORDS else None


def _rarity(docs: DataFrame, windows: list[Window]) -> Counter:
    """In how many documents each shingle of the windows occurs, over all documents."""
    wanted: dict[bytes, set[bytes]] = {}
    for window in windows:
        for first, second in shingles(window.words):
            wanted.setdefault(first, set()).add(second)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # gone once the counts are there

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        known = sent.value
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                total.update(
                    {(w, v) for w, v in zip(words, words[1:] + [b""]) if (s := known.get(w)) and v in s}
                    | {(w, b"") for w in words if (s := known.get(w)) and b"" in s}
                )
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.binary()), pa.array([total[k] for k in keys], pa.int64())],
            ["first", "second", "n"],
        )

    counted = docs.select("text").mapInArrow(count, "first binary, second binary, n bigint")
    sums = counted.groupBy("first", "second").agg(F.sum("n").alias("n"))
    # one row per shingle of the items: bounded like their words
    rarity = Counter({(bytes(r.first_), bytes(r.second_)): r.n for r in sums.toDF("first_", "second_", "n").collect()})
    sent.destroy()
    return rarity


FOUND = "n_words bigint, places array<struct<start:bigint,stop:bigint>>, items array<string>"
PLACES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _sent_index(docs: DataFrame, items: list[tuple[str, str]]):
    """The index of the items, broadcast."""
    windows = [w for item, text in items for w in windows_of(item, text)]
    rarity = _rarity(docs, windows) if windows else Counter()
    return docs.sparkSession.sparkContext.broadcast(index_of(windows, rarity))


def _probed(docs: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """One pass of all documents over the broadcast index."""
    sent = _sent_index(docs, items)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            n_words, places, names = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found, got = hits_of(words, index)
                n_words.append(len(words))
                places.append([{"start": a, "stop": b} for a, b in merged(found)])
                names.append(sorted(got))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(places, PLACES), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "n_words", "places", "items"],
            )

    return docs.mapInArrow(probe, f"doc_id bigint, {FOUND}")


# --- a benchmark of any size, joined by shuffles

def shingle_key(pair: tuple[bytes, bytes]) -> int:
    """64 bits of a shingle; words hold no blanks. Windows are compared word by word later, so collisions do no harm."""
    return int.from_bytes(hashlib.blake2b(b" ".join(pair), digest_size=8).digest(), "big", signed=True)


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, run, keys): every window, with the keys of its shingles."""
    for batch in batches:
        windows = [w for item, text in zip(*(c.to_pylist() for c in batch.columns)) for w in windows_of(item, text)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([w.item for w in windows], pa.string()), pa.array([b" ".join(w.words) for w in windows], pa.binary()),
                pa.array([[shingle_key(p) for p in shingles(w.words)] for w in windows], pa.list_(pa.int64())),
            ],
            ["item", "run", "keys"],
        )


def _shingles_of(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """(place, key) of all a document can have in common with a window: its pairs, and its words as windows of their own."""
    for i, word in enumerate(words):
        yield i, shingle_key((word, b""))
        if i + 1 < len(words):
            yield i, shingle_key((word, words[i + 1]))


def _doc_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) -> (doc_id, digest, key): the distinct keys of each document."""
    for batch in batches:
        for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
            keys = list({k for _, k in _shingles_of(words_of(text))})
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(keys), pa.int64()), pa.array([digest] * len(keys), pa.string()), pa.array(keys, pa.int64())], ["doc_id", "digest", "key"])


def _around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text, keys) -> what stands around each place of these keys: (doc_id, digest, key, at, from, words)."""
    for batch in batches:
        for doc_id, digest, text, keys in zip(*(c.to_pylist() for c in batch.columns)):
            words, wanted = words_of(text), set(keys)
            rows = [(key, i, max(0, i - WINDOW + 1)) for i, key in _shingles_of(words) if key in wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id] * len(rows), pa.int64()), pa.array([digest] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([b" ".join(words[r[2] : r[1] + WINDOW]) for r in rows], pa.binary()),
                ],
                ["doc_id", "digest", "key", "at", "begin", "words"],
            )


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place, what stands around it and a window: those where the window is there, with its start and stop."""
    for batch in batches:
        out = []
        for doc_id, digest, at, begin, words, item, run, nth in zip(*(c.to_pylist() for c in batch.columns)):
            start, run = at - nth, run.split(b" ")
            if start >= begin and words.split(b" ")[start - begin : start - begin + len(run)] == run:
                out.append((doc_id, digest, item, start, start + len(run)))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "digest", "item", "start", "stop"])


def joined_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, digest, item, start, stop) of every window in every document (doc_id, digest, text), for benchmarks of any size."""
    windows = cut(items.select("item", "text").mapInArrow(_window_rows, "item string, run binary, keys array<bigint>").distinct(), "windows")
    each = windows.select("item", "run", F.posexplode("keys").alias("nth", "key"))
    doc_keys = docs.select("doc_id", "digest", "text").mapInArrow(_doc_keys, "doc_id bigint, digest string, key bigint")
    # counts are summed before the shuffle, so a frequent shingle is one row of each task
    rarity = doc_keys.groupBy("key").agg(F.count("*").alias("n")).join(each.select("key").distinct(), "key", "left_semi")
    order = Over.partitionBy("item", "run").orderBy(F.coalesce("n", F.lit(0)), "key", "nth")
    index = cut(each.join(rarity, "key", "left").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("key", "nth", "item", "run"), "rarest")
    rare = cut(index.select("key").distinct(), "rare-keys")
    matched = doc_keys.join(rare, "key").groupBy("doc_id", "digest").agg(F.collect_set("key").alias("keys"))  # as many as a document's shingles at most
    same = docs["doc_id"].eqNullSafe(matched["doc_id"]) & (docs["digest"] == matched["digest"])
    read = docs.join(matched, same).select(docs["doc_id"], docs["digest"], "text", "keys")
    places = cut(read.mapInArrow(_around, "doc_id bigint, digest string, key bigint, at bigint, begin bigint, words binary"), "places")
    return (
        places.join(index, "key").select("doc_id", "digest", "at", "begin", "words", "item", "run", "nth")
        .repartition(shuffle_width(docs.sparkSession)).mapInArrow(_verified, "doc_id bigint, digest string, item string, start bigint, stop bigint").distinct()
    )


def _merge(places: Iterable[dict]) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in merged((p["start"], p["stop"]) for p in places)]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([len(words_of(t)) for t in texts], pa.int64()),
                pa.array([_merge(p or []) for p in places], PLACES), pa.array([sorted(x or []) for x in batch.column("items").to_pylist()], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "places", "items"],
        )


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What _probed() gives, by shuffles. Rows alike in id and text have the same hits."""
    hits = joined_hits(docs, items).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "stop")).alias("places"), F.collect_set("item").alias("items"))
    same = docs["doc_id"].eqNullSafe(hits["doc_id"]) & (docs["digest"] == hits["digest"])
    return docs.join(hits, same, "left").select(docs["doc_id"], "text", "places", "items").mapInArrow(_counted, f"doc_id bigint, {FOUND}")


def _told_apart(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places (merged word ranges that are hit), items, n_hit.

    documents has doc_id and text, benchmark item_id and text; other columns are ignored. Null
    and empty texts have no words and no hits; items with a null id or text have no windows. Repeated
    documents stay repeated; repeated items count once. An empty benchmark hits nothing.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    small = _small(items)
    found = _probed(docs, small) if small is not None else _joined(_told_apart(docs), items)
    covered = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["stop"] - p["start"])
    return found.withColumn("n_hit", covered)


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold any window of a benchmark item; cases as for contamination().

    With a small benchmark documents are judged row by row where they lie, so nothing is shuffled.
    """
    items = _items(benchmark)
    small = _small(items)
    if small is None:
        plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hit = joined_hits(_told_apart(plain), items).select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest")).distinct()
        own = F.md5(F.coalesce(documents["text"].cast("string"), F.lit("")))
        return documents.join(hit, documents["doc_id"].cast("long").eqNullSafe(F.col("_hit_id")) & (own == F.col("_hit_digest")), "left_anti")
    sent = _sent_index(documents.select(F.col("text").cast("string").alias("text")), small)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            yield batch.filter(pa.array([not hits_of(words_of(x), index)[0] for x in texts.to_pylist()], pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
