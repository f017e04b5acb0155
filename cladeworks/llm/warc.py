"""Operator 11: WARC archives as a chunked record table.

Writing: payloads are cut into segments of bounded size, and every segment is a record of its own
as the format has it (`WARC-Segment-Number`, then `continuation` records), so no row of the writer holds more than a
segment. Spark's text writer puts the rows into files, the end of a record being its line separator: any store that Spark
reaches will do, and a task that is lost is written anew by Spark's commit protocol. Equal payloads are
one response and revisits of it. They are found by a digest on narrow rows; of each distinct payload one copy
is shuffled, whatever the number of its pages.

Reading: files are compressed, so each is read by one task from its start, line by line. A record is followed by its
content length alone and becomes rows (record, chunk number) of at most a chunk's bytes, each with the
digest of the payload up to its end. A task holds a chunk, never a record. Lines of a file written here are no longer than a segment;
of a foreign file, the longest line must fit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import cut, dropped
from cladeworks.sources.stages import stage_root

SEGMENT = 1 << 18  # payload bytes of a record at most
CHUNK = 1 << 18  # payload bytes of a row that is read
BATCH = 1 << 24  # bytes of chunks that leave a task together
# The base-32 alphabet, and the end of a record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

CHUNKS = (
    "record string, type string, id bigint, url string, chunk int, last boolean, n_bytes bigint, total bigint, "
    "sha1 string, header_sha1 string, header_bytes bigint, refers_to string, refers_to_id bigint"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four characters."""
    groups = [F.conv(F.substring(F.sha1(payload), i, 5), 16, 10).cast("int") for i in range(1, 41, 5)]
    five = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[five(v, shift) for v in groups for shift in (15, 10, 5, 0)])


def _urn(*parts: Column) -> Column:
    """A record identifier that follows from what the record is, so a task that runs again writes the same one."""
    h = F.sha2(F.to_json(F.struct(*parts)), 256)
    piece = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *piece), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in fields])


def _one_line(text: Column) -> Column:
    """A url on one line: control characters and blanks as a percent sign and two digits."""
    parts = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"^[\x00-\x20\x7f]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(text.rlike(r"[\x00-\x20\x7f]"), F.array_join(parts, "")).otherwise(text)


def _keyed(pages: DataFrame, id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """Rows (key, id, url, payload): records of one key are one response and its revisits."""
    body = F.coalesce(F.col(payload).cast("string").cast("binary") if dict(pages.dtypes)[payload] != "binary" else F.col(payload), F.lit(b""))
    rows = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2("payload", 256))))


def write_archives(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 0, segment: int = SEGMENT, date: str | None = None,
) -> None:
    """Write a record for every row of pages into gzip files of a new folder; date as in 2024-01-31T00:00:00Z, None: now.

    Of rows with equal payloads of at least least_bytes bytes the one with the smallest id is a response (nulls last; ties: the
    smallest url; of rows alike in both any one), the others are revisits that refer to it; rows with smaller payloads are
    responses. A null payload is empty, a null id or url has no header line, control characters and blanks of a url are
    percent-encoded. Other columns are not read, no rows make a folder without records.
    """
    rows = _keyed(pages, id, url, payload, least_bytes)
    # rows alike in key, id and url are counted by the task that reads them, so that no task ever numbers very many of them
    told = rows.where("key is not null").select("key", "id", "url", F.octet_length("payload").cast("bigint").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    alike = told.groupBy("key", "id", "url", "n_bytes", "sha1", F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    alike = cut(alike, "warc-rows")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url", "part")
    firsts = alike.groupBy("key", "n_bytes", "sha1").agg(F.min(order).alias("first"), F.sum("n").alias("copies"))
    firsts = cut(firsts, "warc-firsts")
    urn = lambda at, nth: _urn(F.hex("key"), at["id"], at["url"], at["part"], nth)
    # one copy of each payload leaves a task
    bodies = rows.where("key is not null").groupBy("key").agg(F.first("payload").alias("payload"))
    first = F.col("first")
    whole = bodies.join(firsts, "key").select(first["id"].alias("id"), first["url"].alias("url"), urn(first, F.lit(0)).alias("urn"), "n_bytes", "sha1", "payload")
    few = rows.where("key is null").withColumn("row", F.monotonically_increasing_id()).select(
        "id", "url", _urn(F.lit("small"), F.col("id"), F.col("url"), F.col("row")).alias("urn"), F.octet_length("payload").cast("bigint").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"), "payload"
    )
    repeated = firsts.where("copies > 1").select("key", first.alias("first"))
    here = F.struct("id", "url", "part")
    # never one before the first row of the group; each row of alike stands for what one task read
    nth = F.explode(F.expr("filter(sequence(0, cast(n as int) - 1), i -> i > 0 or not (id <=> first.id and url <=> first.url and part = first.part))"))
    again = alike.join(repeated, "key").withColumn("nth", nth).select(
        "id", "url", urn(here, F.col("nth")).alias("urn"), "n_bytes", "sha1", urn(first, F.lit(0)).alias("to"), first["id"].alias("to_id"), first["url"].alias("to_url")
    )
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    texts = _responses(whole.unionByName(few) if least_bytes > 0 else whole, when, segment).unionByName(_revisits(again, when))
    texts.write.option("lineSep", END).option("compression", "gzip").text(path)
    dropped(alike)
    dropped(firsts)


def _responses(rows: DataFrame, when: Column, segment: int) -> DataFrame:
    """A line for each segment of each payload, without the separator that ends a record."""
    parts = F.greatest(F.ceil(F.col("n_bytes") / segment), F.lit(1)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("payload"), i * segment + 1, F.lit(segment)).alias("data")))
    # the payload itself is left behind here: the row of a segment holds the segment
    cut_up = rows.select("id", "url", "urn", "n_bytes", "sha1", parts.alias("parts"), F.explode(cuts).alias("s")).select("*", "s.at", "s.data")
    begins, several, ends = F.col("at") == 0, F.col("parts") > 1, F.col("at") == F.col("parts") - 1
    block = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), F.lit(END))
    own = F.when(begins, F.col("urn")).otherwise(_urn(F.col("urn"), F.col("at")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(begins, "response").otherwise("continuation")), ("WARC-Record-ID", own), ("WARC-Date", when),
            ("WARC-Target-URI", _one_line(F.col("url"))), ("Page-ID", F.when(begins, F.col("id"))),
            ("Content-Type", F.when(begins, "application/http; msgtype=response")), ("WARC-Payload-Digest", F.when(begins, F.concat(F.lit("sha1:"), "sha1"))),
            ("WARC-Segment-Number", F.when(several, F.col("at") + 1)), ("WARC-Segment-Origin-ID", F.when(~begins, F.col("urn"))),
            ("WARC-Segment-Total-Length", F.when(several & ends, F.col("n_bytes") + F.octet_length(block))),
            ("Content-Length", F.octet_length("data") + F.when(begins, F.octet_length(block)).otherwise(0)),
        ),
        F.lit("\r\n"), F.when(begins, block).otherwise(""),
    )
    return cut_up.select(F.concat(head.cast("binary"), F.col("data")).cast("string").alias("value"))


def _revisits(rows: DataFrame, when: Column) -> DataFrame:
    """A line for each revisit: the header of the answer without its payload."""
    block = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), F.lit(END))
    head = _lines(
        ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", F.col("urn")), ("WARC-Date", when), ("WARC-Target-URI", _one_line(F.col("url"))), ("Page-ID", F.col("id")),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        ("WARC-Refers-To", F.col("to")), ("WARC-Refers-To-Target-URI", _one_line(F.col("to_url"))), ("Refers-To-Page-ID", F.col("to_id")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block)),
    )
    return rows.select(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block).alias("value"))


class _Parser:
    """Takes the lines of one file in order and gives out chunks; holds at most one chunk and one header."""

    def __init__(self, chunk: int, with_data: bool):
        self.chunk, self.with_data = chunk, with_data
        self.state, self.fields, self.left, self.head_left = "between", {}, 0, False
        self.now: dict | None = None  # the record whose payload runs
        self.held, self.size = [], 0

    def feed(self, lines: Iterable[bytes]) -> Iterator[tuple]:
        for line in lines:
            if self.state == "body":
                if len(line) < self.left:  # the line feed belongs to the block, too
                    self.left -= len(line) + 1
                    yield from self._body(line, True)
                    if not self.left:
                        self.state = "between"
                    continue
                # the block ends inside this line; what follows it is the end of the record
                tail, line = line[self.left :], line[: self.left]
                self.left = 0
                yield from self._body(line, False)
                self.state = "between"
                if tail not in (b"", b"\r"):
                    raise ValueError(f"a record's content is longer than its length says: {self.fields.get('warc-record-id')}")
                continue
            if self.state == "between":
                if line in (b"", b"\r"):
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no record begins with {line[:40]!r}")
                self.state, self.fields = "head", {}
            elif line in (b"", b"\r"):
                yield from self._open()
            elif line[:1] in b" \t" and self.fields:  # a folded line
                last = next(reversed(self.fields))
                self.fields[last] += " " + line.decode("utf-8", "replace").strip()
            else:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.fields[name.strip().lower()] = value.strip()

    def finish(self) -> Iterator[tuple]:
        if self.state != "between":
            raise ValueError("an archive ends inside a record")
        yield from self._done()

    def _open(self) -> Iterator[tuple]:
        f = self.fields
        kind = f.get("warc-type", "")
        if kind == "continuation":
            if not self.now or self.now["record"] != f.get("warc-segment-origin-id"):
                raise ValueError("segments of a record must follow each other in one file")
            self.head_left = False
        else:
            yield from self._done()
            digest = f.get("warc-payload-digest", "")
            self.now = {
                "record": f.get("warc-record-id"), "type": kind, "id": _number(f.get("page-id")), "url": f.get("warc-target-uri"), "chunk": 0, "total": 0,
                "sha1": hashlib.sha1(), "header_sha1": digest.removeprefix("sha1:") or None, "header_bytes": None,
                "refers_to": f.get("warc-refers-to"), "refers_to_id": _number(f.get("refers-to-page-id")),
            }
            self.head_left = f.get("content-type", "").startswith("application/http")
        self.left = int(f.get("content-length", 0))
        self.state = "body" if self.left else "between"

    def _body(self, line: bytes, fed: bool) -> Iterator[tuple]:
        if self.head_left:
            if line in (b"", b"\r"):
                self.head_left = False
            elif m := re.match(rb"(?i)content-length:\s*(\d+)", line):
                self.now["header_bytes"] = int(m[1])
            return
        self.held.append(line + b"\n" if fed else line)
        self.size += len(self.held[-1])
        # a chunk goes out when more than a chunk is there: the last one is only known at the end
        while self.size > self.chunk:
            data = b"".join(self.held)
            yield self._row(data[: self.chunk], False)
            self.held, self.size = [data[self.chunk :]], len(data) - self.chunk

    def _done(self) -> Iterator[tuple]:
        if self.now:
            yield self._row(b"".join(self.held), True)
            self.now, self.held, self.size = None, [], 0

    def _row(self, data: bytes, last: bool) -> tuple:
        n = self.now
        n["sha1"].update(data)
        n["total"] += len(data)
        row = (
            n["record"], n["type"], n["id"], n["url"], n["chunk"], last, len(data), n["total"], base64.b32encode(n["sha1"].digest()).decode(),
            n["header_sha1"], n["header_bytes"], n["refers_to"], n["refers_to_id"],
        )
        n["chunk"] += 1
        return (*row, data) if self.with_data else row


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def read_chunks(spark: SparkSession, path: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The records of all gzip files of a folder as rows, a chunk of payload each; data only if asked for.

    chunk counts from 0 in a record, last marks its last one. n_bytes is a chunk's own length; total and sha1 (upper-case base 32) are the
    length and digest of the payload up to the chunk's end. header_sha1 and header_bytes are what the record's headers say of the whole
    payload, also for revisits, which have no payload of their own. An empty payload is one chunk of no bytes. Broken
    archives (a length that doesn't fit, a file that ends early) are errors. Files are read from their starts, by a task each.
    """
    schema = CHUNKS + ", data binary" * with_data
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    kinds += [pa.binary()] * with_data
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, rows, size = None, None, [], 0

        def out(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal rows, size
            for row in found:
                rows.append(row)
                size += 300 + (len(row[-1]) if with_data else 0)
                if size >= BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0

        for batch in batches:
            files = batch.column("file").to_numpy()
            bounds = [0, *(1 + i for i in range(len(files) - 1) if files[i] != files[i + 1]), len(files)] if len(files) and files[0] != files[-1] else [0, len(files)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if files[a] != file:
                    if parser:
                        yield from out(parser.finish())
                    parser, file = _Parser(chunk, with_data), files[a]
                yield from out(parser.feed(batch.column("value").slice(a, b - a).to_pylist()))
        if parser:
            yield from out(parser.finish())
        if rows:
            yield batch_of(rows)

    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(parse, schema)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row a record from its last chunk: record, type, id, url, payload_bytes, payload_digest, refers_to, refers_to_id, intact.

    Length and digest are those of the payload that was read; of a revisit, those its headers give. intact: what was read agrees with the headers.
    """
    revisit = F.col("type") == "revisit"
    last = chunks.where("last")
    agrees = (F.col("sha1") == F.coalesce("header_sha1", "sha1")) & (F.col("total") == F.coalesce("header_bytes", "total"))
    return last.select(
        "record", "type", "id", "url", F.when(revisit, F.col("header_bytes")).otherwise(F.col("total")).alias("payload_bytes"),
        F.when(revisit, F.col("header_sha1")).otherwise(F.col("sha1")).alias("payload_digest"), "refers_to", "refers_to_id", (revisit | agrees).alias("intact"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the application's intermediate tables."""
    return f"{stage_root(spark)}/warc-{uuid.uuid4().hex}"
