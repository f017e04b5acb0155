"""Operator 11 against SQL, plain computations and archives written by hand."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladeworks.llm import queries, warc

PAGES = "page_id bigint, url string, html string, key string, payload string"


def test_agrees_with_sql(same_rows):
    same_rows(queries.queries()["op11_warc"], queries.oracle_sql()["op11_warc"])


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def odd_pages():
    rng = random.Random(3)
    odd = ["", None, "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "x\n", "\n", "\r", "é" * 700, "ends in a return\r", "a\r\n" * 300, "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"]
    rows = [(i, f"http://h/{i}", rng.choice(odd)) for i in range(60)]
    rows += [(7, "http://h/7", "twice")] * 3 + [(None, None, "no id"), (None, "http://h/x", "no id"), (8, None, "no url"), (9, "http://h/a b\r\nPage-ID: 1\r\n", "a url of two lines")]
    rows += [(100 + i, f"http://long/{i}", ("0123456789é\n" * rng.randint(50, 400))[: rng.randint(1, 4000)]) for i in range(20)]
    return rows


def want(rows, least=0):
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page, url))
    out = []
    for body, pages in groups.items():
        pages.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or ""))
        for nth, (page, _) in enumerate(pages):
            first = nth == 0 or len(body) < least
            out.append((page, len(body), sha(body), "response" if first else "revisit", None if first else pages[0][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("segment", "chunk", "least"), [(1 << 18, 1 << 18, 0), (7, 5, 0), (64, 1000, 10), (1000, 64, 5000)])
def test_round_trip(spark, tmp_path, segment, chunk, least):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)
    warc.write_archives(pages, f"{tmp_path}/a", least_bytes=least, segment=segment)
    chunks = warc.read_chunks(spark, f"{tmp_path}/a", chunk=chunk)
    got = warc.read_records(chunks).collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.type, r.refers_to_id) for r in got), key=str) == want(rows, least)
    assert all(r.intact for r in got) and len({r.record for r in got}) == len(rows)
    # the chunks of a record are its payload, in order, none larger than asked for, each with the digest so far
    bodies = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.record, r.chunk)):
        body = bodies[r.record] = bodies.get(r.record, b"") + bytes(r.data)
        assert len(r.data) == r.n_bytes <= chunk and r.total == len(body) and r.sha1 == sha(body)
    assert all(sha(bodies[r.record]) == r.payload_digest for r in got if r.type == "response") and not any(bodies[r.record] for r in got if r.type == "revisit")
    # revisits name the record that they refer to
    records = {r.record: r for r in got}
    for r in got:
        assert r.type == "response" or records[r.refers_to].payload_digest == r.payload_digest


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/a")
    assert warc.read_records(warc.read_chunks(spark, f"{tmp_path}/a")).count() == 0


def test_archives_are_what_the_format_says(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 25, "", ""), (2, "http://b/", "x" * 25, "", "")], PAGES)
    warc.write_archives(pages, f"{tmp_path}/a", segment=10, date="2024-01-31T00:00:00Z")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/a").glob("*.gz"))
    records = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n" and fields["WARC-Date"] == "2024-01-31T00:00:00Z"
        records.append((fields, rest[:n]))
        data = rest[n + 4 :]
    kinds = sorted(f["WARC-Type"] for f, _ in records)
    assert kinds == ["continuation", "continuation", "response", "revisit"]
    first = next(f for f, _ in records if f["WARC-Type"] == "response")
    parts = sorted(((int(f["WARC-Segment-Number"]), b) for f, b in records if "WARC-Segment-Number" in f))
    assert b"".join(b for _, b in parts).endswith(b"\r\n\r\n" + b"x" * 25)
    last = next(f for f, _ in records if f.get("WARC-Segment-Number") == "3")
    assert int(last["WARC-Segment-Total-Length"]) == sum(len(b) for _, b in parts) and last["WARC-Segment-Origin-ID"] == first["WARC-Record-ID"]


def foreign(*records):
    return b"".join(b"WARC/1.0\r\n" + b"".join(b"%s: %s\r\n" % (k, v) for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n" for fields, body in records)


def test_foreign_archives(spark, tmp_path):
    folder = Path(f"{tmp_path}/f")
    folder.mkdir()
    whole = b"HTTP/1.1 200 OK\r\ncontent-length: 6\r\n\r\nab\r\ncd"
    records = foreign(
        ([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<i>")], b"software: x\r\n"),
        ([(b"warc-type", b"response"), (b"warc-record-id", b"<r>"), (b"Content-Type", b"application/http;\r\n msgtype=response")], whole),
        ([(b"WARC-Type", b"metadata"), (b"WARC-Record-ID", b"<m>")], b""),
    )
    # a member per record, as archives usually have it
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0" + x) for x in records.split(b"WARC/1.0")[1:]))
    (folder / "b.warc.gz").write_bytes(gzip.compress(records.replace(b"<", b"<2")))
    got = {r.record: (r.type, r.payload_bytes, r.payload_digest) for r in warc.read_records(warc.read_chunks(spark, str(folder))).collect()}
    for n in ("", "2"):
        assert got[f"<{n}r>"] == ("response", 6, sha(b"ab\r\ncd")) and got[f"<{n}i>"][1:] == (13, sha(b"software: x\r\n")) and got[f"<{n}m>"][1] == 0


@pytest.mark.parametrize("broken", [lambda b: b[:-30], lambda b: b.replace(b"Content-Length: 25", b"Content-Length: 24"), lambda b: b"no record\r\n" + b])
def test_broken_archives_are_errors(spark, tmp_path, broken):
    folder = Path(f"{tmp_path}/f")
    folder.mkdir()
    (folder / "a.gz").write_bytes(gzip.compress(broken(foreign(([(b"WARC-Type", b"resource")], b"y" * 25)))))
    with pytest.raises(Exception, match="archive ends|longer than|no record begins"):
        warc.read_records(warc.read_chunks(spark, str(folder))).collect()


def test_an_oversized_payload_is_read_in_chunks(spark, tmp_path):
    body = F.repeat(F.lit("0123456789abcde\n"), 1 << 20)  # 16 MB
    pages = spark.range(2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(body, F.col("id").cast("string")).alias("html"))
    warc.write_archives(pages, f"{tmp_path}/a")
    rows = warc.read_chunks(spark, f"{tmp_path}/a", with_data=False).groupBy("id").agg(F.count("*").alias("n"), F.max("n_bytes").alias("most"), F.max("total").alias("total"), F.max_by("sha1", "chunk").alias("sha1")).collect()
    for r in rows:
        assert (r.n, r.most, r.total) == (65, 1 << 18, (1 << 24) + 1) and r.sha1 == sha(b"0123456789abcde\n" * (1 << 20) + str(r.id).encode())
    assert len(rows) == 2
