"""Sub-word tokens against a plain walk, and tables that two jobs ask for at once."""

import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import subwords
from cladeworks.sources import leases

PIECES = ["a", "b", "ab", "abc", "ba", "é", "x", ".", "##a", "##b", "##bc", "##ab", "##é", "##x", "c", "##", "-"]


def plain(word, ids):
    out, at = [], 0
    if len(word) > subwords.LONGEST_WORD:
        return [ids["[UNK]"]]
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in ids and piece not in subwords.SPECIAL and piece != "##":
                out.append(ids[piece])
                at = end
                break
        else:
            return [ids["[UNK]"]]
    return out


def ids_of(text, ids):
    if not text:
        return [ids["[EMPTY]"]]
    return [i for w in re.findall(subwords.WORD, text.translate(str.maketrans(subwords.UPPER, subwords.LOWER))) for i in plain(w, ids)]


def windows(tokens, length, ids):
    room = length - 2
    parts = [tokens[i : i + room] for i in range(0, len(tokens), room)] or [[]]
    out = []
    for p in parts:
        full = [ids["[CLS]"], *p, ids["[SEP]"]]
        out.append((full + [ids["[PAD]"]] * (length - len(full)), [1] * len(full) + [0] * (length - len(full))))
    return out


def test_encoding_equals_a_plain_walk(spark):
    rng = random.Random(4)
    vocab = subwords.vocabulary(spark, PIECES)
    ids = {r.piece: r.id for r in vocab.collect()}
    texts = ["".join(rng.choice("aabbcxé .-\nAB!") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "   ", "a" * 100, "a" * 101, "zz top", "ab" * 49 + "z"]
    rows = [(i, t, rng.choice(texts), "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key long, title string, body string, word string").repartition(3)
    got = {(r.key, r.window): r for r in subwords.encoded(df, "key", {"title": 8, "body": 20}, vocab).collect()}
    n = 0
    for key, title, body, _ in rows:
        a, b = windows(ids_of(title, ids), 8, ids), windows(ids_of(body, ids), 20, ids)
        for w in range(max(len(a), len(b))):
            r = got[key, w]
            none = lambda k: ([ids["[PAD]"]] * k, [0] * k)
            assert (r.title_ids, r.title_mask) == (a[w] if w < len(a) else none(8)), title
            assert (r.body_ids, r.body_mask) == (b[w] if w < len(b) else none(20)), body
            n += 1
    assert n == len(got)


def test_odd_vocabularies(spark):
    vocab = subwords.vocabulary(spark, [])
    df = spark.createDataFrame([(1, "some words")], "id int, text string")
    r = subwords.encoded(df, "id", {"text": 5}, vocab).first()
    assert r.text_ids == [2, 1, 1, 3, 0] and r.text_mask == [1, 1, 1, 1, 0]
    assert subwords.encoded(df.limit(0), "id", {"text": 5}, vocab).count() == 0
    with pytest.raises(ValueError, match="three places"):
        subwords.encoded(df, "id", {"text": 2}, vocab)


def test_two_writers_make_one_table(spark, tmp_path):
    path, made, got = f"{tmp_path}/tokens", [], []

    def make():
        made.append(1)
        time.sleep(1.5)
        return spark.range(10)

    def ask():
        got.append(leases.made_once(spark, path, make, poll=0.1).count())

    threads = [threading.Thread(target=ask) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [10] * 4 and len(made) == 1
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["tokens"]
    assert leases.made_once(spark, path, make).count() == 10 and len(made) == 1


def test_a_failed_writer_leaves_nothing_and_a_dead_one_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/tokens"

    def fails():
        return spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))

    with pytest.raises(Exception, match="no"):
        leases.made_once(spark, path, fails)
    assert not (tmp_path / "tokens").exists() and not (tmp_path / "tokens.lease").exists()
    (tmp_path / "tokens.lease").write_text("a job that died")
    with pytest.raises(TimeoutError):
        leases.made_once(spark, path, lambda: spark.range(3), wait_seconds=0.5, poll=0.1)
    time.sleep(1.1)
    assert leases.made_once(spark, path, lambda: spark.range(3), lease_seconds=1, poll=0.1).count() == 3
