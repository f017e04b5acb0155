"""Operators 2, 3, 4 and 10 and the pipeline against brute force and SQL."""

import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeworks.llm import decontaminate, mixing, near_join, quality_classifier, queries
from cladeworks.llm.components import connected_components

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string"


def words(text):
    return decontaminate.words_of(text)


@pytest.mark.parametrize("name", ["op2_near_join", "op4_decontaminate"])
def test_agrees_with_sql(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


# --- 2: near-duplicates

def near_texts():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    texts = [None, "", "!!", "one two", "One, TWO", "one two three four five six"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts += [texts[-1]] * 5
    return texts


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        group = [min([group[i]] + [group[j] for j in range(n) if near[i][j]]) for i in range(n)]
    least = {g: min((rows[i][0] for i in range(n) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[i][0], least[group[i]], sum(near[i])) for i in range(n)), key=str)


@pytest.mark.parametrize("block", [1000, 3])
def test_classes_against_all_pairs(spark, monkeypatch, block):
    for name in ("BLOCK", "TEXTS", "MOST_TEXTS"):
        monkeypatch.setattr(near_join, name, block)
    rows = [(i + 10, t) for i, t in enumerate(near_texts())]
    rows += [rows[-1], (None, rows[-1][1]), (None, rows[20][1]), (15, rows[20][1]), (15, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", "s", 1, "clash") for i, t in rows], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_join.near_duplicates(df).collect()), key=str)
    assert got == brute_classes(rows)
    assert near_join.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Ids that repeat with other texts and null ids are told apart by text; wordless rows stay."""
    long = [f"{c} " + " ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(1, long[0]), (1, long[1]), (2, long[0] + " more"), (None, long[2]), (None, long[2] + " z"), (None, long[1]), (7, long[3]), (7, long[3]), (None, long[4]), (8, ""), (9, None), (9, "!!")]
    df = spark.createDataFrame([(i, t, "x", "s", 1, "n") for i, t in rows], DOCS).repartition(4)
    kept = near_join.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    rest = {k: n for k, n in got.items() if k[0] is not None or k[1] == long[4]}
    assert rest == {(1, long[0]): 1, (1, long[1]): 1, (7, long[3]): 1, (None, long[4]): 1, (8, ""): 1, (9, None): 1, (9, "!!"): 1}
    assert sum(n for (i, t), n in got.items() if i is None and t != long[4]) == 1
    assert near_join.keep_one(df.limit(0)).count() == 0


def test_depth_follows_what_was_found():
    """Few values are enough for copies; links at the threshold shorten the prefix to the bound, never further."""
    least = near_join.forest_depth()
    assert near_join.met_share(0.8, least) >= near_join.RECALL > near_join.met_share(0.8, least + 1)
    assert near_join.forest_depth({0.99: 1000.0}) == near_join.DEEPEST
    depths = [near_join.forest_depth({0.99: 1000.0, 0.8: n}) for n in (0.0, 1.0, 20.0, 1e6)]
    assert depths == sorted(depths, reverse=True) and depths[0] == near_join.DEEPEST and depths[-1] == least
    assert near_join.forest_depth({0.75: 5.0}) == least


def set_pair(rng, common, each):
    pool = rng.integers(0, 1 << 63, common + 2 * each, np.uint64)
    return np.sort(pool[: common + each]), np.sort(np.concatenate([pool[:common], pool[common + each :]]))


def test_recall_at_and_below_the_threshold():
    """Of pairs at 0.8 all but a few pass the forest and the screen; of pairs at 0.3 hardly any."""
    rng = np.random.default_rng(2)
    depth = near_join.forest_depth()
    passed = {}
    for name, common, each in (("at", 96, 12), ("long", 4800, 600), ("below", 36, 42)):
        passed[name] = 0
        for _ in range(300):
            values = [near_join.minhashes(x, near_join.TREES * near_join.DEEPEST) for x in set_pair(rng, common, each)]
            low = [(v & 0xFFFF).reshape(near_join.TREES, -1)[:, :depth] for v in values]
            sketch = [np.frombuffer(near_join.forest_paths(v)[1], np.uint8) for v in values]
            passed[name] += bool((low[0] == low[1]).all(axis=1).any() and (sketch[0] == sketch[1]).mean() >= near_join.SCREEN)
    assert passed["at"] >= 299 and passed["long"] >= 299 and passed["below"] <= 3


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(4)
    for common, each in ((90, 5), (400, 100), (3000, 1500)):
        shares = []
        for _ in range(30):
            a, b = (near_join.minhashes(x, 128) for x in set_pair(rng, common, each))
            shares.append((a == b).mean())
        assert abs(np.mean(shares) - common / (common + 2 * each)) < 0.03


def test_depth_is_measured_on_the_table(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 300, 5)]  # alike at about 0.96
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = []
    real = near_join.forest_depth
    try:
        near_join.forest_depth = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
        got = near_join.near_duplicates(df).collect()
    finally:
        near_join.forest_depth = real
    assert seen[0] > real() and {r.class_id for r in got} == {0} and all(r.n_links == len(texts) - 1 for r in got)


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    got = near_join.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
    wide = [np.unique(rng.integers(0, 1 << 64, 400, np.uint64) >> np.uint64(55) << np.uint64(55)) for _ in range(6)]
    assert (near_join.common_counts(wide) == near_join.common_counts(wide, most=100)).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(None, 3), (7, 7)]
    root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == root


# --- 3: mixing

def test_every_document_once_near_its_weight(spark):
    sizes = {"big": 900, "mid": 300, "small": 40, "": 7}
    rows = [(i, s or None, "k") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(None, "mid", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, slot string")
    weights = {"big": 0.5, "mid": 0.3, "small": 0.15, "": 0.05}
    got = sorted(mixing.mix(df, weights).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    # until the first source runs out each one stays within a block of its share at every slot
    seen, placed = Counter(), Counter((r.slot, r.source or "") for r in got)
    by_slot = {slot: s for slot, s in placed}
    for t in range(max(by_slot) + 1):
        if t not in by_slot:
            break
        seen[by_slot[t]] += 1
        assert all(abs(seen[s] - Fraction(str(w)) * (t + 1)) < 1 for s, w in weights.items())
    assert t > 5
    again = mixing.mix(df.repartition(7), weights).collect()
    assert {r.doc_id: r.position for r in again} == {r.doc_id: r.position for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def some_weights(rng):
    kind = rng.randrange(4)
    n = rng.randint(1, 12)
    if kind == 0:
        return [Fraction(rng.random() + 0.01) for _ in range(n)]
    if kind == 1:
        return [Fraction(rng.randint(1, 6)) for _ in range(n)]
    if kind == 2:
        return [Fraction(2.0 ** -rng.randint(0, 12)) for _ in range(n)]
    return [Fraction(math.sqrt(2)), Fraction(math.pi), Fraction(0.0001)] + [Fraction(0.01)] * n


def test_slots_are_earliest_deadline_first_whatever_the_ranges():
    """Every slot gets the released block of the earliest deadline, and a range that starts anywhere goes on as one that started at 0."""
    rng = random.Random(6)
    for _ in range(60):
        shares = mixing.whole_weights(some_weights(rng))
        assert sum(shares.parts.tolist()) == shares.whole
        done, whole = [0] * len(shares.parts), []
        for t in range(400):
            assert mixing.placed_before(shares, t).tolist() == done
            ready = {i: (shares.due(i, n), i) for i, n in enumerate(done) if shares.released(i, n) <= t}
            i = min(ready, key=ready.get)
            assert ready[i][0] >= t + 1  # no deadline is missed
            whole.append((t, i, done[i]))
            done[i] += 1
            assert all(abs(n - Fraction(int(p), shares.whole) * (t + 1)) < 1 for n, p in zip(done, shares.parts))
        cuts = sorted({0, 400, *(rng.randrange(400) for _ in range(6))})
        assert [x for a, b in zip(cuts, cuts[1:]) for x in mixing.scheduled(shares, a, b)] == whole


def test_shares_hold_far_out():
    """A million slots on, and at the last slot of a stage, blocks are within one of the given weights."""
    weights = [Fraction(0.70043), Fraction(0.29947), Fraction(0.0001), Fraction(math.pi / 100)]
    shares = mixing.whole_weights(weights)
    for begin in (1_000_000, 204_800, mixing.LAST_SLOT - 3000):
        done = mixing.placed_before(shares, begin).tolist()
        for t, i, block in mixing.scheduled(shares, begin, begin + 3000):
            assert block == done[i]
            done[i] += 1
            assert all(abs(n - w / sum(weights) * (t + 1)) < 1 for n, w in zip(done, weights))


def test_stages_place_every_block_once():
    rng = random.Random(8)
    for _ in range(40):
        weights = some_weights(rng)
        blocks = np.array([rng.choice([1, 3, 50, 200]) for _ in weights])
        stages = mixing.staged_plan(weights, blocks)
        seen = Counter()
        for s in stages:
            for _, i, block in mixing.scheduled(s.shares, 0, s.slots):
                if s.before[i] + block < s.after[i]:
                    seen[s.sources[i], int(s.before[i] + block)] += 1
        assert seen == Counter((i, j) for i, n in enumerate(blocks) for j in range(n))
        assert sum(s.slots for s in stages) <= 2 * blocks.sum() + 4 * len(blocks) * len(stages)


def test_shares_of_many_ranges(spark, monkeypatch):
    """Weights that are no fractions of a small period, over 200 ranges: each source is within a block of its given weight at every slot."""
    weights = {"a": 0.70043, "b": 0.29947, "c": 0.0001}
    df = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 14_000, "a").when(F.col("id") < 23_900, "b").otherwise("c").alias("source"))
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    rows = mixing.mix(df, weights, range_slots=32).collect()
    assert sorted(r.position for r in rows) == list(range(24_000))
    by_slot = {r.slot: r.source for r in rows}
    blocks, seen = {"a": 3500, "b": 2475, "c": 25}, Counter()
    for t in range(4990):  # until a runs out
        seen[by_slot.get(t)] += 1
        assert all(abs(seen[s] - w * (t + 1) / sum(weights.values())) < 1 for s, w in weights.items() if seen[s] < blocks[s]), t
    assert len({r.slot for r in rows}) == 6000


def test_a_hundred_thousand_sources(spark):
    df = spark.range(150_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50_000, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"))
    got = mixing.mix(df).agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi")).first()
    assert tuple(got) == (150_000, 150_000, 0, 149_999)


def test_many_sources_and_odd_columns(spark, monkeypatch):
    """5,000 sources; input columns keep their names and values."""
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    df = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4999).cast("string"))).alias("source"),
        F.lit("a").alias("_source"), F.lit(5).alias("_n"), F.lit(None).cast("int").alias("_all"),
    )
    rows = mixing.mix(df).collect()
    assert sorted(r.position for r in rows) == list(range(12_000)) and {(r["_source"], r["_n"], r["_all"]) for r in rows} == {("a", 5, None)}
    by_place = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in by_place] == sorted(r.slot for r in by_place)
    assert max(Counter(r.slot for r in rows).values()) <= mixing.BLOCK_DOCS
    for bad in ({}, {"hot": 0.0}, {"hot": -1.0}):
        with pytest.raises(ValueError):
            mixing.mix(df, bad)
    assert mixing.mix(df.limit(0), {"hot": 1.0}).count() == 0


def test_hot_sources_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 10)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mixing.numbered(df, mixing.named_source()).collect()
    for s in "ab":
        assert sorted(r._n for r in got if r.source == s) == list(range(sum(r.source == s for r in got)))


# --- 4: decontamination

def test_windows_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "dd", "É", "7", "漢"]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 14]))) for _ in range(25)] + [None, "C, dd!", "solo"]
    texts = [None, "", "C dd", "solo", *items[:10]] + [" - ".join(rng.choice(vocab) for _ in range(rng.randint(1, 400))) + " " + (rng.choice(items) or "") for _ in range(60)]
    docs = spark.createDataFrame([(i // 2, t, "x", "s", 1, "n") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)] + [(3, items[3], "z"), (None, "a b", "z")], "item_id bigint, text string, words string")
    want = []
    for i, text in enumerate(texts):
        w = words(text)
        hit, found = set(), set()
        for item, t in enumerate(items):
            u = words(t)
            for run in [u[k : k + 10] for k in range(max(1, len(u) - 9))] if u else []:
                for at in range(len(w) - len(run) + 1):
                    if w[at : at + len(run)] == run:
                        hit |= set(range(at, at + len(run)))
                        found.add(str(item))
        want.append((i // 2, len(w), len(hit), ",".join(sorted(found))))
    for limit, block in (("BLOCK_WORDS", decontaminate.BLOCK_WORDS), ("BLOCK_BYTES", 300), ("BLOCK_WORDS", 60)):
        monkeypatch.undo()
        monkeypatch.setattr(decontaminate, limit, block)
        got = decontaminate.contamination(docs, bench).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == sorted(want)
        kept = decontaminate.decontaminate(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# --- 10: quality

def test_held_out_accuracy(spark):
    scored = queries.op10_quality(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(bad) > 3
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    for r in scored.limit(50).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_odd_rows_and_missing_labels(spark):
    rows = [(i, t, "x", "s", 1, "n") for i, t in enumerate([None, "", "   ", "word", "É" * 3000, "a b " * 4000])] + [(None, "word", "x", "s", 1, "n")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    for labels in ([], [(1, None), (2, 1)], [(0, 1), (2, 1), (3, 1)]):
        model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        got = quality_classifier.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"some text {i} " * (i + 1), 1, 2, 3) for i in range(30)], "doc_id bigint, text string, _id int, _label int, fold int")
    model = quality_classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int"))
    assert quality_classifier.score(docs, model).select("_id", "_label", "fold", "score").count() == 30


def test_normal_equations_against_direct_ridge(spark):
    """The weights that partitions' sums give are those of one ridge regression over all fitted rows."""
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["Good", "words.", "1|2", "!!", "and", "more", "##"]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    labels = [int(t.count("!!") * 8 < len(t.split())) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    model = quality_classifier.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, quality int"), n_features=40)
    fold = [zlib.crc32(str(i).encode()) % quality_classifier.FOLDS for i in range(400)]
    stats = np.array([quality_classifier.text_stats(t) for t in texts])
    known = np.array(fold) != 0
    assert np.allclose(model.mean, stats[known].mean(axis=0)) and np.allclose(model.scale, np.maximum(stats[known].std(axis=0), 1e-6))
    fitted = np.array(fold) > 1
    x, y = model.features(stats[fitted]), np.array(labels, float)[fitted]
    n, width = x.shape
    # the same minimum by least squares on stacked rows
    stacked = np.vstack([x / np.sqrt(n), np.sqrt(quality_classifier.RIDGE / 40) * np.eye(width)])
    direct = np.linalg.lstsq(stacked, np.append(y / np.sqrt(n), np.zeros(width)), rcond=None)[0]
    assert np.allclose(model.raw(stats), model.features(stats) @ direct, atol=1e-6)


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(16)
    k, n = len(quality_classifier.STATS), 20_000
    model = quality_classifier.Model(np.zeros(k), np.ones(k), rng.normal(0, 1 / np.sqrt(k), (k, n)), rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1), np.array([]), np.array([]))
    x = rng.normal(0, 1, (30, k))
    wave = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * k))
    assert np.abs(wave @ wave.T - exact).max() < 0.05


def test_calibration_against_all_monotone_fits():
    """Pooled levels are the least squares fit among monotone sequences: those of every way to cut the points into runs."""
    rng = np.random.default_rng(17)
    for _ in range(20):
        n = 8
        y, w = rng.random(n), rng.integers(1, 5, n).astype(float)
        best = None
        for cuts in itertools.product([0, 1], repeat=n - 1):
            runs = np.split(np.arange(n), [i + 1 for i, c in enumerate(cuts) if c])
            level = np.concatenate([np.full(len(r), np.average(y[r], weights=w[r])) for r in runs])
            if (np.diff(level) >= 0).all() and (best is None or (w * (y - level) ** 2).sum() < (w * (y - best) ** 2).sum() - 1e-12):
                best = level
        _, levels = quality_classifier.isotonic(np.arange(n, dtype=float), y * w, w)
        assert np.allclose(np.unique(best.round(9)), np.unique(levels.round(9)))


def test_isotonic_is_monotone():
    rng = np.random.default_rng(8)
    x = np.sort(rng.normal(size=50))
    knots, levels = quality_classifier.isotonic(x, (rng.random(50) < 0.5 + x / 6).astype(float), np.ones(50))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


# --- the pipeline

def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty texts and an empty table pass through every stage."""
    long = " ".join(f"Word{i} is here." for i in range(200))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, long + " tail", "en", "a", None), (None, None, None, None, None), (None, "", None, None, 0), (3, "   ", "xx", "", 3), (None, long, "en", None, 9), (4, "a@b.cc and words", "en", "b", 16)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows += [(i, f"Plain text number {i} with words enough to read.", "en", "a", 40) for i in range(10, 60)]
    spark.createDataFrame([(i, i % 5 != 0) for i in range(10, 60)], "doc_id bigint, ok boolean").selectExpr("doc_id", "cast(ok as int) quality", "0 toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs"), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            n, had = out.count(), table.count()
            assert n <= had and (name in ("quality", "near_duplicates") or n == had), name
            if name != "mixing":
                assert out.columns == docs.columns
    near = near_join.keep_one(docs).collect()
    assert sum(r.text is not None and r.text.startswith("Word0") for r in near) == 1
    assert Counter(r.doc_id for r in near if not (r.text or "").strip()) == {None: 1, 3: 1}  # a null and an empty text of one id are alike


def test_each_stage_takes_effect(spark, tmp_path):
    documents = spark.read.parquet(f"{LARGER}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, LARGER)
        if name != "mixing":
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    quality, near, clean, masked, mixed = (seen[n] for n, _ in corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert sum((i in quality) != (q == 1) for i, q in labels.items()) <= 0.03 * len(labels)
    want = brute_classes([(r.doc_id, r.text) for r in quality.values()])
    assert set(near) == {c for _, c, _ in want}
    bench = [w.words for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect() for w in decontaminate.windows_of("i", r.text)]
    index = decontaminate.index_of((decontaminate.Window("i", w) for w in bench), Counter())
    assert set(clean) == {i for i, r in near.items() if not decontaminate.hits_of(words(r.text), index)[0]}
    assert set(masked) == set(clean) == set(mixed)
    changed = [i for i in masked if masked[i].text != clean[i].text]
    assert changed and all("[" in masked[i].text and masked[i].n_chars == len(masked[i].text) for i in changed)
    assert sorted(r.position for r in mixed.values()) == list(range(len(mixed)))
