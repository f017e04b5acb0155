import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeworks import config
from cladeworks.functions import vectors as V
from cladeworks.operators import cluster, control, graph, losses, metrics, mining, pairwise, textetl, tiles
from cladeworks.sources import artifacts


def first(df):
    return df.first().asDict()


# --- graph

def test_pagerank_sums_to_one_and_prefers_the_hub(spark):
    edges = graph.mirrored(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4)], "src int, dst int"))
    ranks = {r.id: r["rank"] for r in graph.pagerank(edges, spark.range(6)).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == 0 and ranks[5] > 0


def test_core_numbers(spark):
    clique = [(a, b) for a in range(4) for b in range(a)]
    edges = graph.mirrored(spark.createDataFrame([*clique, (3, 4), (4, 5), (5, 6), (6, 4)], "src int, dst int"))
    cores = {r.id: r.core for r in graph.kcore(edges, spark.range(8)).collect()}
    assert cores == {0: 3, 1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 2, 7: 0}


# --- text

def test_blocks_drop_headers_but_keep_their_numbers(spark):
    df = spark.createDataFrame([("31", "The Sector as a Whole\r\n\r\nPrimary line\r\nCross-References. x\r\nFinal line"), ("32", "")], "code string, description string")
    got = textetl.blocks(df).collect()
    assert [(r.code, r.description_id, r.description) for r in got] == [("31", 2, "Primary line"), ("31", 4, "Final line")]


def test_cleaning_chain(spark):
    raw = [" A<b>x</b>.B; c ", "NULL U.S. firms", "See industry description for 123456.Rest", "31-33 and\xa0\xa044-45"]
    df = spark.createDataFrame([(x,) for x in raw], "t string").select(textetl.cleaned(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["Ax. B; c", "U.S. firms", "Rest", "31 and 44"]


def test_exclusions_examples_and_fill(spark):
    codes = spark.createDataFrame([(c,) for c in ("111", "222", "333")], "code string")
    clean = spark.createDataFrame([("111", 1, "Keep me"), ("111", 2, "Excluded are 222 and 999"), ("222", 1, "x")], "code string, description_id int, description string")
    cross = spark.createDataFrame([("111", 0, "see 333 333")], "code string, ord int, excluded string")
    excl, blocks = textetl.exclusions(cross, clean, codes)
    row = excl.first()
    assert set(row.excluded_codes) == {"222", "333"} and row.excluded == "see 333 333 Excluded are 222 and 999"
    assert [tuple(r) for r in blocks.collect()] == [("111", 2)]
    sheet = spark.createDataFrame([("222", 1, "b"), ("222", 0, "a"), ("999", 0, "z")], "code string, ord int, examples string")
    marked = clean.withColumn("description", F.when(F.col("description_id") == 1, "Illustrative Examples:").otherwise(F.col("description")))
    exam, starts = textetl.examples(sheet, marked, marked, codes)
    assert {r.code: r.examples for r in exam.collect()} == {"222": "a; b", "111": "Excluded are 222 and 999"}
    assert [tuple(r) for r in starts.collect()] == [("111", 2)]
    rows = [("1111", 1, ""), ("11112", 1, "This industry B"), ("11111", 1, ""), ("111110", 1, "This industry A. This industry"), ("2222", 1, "")]
    none = spark.createDataFrame([], "code string, description_id int")
    no_start = spark.createDataFrame([], "code string, description_id_min int")
    got = {r.code: r.description for r in textetl.filled(spark.createDataFrame(rows, "code string, description_id int, description string"), none, no_start).collect()}
    assert got["11111"] == "This NAICS industry A. This industry"
    assert got["1111"] == "This industry group A. This industry group"  # each rewrite takes its own first hit
    assert "2222" not in got


def test_whole_text_job(spark):
    titles = spark.createDataFrame([(1, "31", "A"), (2, "311", "B"), (3, "312", "C")], "index int, code string, title string")
    texts = spark.createDataFrame([("31", "One\r\nTwo"), ("311", "Three 312")], "code string, description string")
    cross = spark.createDataFrame([("311", 0, "not 312")], "code string, ord int, excluded string")
    sheet = spark.createDataFrame([("31", 0, "e")], "code string, ord int, examples string")
    got = textetl.description_table(titles, texts, cross, sheet).collect()
    assert [(r["index"], r.code, r.description, r.examples, r.excluded_codes) for r in got] == [(0, "31", "One Two", "e", None), (1, "311", "Three 312", None, ["312"])]


# --- vectors

vectors = st.lists(st.floats(-2, 2), min_size=3, max_size=3)


@settings(max_examples=10, deadline=None)
@given(st.lists(vectors, min_size=3, max_size=3))
def test_geometry_against_numpy(spark, three):
    df = spark.createDataFrame([(three,)], "v array<array<double>>")
    x = [V.lift(F.col("v")[i]) for i in range(3)]
    got = first(df.select(V.off_manifold(x[0]).alias("off"), *[V.lorentz_distance(x[i], x[j]).alias(f"d{i}{j}") for i, j in ((0, 1), (1, 2), (0, 2))],
                          V.euclidean(V.space(V.log_zero(V.exp_zero(F.col("v")[0]))), F.col("v")[0]).alias("back")))
    lifted = [np.array([np.sqrt(1 + np.dot(v, v)), *v]) for v in three]
    want = np.arccosh(max(1.0, 2 * lifted[0][0] * lifted[1][0] - lifted[0] @ lifted[1]))
    assert got["off"] < 1e-9 and abs(got["d01"] - want) < 1e-6
    assert got["d02"] <= got["d01"] + got["d12"] + 1e-6
    assert got["back"] < 1e-2


def test_pairs_and_neighbours_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 100)
    rng = np.random.default_rng(0)
    data = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, v array<double>")
    want = np.linalg.norm(data[:, None] - data[None], axis=2)
    got = pairwise.all_pairs(df, "euclidean").collect()
    assert len(got) == 30 * 29 // 2 and all(r.id_i < r.id_j and abs(r.value - want[r.id_i, r.id_j]) < 1e-6 for r in got)
    np.fill_diagonal(want, np.inf)
    near = {(r.id_i, r.nth): r.id_j for r in pairwise.nearest(df, 3, "euclidean").collect()}
    assert near == {(i, k + 1): int(np.argsort(want[i], kind="stable")[k]) for i in range(30) for k in range(3)}


def test_hard_cache_walks_past_positives(spark, monkeypatch):
    from cladeworks.operators import sampling

    monkeypatch.setattr(tiles, "TILE_PAIRS", 150)
    rng = np.random.default_rng(4)
    labels = [0 if i % 3 == 0 else i % 4 + 1 for i in range(45)]  # a third in one tight cluster
    labels[7] = None
    data = [rng.normal(size=4) * (0.01 if x == 0 else 1) for x in labels]
    df = spark.createDataFrame([(i, x, v.tolist()) for i, (x, v) in enumerate(zip(labels, data))], "id bigint, label int, v array<double>")
    got = {(r.anchor, r.nth): r.negative for r in sampling.hard_cache(df, 5).collect()}
    want = {}
    for i, x in enumerate(labels):
        others = [j for j, y in enumerate(labels) if j != i and (x is None or x != y)]
        want |= {(i, n + 1): j for n, j in enumerate(sorted(others, key=lambda j: np.linalg.norm(data[i] - data[j]))[:5])}
    assert got == want and len(got) == 45 * 5


def test_router_negatives_come_from_all_vectors(spark, tmp_path, monkeypatch):
    from cladeworks.plans import vector_plans

    monkeypatch.setattr(tiles, "TILE_PAIRS", 150)
    data = np.random.default_rng(5).normal(size=(40, 64))
    ids = [i * 100 for i in range(40)]  # no id lies close behind another
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in zip(ids, data)], "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    g = np.exp(data[:, :8]) / np.exp(data[:, :8]).sum(1, keepdims=True)
    kl = (g[:, None] * np.log(g[:, None] / g[None])).sum(2)
    unlike = 1 - (g @ g.T) / np.outer(np.linalg.norm(g, axis=1), np.linalg.norm(g, axis=1))
    x = np.hstack([np.sqrt(1 + (data**2).sum(1))[:, None], data])
    d = np.arccosh(np.maximum(2 * np.outer(x[:, 0], x[:, 0]) - x @ x.T, 1))
    best = lambda m, i, k: [ids[j] for j in np.argsort(m[i], kind="stable") if j != i][:k]
    got = {(r.anchor, r.nth): r.negative for r in vector_plans.router_confusion_topk(spark, str(tmp_path)).collect()}
    assert got == {(ids[i], n + 1): j for i in range(40) for n, j in enumerate(best(kl, i, 5))}
    mixed = sorted((r.origin, r.anchor, r.negative) for r in vector_plans.router_mix(spark, str(tmp_path)).collect())
    assert mixed == sorted((o, ids[i], j) for o, m in (("router", unlike), ("hard", d)) for i in range(40) for j in best(m, i, 3))


def test_kmeans_separates_clear_clusters(spark):
    rng = np.random.default_rng(1)
    data = [(i, (rng.normal(size=2) * 0.05 + [3 * (i % 3 - 1), 0]).tolist()) for i in range(45)]
    df = spark.createDataFrame(data, "id bigint, v array<double>").withColumn("x", V.lift(F.col("v")))
    centres, inertia = cluster.fit(df, 3, seed=1)
    got = cluster.assign(df, cluster.centre_frame(spark, centres)).withColumn("truth", F.col("id") % 3)
    assert inertia < 5 and abs(first(cluster.agreement(got, "cluster", "truth"))["ari"] - 1) < 1e-9


# --- metrics and losses

def test_perfect_ranking(spark):
    data = [(i, j, float(abs(i - j)), float(abs(i - j))) for i in range(8) for j in range(8) if i != j]
    pairs = spark.createDataFrame(data, "id_i int, id_j int, d double, t double")
    assert all(abs(r.ndcg - 1) < 1e-9 for r in metrics.ndcg_ranking(pairs, (3, 5)).collect())
    once = pairs.where("id_i < id_j")
    assert abs(first(metrics.cophenetic(once))["correlation"] - 1) < 1e-9 and abs(first(metrics.spearman(once))["correlation"] - 1) < 1e-9
    assert first(metrics.cophenetic(once.where("t > 99"))) == {"correlation": 0.0, "n_pairs": 0}


def test_retrieval_example(spark):
    d = [[0, 1, 4, 5], [1, 0, 2, 6], [4, 2, 0, 1], [5, 6, 1, 0]]
    pairs = spark.createDataFrame([(i, j, float(d[i][j])) for i in range(4) for j in range(4) if i != j], "id_i int, id_j int, d double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "parent int, child int")
    got = first(metrics.hierarchy_retrieval(metrics.ranked(pairs), edges, 2, 2))
    assert got == {"parent_retrieval": 2 / 3, "child_retrieval": 0.75, "sibling_confusion": 1.0}


def test_losses_by_hand(spark):
    rows = spark.createDataFrame([(1.0, [2.0, 3.0], [False, True])], "dp double, dn array<double>, masked array<boolean>")
    assert abs(first(losses.contrastive(rows, 0.5))["loss"] - (2.0 - 4.0)) < 1e-9
    pairs = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 0.5, 2.0)], "id_i int, id_j int, d double, t double")
    assert abs(first(losses.rank_order(pairs))["loss"] - 0.6) < 1e-9
    lists = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 2.0, 0.0)], "anchor bigint, id_j bigint, d double, rel double")
    want = (1 - 1 / np.log2(3)) * np.log1p(np.exp(-1.0))
    assert abs(losses.lambda_rank(lists).first().loss - want) < 1e-9


def test_list_losses_against_whole_lists(spark):
    rng = np.random.default_rng(21)
    rows = [(a, j, float(d), float(t)) for a in range(5) for j, (d, t) in enumerate(zip(rng.random(25).round(2) * 4, rng.choice([0.5, 2.0, 4.0], 25)))]
    df = spark.createDataFrame(rows, "id_i bigint, id_j bigint, d double, t double")
    gaps = [d - e + 0.1 for a, _, d, t in rows for b, _, e, u in rows if a == b and t < u]
    active = [g for g in gaps if g > 1e-12]
    got = losses.rank_order(df).first()
    assert abs(got.loss * got.n_active - sum(active)) < 1e-6 and abs(got.n_active - len(active)) <= sum(abs(g) <= 1e-12 for g in gaps)
    lists = df.select(F.col("id_i").alias("anchor"), "id_j", "d", (4.5 - F.col("t")).alias("rel"))
    for r in losses.lambda_rank(lists, 6).collect():
        d, rel = (np.array([x[k] for x in rows if x[0] == r.anchor]) for k in (2, 3))
        rel = 4.5 - rel
        place = np.empty(25)
        place[np.argsort(d, kind="stable")] = np.arange(1, 26)
        disc = np.where(place <= 6, 1 / np.log2(place + 1), 0)
        ideal = (np.sort(rel)[::-1][:6] / np.log2(np.arange(2, 8))).sum()
        costs = [abs((rel[i] - rel[j]) * (disc[i] - disc[j])) / ideal * np.log1p(np.exp(-(d[j] - d[i]))) for i in range(25) for j in range(25) if rel[i] > rel[j]]
        assert abs(r.loss - np.mean(costs)) < 1e-9


def test_totals_and_layers(spark):
    terms = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", None)], "name string, loss double")
    assert first(losses.weighted_total(terms, {"b": 0.5}))["total"] == 3.5 and first(losses.weighted_total(terms.limit(0), {}))["total"] == 0.0
    weighed = spark.createDataFrame([("a", 2.0, 0.0), ("b", 4.0, float(np.log(2.0)))], "name string, loss double, s double")
    assert abs(first(losses.uncertainty_total(weighed))["total"] - (1 + 1 + 0.5 * np.log(2))) < 1e-9
    rng = np.random.default_rng(22)
    t = rng.normal(0, 0.4, (4, 3))
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "id bigint, t array<double>").select("id", V.exp_zero(F.col("t")).alias("x"))
    edges = [(0, 1, 0.0), (2, 1, 1.0), (1, 0, 0.5)]
    got = {r.id: r.x for r in losses.attention_layers(vecs, spark.createDataFrame(edges, "src bigint, dst bigint, score double"), 2).collect()}
    for _ in range(2):
        new = t.copy()
        w = np.exp([0.0, 1.0]) / np.exp([0.0, 1.0]).sum()
        new[1] = t[1] + w[0] * t[0] + w[1] * t[2]
        new[0] = t[0] + t[1]
        t = new * np.minimum(1, 3.0 / np.linalg.norm(new, axis=1))[:, None]
    for i in range(4):
        n = np.linalg.norm(t[i])
        assert np.allclose(got[i], np.append(np.cosh(n), np.sinh(n) / n * t[i]), atol=1e-4)


def test_gates_and_false_negatives(spark):
    df = spark.createDataFrame([([0.0, 2.0, 1.0],)], "l array<double>").select(F.explode(mining.gates(F.col("l"), 2)).alias("g"))
    got = {r.g.expert: r.g.weight for r in df.collect()}
    assert set(got) == {1, 2} and abs(sum(got.values()) - 1) < 1e-9 and got[1] > got[2]
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "anchor int, negative int")
    labels = spark.createDataFrame([(0, 5), (1, 5)], "id int, label int")
    assert sorted(r.false_negative for r in mining.false_negatives(pairs, labels).collect()) == [False, True]
    with pytest.raises(ValueError):
        mining.false_negative_loss(pairs, "other")


# --- control

def test_controller_advances_rolls_back_and_stops(spark):
    step = control.controller_step
    state, cfg = control.ControllerState(), control.ControllerConfig()
    assert [step(state, v, v, 0.0, cfg) for v in (1.0, 0.9, 0.7)] == ["STAY", "STAY", "ADVANCE"] and state.phase == 1
    assert [step(state, 0.5, 0.7, 0.1, cfg) for _ in range(2)] == ["STAY", "STAY"]
    assert step(state, 0.1, 0.9, 0.1, cfg) == "ROLLBACK" and state.phase == 0 and state.rollbacks == 1
    copy = control.restored(json.loads(json.dumps(control.saved(state))))
    assert copy == state
    state.phase = 4
    assert step(state, 1.0, 1.0, 0.0, cfg) == "STAY"


def test_stream_sessions_equal_sessions_whatever_the_files(spark, tmp_path):
    from cladeworks.plans import control_plans, extra_plans

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in range(20):  # the latest days first, in more files than a batch of the stream takes
        events.where(F.dayofmonth("ts") % 20 == 19 - n).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    pick = lambda df: sorted((r.start, r.user_id, r.n, r.total) for r in df.collect())
    got = pick(extra_plans.stream_sessions(spark, str(tmp_path)))
    assert got == pick(control_plans.events_session(spark, str(tmp_path)))
    assert sum(r[2] for r in got) == events.count()


def test_channel_tokens_cover_whole_texts(spark):
    from cladeworks.operators import textetl
    from cladeworks.plans import graph_text_plans

    words = [f"w{i}" for i in range(11)]
    df = spark.createDataFrame([(0, "a b c", " ".join(words)), (1, "", None)], "id int, title string, text string")
    got = sorted(textetl.channel_tokens(df, {"title": 2, "text": 4}).collect(), key=lambda r: (r.id, r.window))
    assert [(r.id, r.window) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert [r.title_tokens for r in got] == [["a", "b"], ["c", ""], ["", ""], [textetl.EMPTY_TOKEN, ""]]
    assert [x for r in got[:3] for x, m in zip(r.text_tokens, r.text_mask) if m] == words and got[2].text_mask == [1, 1, 1, 0]
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = F.when((F.col("doc_id") % 5 == 0) | (F.coalesce(F.length("text"), F.lit(0)) == 0), 1).otherwise(F.size(F.split("text", r"\s+")))
    want = documents.agg(F.sum(kept)).first()[0]
    assert graph_text_plans.channel_tokens(spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0] == want


# --- sources and settings

def test_employment_slice(spark, tmp_path):
    (tmp_path / "q.csv").write_text("year,own_code,industry_code,annual_avg_emplvl,annual_avg_estabs,tot_wages\n2023,5, 111 ,10,2,100\n2023,5,111,NA,4,200\n2022,5,111,1,1,1\n2023,5,1111,1,1,1\n")
    got = first(artifacts.read_employment(spark, str(tmp_path / "q.csv"), 2023, 5, 3))
    assert abs(got["avg_emp"] - 10.000001) < 1e-9 and abs(got["avg_estabs"] - 3.000001) < 1e-9 and abs(got["log_avg_emp"] - np.log(10.000001)) < 1e-9


def test_sheet(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>x y</t></is></c></row>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Seq</t></si><si><t>Title</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    got = artifacts.read_sheet(spark, tmp_path / "s.xlsx", {"Seq": ("index", "int"), "Title": ("title", "string")})
    assert [tuple(r) for r in got.collect()] == [(7, "x y")]
    with pytest.raises(ValueError):
        artifacts.read_sheet(spark, tmp_path / "s.xlsx", {"No": ("n", "int")})


def test_fetch_tries_again():
    calls = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"" if len(calls) < 2 else b"body"

    def opener(url, timeout):
        calls.append(url)
        return Answer()

    assert artifacts.fetch("u", delay=0.0, opener=opener) == b"body" and len(calls) == 2


def test_cache_schema_and_vectors(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    key = artifacts.config_key({"a": 1, "b": 2}, ["a"])
    assert len(key) == 16 and key == artifacts.config_key({"a": 1, "b": 3}, ["a"])
    for _ in range(2):
        assert artifacts.cached(spark, str(tmp_path), key, make).count() == 3
    assert made == [1]
    assert artifacts.check_schema(spark.range(1), ["id", "x"], "t").errors and artifacts.check_schema(spark.range(1), ["id"], "t").valid
    wide = spark.createDataFrame([(1.0, 2.0, 3)], "hyp_e1 double, hyp_e0 double, k int")
    assert artifacts.to_vectors(wide).first().x == [2.0, 1.0]
    with pytest.raises(ValueError):
        artifacts.vector_columns(wide.drop("hyp_e0"), "hyp_e")


def test_settings():
    c = config.overridden(config.Config(), "sampling.seed=7", "curriculum.two_phase=true", "sampling.anchor_level=[3, 4]")
    assert c.sampling.seed == 7 and c.curriculum.two_phase is True and c.sampling.anchor_level == [3, 4]
    for bad in ("sampling.nothing=1", "sampling.strategy=x", "model.top_k=9", "curriculum.phase1_end=0.9"):
        with pytest.raises(ValueError):
            config.overridden(config.Config(), bad)
